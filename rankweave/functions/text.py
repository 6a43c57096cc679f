"""Text expressions: tokens, hashes, edit distance, durations, URLs, highlighting."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_TOKEN = r"[^\p{L}\p{Nd}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_TOKEN), lambda t: t != "")


def byte_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over UTF-8 bytes: each byte is read as one Latin-1 character."""
    return F.levenshtein(F.decode(F.encode(a, "UTF-8"), "ISO-8859-1"), F.decode(F.encode(b, "UTF-8"), "ISO-8859-1"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, unsigned in a BIGINT; no step exceeds 2^57."""
    octets = F.transform(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 "), " "), lambda h: F.conv(h, 16, 10).cast("long"))
    start = F.lit(2166136261).cast("long")
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    return F.when(F.octet_length(text) == 0, start).otherwise(F.aggregate(F.filter(octets, lambda o: o.isNotNull()), start, step))


def chunk_id(url: Column, index: Column) -> Column:
    return fnv1a32(F.concat(url, F.lit("#"), index.cast("string")))


def url_host(url: Column) -> Column:
    """Lower-cased host without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def duration_seconds(text: Column) -> Column:
    """'1h30m', '45s', '250ms', '-1.5h', '.5s', '2us', '7ns', '0' -> seconds; null where the text is not a duration."""
    body = F.regexp_replace(text, "^[+-]", "")
    number = r"(\d+\.?\d*|\.\d+)"
    units = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
    parts = F.regexp_extract_all(body, F.lit(number + "(ns|us|µs|μs|ms|s|m|h)"), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    amount = lambda p: F.regexp_extract(p, "^" + number, 1).cast("double") * F.element_at(table, F.regexp_replace(p, r"^[\d.]+", ""))
    total = F.aggregate(F.transform(parts, amount), F.lit(0.0), lambda a, x: a + x)
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(body == "0", F.lit(0.0)).when(body.rlike(f"^({number}(ns|us|µs|μs|ms|s|m|h))+$"), sign * total)


def cache_key(tenant: Column, query: Column, filters: Column, k: Column) -> Column:
    """First 16 bytes, in hex, of the SHA-256 of length-prefixed parts with filters in key order."""
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    pairs = F.transform(F.array_sort(F.map_entries(filters)), lambda e: F.concat(sized(e["key"]), sized(e["value"])))
    return F.substring(F.sha2(F.concat(sized(tenant), sized(query), F.array_join(pairs, ""), sized(k.cast("string"))), 256), 1, 32)


# Keys whose values are masked.
SENSITIVE = ("password", "secret", "token", "api_key", "apikey", "access_key", "secret_key", "client_secret", "private_key", "refresh_token", "access_token", "session_token", "auth_token", "credentials")


def redact(config: Column) -> Column:
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE), F.lit("***")).otherwise(v))


def any_timestamp(text: Column, layouts: tuple[str, ...]) -> Column:
    """The first layout that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in layouts])


def _highlight(content: str, terms: set[str], fragments: int, width: int) -> list[str]:
    text = re.sub(r"\s+", " ", content).strip()
    if not text:
        return []
    words = list(re.finditer(r"[^\W_]+", text))
    hits = [m for m in words if m.group().lower() in terms]
    if not hits:
        return [text[:width] + ("..." if len(text) > width else "")]
    out, taken = [], set()
    for m in hits:
        start = max(0, m.start() - width // 2)
        while start and not text[start - 1].isspace():
            start -= 1
        end = min(len(text), start + width)
        while end < len(text) and not text[end].isspace():
            end += 1
        if start // width in taken:
            continue
        taken.add(start // width)
        piece, at = [], start
        for h in hits:
            if start <= h.start() and h.end() <= end:
                piece += [text[at : h.start()], "<mark>", h.group(), "</mark>"]
                at = h.end()
        out.append(("..." if start else "") + "".join(piece) + text[at:end] + ("..." if end < len(text) else ""))
        if len(out) == fragments:
            break
    return out


def highlight(content: Column, query: str, fragments: int = 3, width: int = 150) -> Column:
    """Up to `fragments` pieces of about `width` code points around the query's terms, marked."""
    terms = {t.lower() for t in re.findall(r"[^\W_]+", query)}  # words of the marked text are found the same way

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _highlight(t or "", terms, fragments, width))

    return run(content)
