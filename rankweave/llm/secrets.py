"""Secret scan with multipart credential linking.

Strong finds (the base) come from three patterns: assignments, access identifiers, long hex runs.
A bare random token is too weak to report by itself. It is reported (kind `weak`) only when the
complementary parts of a credential co-occur: an access identifier and an endpoint, both within
SCOPE code points of it. The parts of all documents that have all three are exploded and met by an
interval join on (document, cell of SCOPE code points); as parts do not overlap, the number of
parts in a cell is bounded, so no document can form all its pairs. A token inside a base span is
that base span already.

Positions are code points, end exclusive, found with split() and regexp_extract_all() only: the
pieces between matches and the matches themselves, laid end to end.

Defined cases: a null text is empty and has no finds. Rows that repeat get equal finds: equal texts
are linked once, and the links are joined back by text under a salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved

# Fixed values of the base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
KINDS = ("assign", "access", "hex", "weak")

WEAK = r"([A-Za-z0-9+/]{32,}={0,2})"
ENDPOINT = r"([a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+)"
SCOPE = 256
SALTS = 16
RUN = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, order: int, least: int = 1, part: int = 1) -> Column:
    """Sorted array of (start, order, end); matches whose group `part` has under `least` code points are dropped.
    Places are summed up in runs of RUN matches and then over the runs, so the work grows with the matches."""
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(part)).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    zero = F.lit(0)

    def sizes(x: Column) -> Column:
        keep = x["hit"].isNotNull() & (F.length(x["part"]) >= least)
        return F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), zero).alias("hit"), F.coalesce(keep, F.lit(False)).alias("keep"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + x["hit"]).alias("end"))
        return F.struct((start + x["hit"]).alias("at"), F.when(x["keep"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def place(runs: Column) -> Column:
        begin = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("starts"))
        whole = lambda run: F.aggregate(run, zero, lambda n, x: n + x["gap"] + x["hit"])
        starts = F.aggregate(runs, begin, lambda acc, run: F.struct((acc["at"] + whole(run)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
        return F.flatten(F.zip_with(runs, starts, lambda run, at: F.aggregate(run, F.struct(at.alias("at"), none.alias("found")), step)["found"]))

    def in_runs(found: Column) -> Column:
        return F.transform(F.sequence(zero, F.floor((F.size(found) - 1) / RUN).cast("int")), lambda k: F.slice(found, k * RUN + 1, F.lit(RUN)))

    return _let(F.transform(steps, sizes), lambda found: _let(in_runs(found), place))


def _if_any(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (of the text), assign, access, hex, weak, endpoint: arrays of (start, kind, end)."""
    text, low = F.col("__text"), F.lower(F.col("__text"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    word = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    rows = rows.select(
        "doc_id",
        "__text",
        F.xxhash64("__text").alias("h1"),
        F.xxhash64(F.lit(1), "__text").alias("h2"),
        _if_any(word, _spans(text, ASSIGN, 0, 6, 2)).alias("assign"),
        _if_any(text.contains("AKIA"), _spans(text, ACCESS, 1)).alias("access"),
        _if_any(text.rlike(HEX), _spans(text, HEX, 2)).alias("hex"),
    )
    linkable = (F.size("access") > 0) & text.contains("://")
    return rows.select(
        "doc_id", "h1", "h2", "assign", "access", "hex",
        _if_any(linkable, _spans(text, WEAK, 3)).alias("weak"),
        _if_any(linkable, _spans(text, ENDPOINT, 4)).alias("endpoint"),
    )


def _cells(rows: DataFrame, span: str, scope: int) -> DataFrame:
    """A row for each cell that the span has a part in."""
    return rows.withColumn("cell", F.explode(F.expr(f"sequence({span}.start div {scope}, ({span}.end - 1) div {scope})")))


def link_weak(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(h1, h2, weak_linked): the weak spans of each text that have an identifier and an endpoint in scope
    and lie in no base span."""
    one = parts.where("size(access) > 0 AND size(weak) > 0 AND size(endpoint) > 0").dropDuplicates(["h1", "h2"])
    tokens = one.select("h1", "h2", F.explode("weak").alias("w"))
    wide = tokens.withColumn("cell", F.explode(F.expr(f"sequence((w.start - {scope}) div {scope} - 1, (w.end + {scope}) div {scope})")))

    def near(kind: str) -> DataFrame:
        other = one.select("h1", "h2", F.explode(kind).alias("o")).withColumn("cell", F.expr(f"o.start div {scope}"))
        close = (F.col("o.start") < F.col("w.end") + scope) & (F.col("o.end") > F.col("w.start") - scope)
        apart = (F.col("o.start") >= F.col("w.end")) | (F.col("o.end") <= F.col("w.start"))
        return wide.join(other, ["h1", "h2", "cell"]).where(close & apart).select("h1", "h2", "w").distinct()

    base = _cells(one.select("h1", "h2", F.explode(F.concat("assign", "access", "hex")).alias("s")), "s", scope)
    told = _cells(tokens, "w", scope).join(base, ["h1", "h2", "cell"]).where("s.start < w.end AND w.start < s.end").select("h1", "h2", "w")
    both = near("access").join(near("endpoint"), ["h1", "h2", "w"], "left_semi").join(told, ["h1", "h2", "w"], "left_anti")
    return both.groupBy("h1", "h2").agg(F.collect_set("w").alias("weak_linked"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_weak for every row."""
    parts = saved(find_parts(docs), "secret-parts")
    links = link_weak(parts, scope).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    maybe = "size(access) > 0 AND size(weak) > 0 AND size(endpoint) > 0"
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    linked = parts.where(maybe).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(links, ["h1", "h2", "salt"], "left")
    rows = linked.select("doc_id", "assign", "access", "hex", F.coalesce("weak_linked", none).alias("more"))
    rows = rows.unionByName(parts.where(f"NOT ({maybe})").select("doc_id", "assign", "access", "hex", none.alias("more")))
    base = F.concat("assign", "access", "hex")
    return rows.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.array_sort(base)), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(base, F.col("more")))).alias("spans"),
        F.size("more").cast("long").alias("n_weak"),
    )


def _sql_finds(kind: str, pattern: str, part: int = 1, least: int = 1, where: str = "true") -> str:
    text = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, {KINDS.index(kind) if kind in KINDS else 4} AS o, unnest(starts) AS s, unnest(ends) AS e, unnest(sizes) >= {least} AS good FROM (
  SELECT r, list_transform(range(1, len(h) + 1), lambda i: (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT) AS starts,
         list_transform(range(1, len(h) + 1), lambda i: (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))))::BIGINT) AS ends,
         list_transform(regexp_extract_all(t, '{text}', {part}), lambda x: length(x)) AS sizes
  FROM (SELECT r, t, string_split_regex(t, '{text}') AS g, regexp_extract_all(t, '{text}', 0) AS h FROM d WHERE {where}))"""


_SQL_SAID = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
base AS (
  SELECT * FROM ({_sql_finds("assign", ASSIGN, 2, 6)} UNION ALL {_sql_finds("access", ACCESS)} UNION ALL {_sql_finds("hex", HEX)}) WHERE good),
linkable AS (SELECT DISTINCT r FROM base WHERE kind = 'access'),
tokens AS ({_sql_finds("weak", WEAK, where="r IN (SELECT r FROM linkable)")}),
ends AS ({_sql_finds("endpoint", ENDPOINT, where="r IN (SELECT r FROM linkable)")}),
weak AS (
  SELECT DISTINCT w.* FROM tokens w
  JOIN base a ON a.r = w.r AND a.kind = 'access' AND a.s < w.e + {SCOPE} AND a.e > w.s - {SCOPE} AND (a.s >= w.e OR a.e <= w.s)
  JOIN ends p ON p.r = w.r AND p.s < w.e + {SCOPE} AND p.e > w.s - {SCOPE} AND (p.s >= w.e OR p.e <= w.s)
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND w.s < b.e)),
told AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {_SQL_SAID} AS said FROM base GROUP BY r),
every AS (SELECT r, count(*) FILTER (kind = 'weak') AS n_weak, {_SQL_SAID} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_weak, 0) AS n_weak
FROM d LEFT JOIN told USING (r) LEFT JOIN every USING (r)
"""
