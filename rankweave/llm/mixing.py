"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a seeded hash. A source sends its shuffled documents
again and again, at most three times. The n-th sending of a document finishes at the virtual time
(tokens its source has sent up to there) / (target of the source). All sendings, ordered by virtual
finish time over all sources, are cut where the next time would exceed the total budget, which is
the sum of the targets. Sendings with the same finish time stand or fall together.

The cumulative sums run in two levels, within (source, hash bucket) and over the buckets of a
source, so a source with a third of all rows is spread over many tasks. The cut needs no sort of
everything: each source is within its target up to time 1, so only sendings between 1 and the last
one that straddles 1 are summed by range of time, and only the range that holds the cut is ordered.
The driver sees totals only.

Defined cases: a null text has no tokens, an empty document is taken zero times, a null source is
one source and the last in order. Repeated rows are documents of their own. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch, saved, sent_if_small

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
BUCKETS = 1024
BUCKET_ROWS = 1_000_000
RANGES = 4096
RUN = 64
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], repeats: int = REPEATS) -> list[float]:
    """Share sum(sizes) by weight; what would exceed `repeats` x size is shared again among the others."""
    out = [0.0] * len(sizes)
    left, free = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _source_key(source: Column) -> Column:
    """Null sorts last and equals itself."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _shuffle(seed: int) -> Column:
    """A place in the queue by doc_id and text: 60 bits of a digest."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _sources(s: Scratch, sums: DataFrame, weights: Sequence[float], repeats: int) -> tuple[DataFrame, float]:
    """(key, source_size, target) by targets(), whatever the number of sources, and the total of the targets."""
    place = F.row_number().over(Window.orderBy("key")) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = s.saved(sums.select("key", F.col("s").alias("source_size"), weight.alias("w")), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    full, left, free, seen = F.col("source_size") <= 0, float(total), 0.0, -1
    while True:  # the shares of the free sources only grow, so what was full stays full
        r = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("s"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        left, free = float(total - repeats * (r["s"] or 0)), r["w"] or 0.0
        if r["n"] == seen or not free:
            break
        seen, full = r["n"], (F.col("source_size") <= 0) | (F.lit(left) * F.col("w") / F.lit(free) > F.lit(repeats) * F.col("source_size"))
    target = F.when(full, F.col("source_size") * float(repeats)).otherwise(F.lit(left) * F.col("w") / F.lit(free or 1.0))
    out = s.saved(rows.select("key", "source_size", target.alias("target")), "targets", keep=True)
    return sent_if_small(out), float(total)  # the shares are of all sizes, and three times each is enough for them


def mix(docs: DataFrame, seed: int = 17, repeats: int = REPEATS, weights: Sequence[float] = WEIGHTS, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row, with the columns of `carry` besides."""
    carry = dict(carry or {})
    with Scratch(docs.sparkSession, "mix") as s:
        slim = docs.select("doc_id", _source_key(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"), _shuffle(seed).alias("h"), *[c.alias(n) for n, c in carry.items()])
        slim = s.saved(slim, "sizes", keep=True)
        slim = slim.withColumn("b", F.pmod("h", F.lit(max(BUCKETS, slim.count() // BUCKET_ROWS))).cast("int"))
        parts = s.saved(slim.groupBy("key", "b").agg(F.sum("size").alias("s")), "parts")
        table, budget = _sources(s, parts.groupBy("key").agg(F.sum("s").alias("s")), weights, repeats)

        parts = parts.withColumn("before", F.sum("s").over(Window.partitionBy("key").orderBy("b")) - F.col("s")).drop("s")
        parts = parts.join(table, "key")
        run = Window.partitionBy("key", "b").orderBy("h", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
        queue = slim.join(parts, ["key", "b"]).withColumn("sent", F.col("before") + F.sum("size").over(run))
        queue = queue.where("size > 0").select("doc_id", "key", "size", "source_size", "target", "sent", *carry)
        queue = s.saved(queue, "queue", keep=True)
        cut = _cut(queue, budget, repeats)
    taken = sum((F.when(_finish(e) <= F.lit(cut), F.col("size")).otherwise(F.lit(0)) for e in range(repeats)), F.lit(0)).cast("long")
    empty = slim.where("size = 0").join(table, "key")
    columns = ["doc_id", "size", "source_size", "target", *carry]
    out = queue.select(*columns, taken.alias("taken")).unionByName(empty.select(*columns, F.lit(0).cast("long").alias("taken")))
    return out.select("doc_id", "size", "source_size", "target", "taken", *carry)


def _finish(sending: int) -> Column:
    return (F.col("sent") + F.lit(sending) * F.col("source_size")) / F.col("target")


def _cut(queue: DataFrame, budget: float, repeats: int) -> float:
    """The largest finish time at which all sendings up to it fit the budget."""
    sendings = queue.select("size", "target", F.explode(F.array(*[_finish(e) for e in range(repeats)])).alias("at"))
    straddles = (F.col("at") > 1) & (F.col("at") - F.col("size") / F.col("target") < 1)
    row = sendings.agg(F.sum(F.when(F.col("at") <= 1, F.col("size"))).alias("used"), F.max(F.when(straddles, F.col("at"))).alias("last")).first()
    if row["last"] is None:
        return 1.0
    left, width = budget - (row["used"] or 0), row["last"] - 1.0
    late = sendings.where((F.col("at") > 1) & (F.col("at") <= F.lit(row["last"])))
    late = late.withColumn("range", F.least(F.floor((F.col("at") - 1) / F.lit(width) * RANGES), F.lit(RANGES - 1)))
    sums = late.groupBy("range").agg(F.sum("size").alias("s"), F.min("at").alias("low"))
    cut = 1.0
    for r in sorted(sums.collect(), key=lambda r: r["range"]):  # RANGES rows at most
        if r["s"] <= left:
            left -= r["s"]
            cut = None  # everything up to the end of this range fits
            through = r["range"]
            continue
        inside = late.where(F.col("range") == r["range"]).groupBy("at").agg(F.sum("size").alias("s"))
        fits = inside.withColumn("upto", F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("at"))).where(F.col("upto") <= F.lit(left))
        best = fits.agg(F.max("at")).first()[0]
        if best is not None:
            return best
        break
    if cut is None:
        return late.where(F.col("range") <= through).agg(F.max("at")).first()[0]
    return cut


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that are equal in all columns (maps
    aside) stand for each other: what the mix takes of them together comes as copies of one."""
    columns = [c for c, kind in docs.dtypes if "map<" not in kind]
    keys = {"__rw_1": F.xxhash64(*columns), "__rw_2": F.xxhash64(F.lit(1), *reversed(columns))}
    plan = mix(docs, **options, carry=keys).withColumn("times", F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0))
    plan = plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rw_rows"), F.sum("times").alias("__rw_times"))
    plan = saved(plan.where("__rw_times > 0"), "plan")
    rows = docs.withColumns(keys)
    once = rows.join(plan.where("__rw_rows = 1"), [*keys])
    out = once.withColumn("__rw_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rw_times")))).select(*docs.columns)
    more = plan.where("__rw_rows > 1")
    if not more.isEmpty():  # the copies of one row are dealt in runs, so that no task makes them all
        one = rows.join(more, [*keys]).dropDuplicates([*keys])
        one = one.withColumn("__rw_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__rw_times - 1) div {RUN}")))).repartition(*keys, "__rw_run")
        n = F.least(F.lit(RUN), F.col("__rw_times") - F.col("__rw_run") * RUN)
        out = out.unionByName(one.withColumn("__rw_n", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long")))).select(*docs.columns))
    return out


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS s FROM rows GROUP BY source),
weighed AS (SELECT source, s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sums),
line AS (
  SELECT *, sum(s) OVER () AS total, row_number() OVER o AS k,
         coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM weighed WHERE s > 0 WINDOW o AS (ORDER BY 3 * s / w, source)),
level AS (SELECT (total - full_before)::DOUBLE AS left_over, w_from AS w_free, k AS first_free FROM line WHERE 3 * s >= (total - full_before) * w / w_from ORDER BY k LIMIT 1),
goal AS (
  SELECT w.source, w.s, CASE WHEN w.s = 0 THEN 0.0 WHEN l.k < first_free THEN 3.0 * w.s ELSE left_over * w.w / w_free END::DOUBLE AS target
  FROM weighed w LEFT JOIN line l ON l.source IS NOT DISTINCT FROM w.source LEFT JOIN level ON true),
queue AS (
  SELECT doc_id, size, s, target, sum(size) OVER (PARTITION BY r.source ORDER BY h % 1024, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
  FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source),
sendings AS (SELECT size, (sent + e * s)::DOUBLE / target AS fin FROM queue, range(0, 3) t(e) WHERE size > 0),
cut AS (
  SELECT max(fin) AS fin FROM (SELECT fin, sum(sum(size)) OVER (ORDER BY fin) AS upto FROM sendings GROUP BY fin)
  WHERE upto <= (SELECT sum(s) FROM sums))
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE size * len(list_filter(range(0, 3), lambda e: (sent + e * s)::DOUBLE / target <= cut.fin)) END)::BIGINT AS taken
FROM queue LEFT JOIN cut ON true
"""
