"""Reciprocal rank fusion of whole tables without sorting them.

A row that is among the first R of neither list has a fused score under 2 / (60 + R); the first k rows
of either list have at least 1 / (60 + k). With R = 60 + 2k the first is the smaller, so the best k
are among the first R of one list or the other: at most 2R candidates, a number that does not grow
with the table. What is left are their exact ranks, and a rank is a count: one pass lays each row
between the candidates of each list and adds the rows up, task by task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF = 60
LISTS = ("bm25", "cosine")


class _Order:
    """Candidates of one list by score from high to low, then id."""

    def __init__(self, rows: list[tuple[float, object]]):
        rows = sorted(rows, key=lambda r: (-r[0], r[1]))
        self.keys = np.array([-s for s, _ in rows], float)
        self.ids = np.array([i for _, i in rows], object)

    def places(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each row the number of candidates that it does not come before."""
        low, high = np.searchsorted(self.keys, -scores, "left"), np.searchsorted(self.keys, -scores, "right")
        out = high.copy()
        for at in np.unique(low[low < high]).tolist():
            rows = np.flatnonzero((low == at) & (low < high))
            out[rows] = at + np.searchsorted(self.ids[at : high[rows[0]]], ids[rows], "right")
        return out


def _counts(orders: dict, grouped: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {(key, name): np.zeros(len(order.keys) + 1, np.int64) for (key, name), order in orders.items()}
        for batch in batches:
            ids = np.array(batch.column("id").to_pylist(), object)
            keys = np.array(batch.column("by").to_pylist() if grouped else [None] * len(ids), object)
            members = defaultdict(list)
            for i, key in enumerate(keys.tolist()):
                members[key].append(i)
            for key, rows in members.items():
                for name in LISTS:
                    if (key, name) in orders:
                        scores = batch.column(name).to_numpy(zero_copy_only=False)[rows]
                        tally = found[key, name]
                        tally += np.bincount(orders[key, name].places(scores, ids[rows]), minlength=len(tally))
        names = list(orders)
        rows = [(names.index(pair), place, int(n)) for pair, tally in found.items() for place, n in enumerate(tally) if n]
        yield pa.RecordBatch.from_pydict({"list": pa.array([r[0] for r in rows], pa.int32()), "place": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64())})

    return run


def candidates(scored: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """scored (id, [by], bm25, cosine) -> the rows that can be among the best k, with their exact lex_rank and sem_rank.
    With `by`, ranks and the best k are those of each value of it; their number is that of collections or shards."""
    wide = RRF + 2 * k
    columns = ["id", *([by] if by else []), *LISTS]
    scored = scored.select(*columns).persist()
    try:
        tops = []
        for name in LISTS:
            order = [F.col(name).desc(), "id"]
            if by:  # the limit on the rank is applied in each task before rows are moved
                first = F.row_number().over(Window.partitionBy(by).orderBy(*order))
                tops.append(scored.withColumn("__rn", first).where(F.col("__rn") <= wide).drop("__rn"))
            else:
                tops.append(scored.orderBy(*order).limit(wide))
        rows = list({(r["id"], r[by] if by else None): r for r in tops[0].unionByName(tops[1]).collect()}.values())
        key = (lambda r: r[by]) if by else (lambda r: None)
        groups = defaultdict(list)
        for r in rows:
            for name in LISTS:
                groups[key(r), name].append((r[name], r["id"]))
        orders = {pair: _Order(found) for pair, found in groups.items()}
        slim = scored.select("id", *([F.col(by).alias("by")] if by else []), *LISTS)
        counts = slim.mapInArrow(_counts(orders, by is not None), "list int, place int, n long").groupBy("list", "place").agg(F.sum("n").alias("n")).collect() if rows else []
    finally:
        scored.unpersist()
    ranks: dict[tuple, int] = {}
    tally = {pair: np.zeros(len(order.keys) + 1, np.int64) for pair, order in orders.items()}
    names = list(orders)
    for r in counts:
        tally[names[r["list"]]][r["place"]] += r["n"]
    for pair, order in orders.items():
        for place, (i, before) in enumerate(zip(order.ids.tolist(), np.cumsum(tally[pair]).tolist(), strict=False)):
            ranks[(*pair, i)] = before + 1
    data = [(*(r[c] for c in columns), ranks[key(r), "bm25", r["id"]], ranks[key(r), "cosine", r["id"]]) for r in rows]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema.fields)
    ranked = scored.sparkSession.createDataFrame(data, f"{kinds}, lex_rank long, sem_rank long")
    fused = F.lit(1.0) / (RRF + F.col("lex_rank")) + F.lit(1.0) / (RRF + F.col("sem_rank"))
    return ranked.withColumn("fused", F.round(fused, 9))


def best(scored: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The best k by fused score, then id; with `by`, of each value of it, with their position."""
    ranked = candidates(scored, k, by)
    if not by:
        return ranked.orderBy(F.col("fused").desc(), "id").limit(k)
    spot = F.row_number().over(Window.partitionBy(by).orderBy(F.col("fused").desc(), "id")).cast("long")
    return ranked.withColumn("position", spot).where(F.col("position") <= k)
