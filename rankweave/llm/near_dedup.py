"""Near-dedup by DartMinHash signatures and banding.

A text is the set of its five-word shingles (words: runs between white space, lower case); a text
with fewer words is one shingle. Each element of weight w owns the region [0, w) of a weight axis
and a rank axis without end. Darts fall on it at rate one per unit of area, at places drawn from
the element's own hash, so two texts that share an element see the same darts in the region they
share. Each dart has a coordinate of 0 .. K-1; the earliest dart of each coordinate makes the
signature. Darts are thrown up to the rank at which K ln K + 2K of them are expected, whatever the
size of the text, and further only while a coordinate is empty. Two signatures agree at a
coordinate with a probability equal to the (weighted) Jaccard similarity. `dart_signatures` takes
any weights; near_duplicates uses weight 1, the plain Jaccard similarity of shingle sets.

Texts of equal word sequence are collapsed first. BANDS bands of ROWS coordinates give bucket
keys; two texts of similarity 0.8 share no bucket with a probability of 2e-6. A bucket of up to
SMALL texts gives all its pairs, a larger one pairs each text with a representative. Pairs whose
signatures agree in fewer than 60 of 100 coordinates are dropped (five standard deviations below
0.8); for the others the whole shingle sets are compared exactly. Verified links give components
by minimum-label propagation.

Large buckets that then still hold texts of more than one component are settled exactly. Their texts
are cut into blocks of about BLOCK texts and BLOCK_BYTES of shingles (a component that fills blocks of
its own, the smaller ones together), and every two blocks of a bucket that can hold texts of unlike
components meet in a group of their own, where all common shingles are counted by a matrix product.
So every two texts of 0.8 or more that share a large bucket end up in one component, whatever its size.

Defined cases: null, empty and blank texts are copies of each other. Rows may repeat doc_id and
text: one of them stays. Rows that share doc_id but not text are told apart. In a class the smallest
doc_id stays (null is larger than any). Empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import blocks, giving_back, hash_runs, mix, slices, symbols
from .storage import Scratch, saved, sent_if_small

WORDS = 5
K = 100
ROWS = 4
BANDS = K // ROWS
SMALL = 8
THRESHOLD = 0.8
PLAUSIBLE = 60
BLOCK, BLOCK_BYTES = 256, 4 << 20
COLUMNS = 4096
ROW = ["doc_id", "rk", "rk2", "uid"]

_SEEDS = symbols(4096, 77)
_STEPS = symbols(64, 99)


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = K) -> np.ndarray:
    """One row of k uint32 for each set: the earliest dart of each coordinate. Sets hold distinct
    uint64; weights, one positive array for each set, are 1 where none are given."""
    sizes = np.array([len(s) for s in sets])
    region, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    shape = None
    total = sizes.astype(float)
    if weights is not None:
        # Weight bands [0, 1), [1, 2), [2, 4), ...: each is a region that all heavier texts share.
        reach = np.concatenate(weights).astype(float)
        total = np.bincount(owner, reach, len(sets))
        level = np.where(reach > 1, np.ceil(np.log2(np.maximum(reach, 1))), 0).astype(int) + 1
        index = np.repeat(np.arange(len(region)), level)
        band = np.arange(level.sum()) - np.repeat(np.cumsum(level) - level, level)
        with np.errstate(over="ignore"):
            region = mix(region[index] + _STEPS[band % 64])
        low = np.where(band == 0, 0.0, 2.0 ** (band - 1.0))
        owner, shape = owner[index], (low, np.where(band == 0, 1.0, low), reach[index])
    out = np.zeros((len(sets), k), np.uint64)
    rank, todo = (k * np.log(k) + 2 * k) / total, np.ones(len(sets), bool)
    while todo.any():
        mine = todo[owner]
        dart, at, whose = _throw(region[mine], owner[mine], rank, shape and tuple(x[mine] for x in shape))
        place = whose * k + (mix(dart ^ np.uint64(0xA5A5A5A5)) % np.uint64(k)).astype(np.int64)
        best = np.full(len(sets) * k, np.inf)
        np.minimum.at(best, place, at)
        won = at == best[place]
        out.reshape(-1)[place[won]] = dart[won]
        todo &= np.isinf(best.reshape(-1, k)).any(axis=1)
        rank = rank * 2
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _throw(region: np.ndarray, owner: np.ndarray, rank: np.ndarray, shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts below the rank of their owner that hit a weight in reach: (hash, rank, owner)."""
    darts, ranks, owners, tick = [], [], [], 0
    live, now = np.arange(len(region)), np.zeros(len(region))
    while len(live):
        many = 1 if tick < 8 else 16
        seeds = _SEEDS[(tick + np.arange(many)) % 4096] + np.uint64(tick // 4096)
        with np.errstate(over="ignore"):
            dart = mix(region[live][:, None] + seeds)
        gap = -np.log(_unit(dart))
        if shape:
            gap /= shape[1][live][:, None]
        at = now[:, None] + (np.cumsum(gap, axis=1) if many > 1 else gap)
        own = owner[live]
        hit = at < rank[own][:, None]
        stay = hit[:, -1]
        if shape:
            hit = hit & (shape[0][live][:, None] + shape[1][live][:, None] * _unit(mix(dart ^ np.uint64(0x5BD1E995))) < shape[2][live][:, None])
        darts.append(dart[hit])
        ranks.append(at[hit])
        owners.append(np.broadcast_to(own[:, None], hit.shape)[hit])
        now, live = at[stay, -1], live[stay]
        tick += many
    return np.concatenate(darts), np.concatenate(ranks), np.concatenate(owners)


class Shingler:
    """Shingle hashes and digests of batches of texts."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.steps = symbols(words, 11) | np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """(distinct shingle hashes, digest of the sequence of words) of each text."""
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        for a, b in blocks(raw):
            sizes = np.array([len(t) + 1 for t in raw[a:b]])
            data = np.frombuffer(b" ".join(raw[a:b]) + b" ", np.uint8)
            blank = self.space[data]
            edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
            starts, ends = edge[0::2], edge[1::2]
            words = hash_runs(data[~blank], ends - starts, 3)
            bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
            with np.errstate(over="ignore"):
                shingles = sum(words[i : len(words) - self.words + 1 + i] * self.steps[i] for i in range(self.words)) if len(words) >= self.words else words[:0]
            shingles = mix(shingles) if len(shingles) else shingles
            for t, i, j in zip(raw[a:b], bounds[:-1], bounds[1:], strict=True):
                digest = hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest()
                if j - i >= self.words:
                    yield np.unique(shingles[i : j - self.words + 1]), digest
                else:
                    yield np.array([int.from_bytes(digest[:8], "little")], np.uint64), digest


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in slices(batches, "text"):
        sets = list(shingler(batch.column("text").to_pylist()))
        distinct = {d: s for s, d in sets}
        known: dict[bytes, bytes] = {}
        names = list(distinct)
        for a, b in blocks([distinct[d] for d in names], 200_000):
            signed = dart_signatures([distinct[d] for d in names[a:b]])
            known |= {d: row.tobytes() for d, row in zip(names[a:b], signed, strict=True)}
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ROW), pa.array([d for _, d in sets], pa.binary()), pa.array([known[d] for _, d in sets], pa.binary())], [*ROW, "node", "sig"]
        )


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in slices(batches, "text"):
        sets = list(shingler(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([d for _, d in sets], pa.binary()), pa.array([s.tobytes() for s, _ in sets], pa.binary())], ["node", "shingles"])


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, K) for c in ("sig_a", "sig_b"))
            batch = batch.filter(pa.array((a == b).sum(axis=1) >= PLAUSIBLE))
        yield batch.drop_columns(["sig_a", "sig_b"])


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(common >= THRESHOLD * (len(s) + len(t) - common))
        yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["set_a", "set_b"])


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that tell apart rows that differ in doc_id or text."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64("doc_id", text), F.xxhash64(F.lit(1), text, "doc_id")


def _sets_of(s: Scratch, ends: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ends, a saved table: one pass over the texts."""
    ends = sent_if_small(ends)
    keys = sent_if_small(s.saved(nodes.join(ends, "node", "left_semi").select("best.rk").distinct(), "keys"))
    texts = docs.select(row_keys(docs)[0].alias("rk"), "text").join(keys, "rk", "left_semi").select("text")
    return sent_if_small(s.saved(texts.mapInArrow(giving_back(_sets), "node binary, shingles binary").join(ends, "node", "left_semi").dropDuplicates(["node"]), "shingle-sets"))


def _schema(pairs: DataFrame) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes)


def _plausible(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose signatures agree often enough."""
    near = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
    return near.select(*pairs.columns, "sig_a", "sig_b").mapInArrow(giving_back(_agreeing), _schema(pairs))


def _verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose shingle sets are similar enough."""
    both = near.join(sets.withColumnsRenamed({"node": "a", "shingles": "set_a"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "set_b"}), "b")
    return both.select(*near.columns, "set_a", "set_b").mapInArrow(giving_back(_similar), _schema(near))


def components(s: Scratch, links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component."""
    both = s.saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = s.saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        labels = sent_if_small(labels)
        other = labels.withColumnsRenamed({"node": "b", "label": "other"})
        seen = both.join(other, "b").groupBy("a").agg(F.min("other").alias("m")).withColumnRenamed("a", "node")
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = s.saved(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels


def _pairs(members: DataFrame) -> DataFrame:
    """members (key, node) -> distinct (a, b): all pairs of small buckets, stars of large ones. The
    smallest node stands for a bucket: stars of several bands share pairs, and it is their label."""
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    rows = members.join(buckets.where("n > 1"), "key")
    small = rows.where(f"n <= {SMALL}").select("key", F.col("node").alias("a"))
    pairs = small.join(small.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b")
    stars = rows.where(f"n > {SMALL} AND node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return pairs.union(stars).distinct()


def _spanning(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of numbers that link the same components as the given ones, without cycles."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for x, y in pairs.tolist():
        if (p := find(x)) != (q := find(y)):
            root[p] = q
            out.append((x, y))
    return out


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each of the sets in one with each in two."""
    (x, at_x), (y, at_y) = ((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])) for sets in (one, two))
    shared = np.intersect1d(x, y)
    counts = np.zeros((len(one), len(two)), np.float32)  # exact below 2 ** 24
    for a in range(0, len(shared), COLUMNS):
        part = shared[a : a + COLUMNS]
        left, right = (np.zeros((len(sets), len(part)), np.float32) for sets in (one, two))
        for matrix, values, at in ((left, x, at_x), (right, y, at_y)):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            matrix[at[hit], place[hit]] = 1
        counts += left @ right.T
    return counts.astype(np.float64)


def _block_links(group: pa.Table) -> pa.Table:
    """(a, b): components that hold similar texts of the two blocks, or of the one, without cycles."""
    names, comp = np.unique(np.array(group.column("comp").to_pylist(), object), return_inverse=True)
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    side = group.column("side").to_numpy()
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if side.any() else one
    sizes = np.array([len(s) for s in sets], float)
    common = _common([sets[i] for i in one], [sets[i] for i in two])
    near = (common >= THRESHOLD * (sizes[one][:, None] + sizes[two] - common)) & (comp[one][:, None] != comp[two])
    i, j = np.nonzero(near)
    ends = np.unique(np.sort(np.stack([comp[one[i]], comp[two[j]]], axis=1), axis=1), axis=0)
    links = _spanning(ends)
    return pa.table({"a": pa.array([names[x] for x, _ in links], pa.binary()), "b": pa.array([names[y] for _, y in links], pa.binary())})


def _across(s: Scratch, rest: DataFrame, sets: DataFrame) -> DataFrame:
    """rest (key, node, comp), sets (node, shingles) -> distinct (a, b): the unlike comps that hold
    similar texts of one bucket. Saved."""
    sizes = sent_if_small(s.saved(sets.select("node", F.octet_length("shingles").cast("long").alias("size")), "sizes"))
    per = rest.join(sizes, "node").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    alone = (F.col("n") >= BLOCK) | (F.col("size") >= BLOCK_BYTES)
    per = s.saved(per.withColumn("own", F.when(alone, F.col("comp")).otherwise(F.lit(b""))), "bucket-parts")
    pieces = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("long").alias("pieces")
    parts = s.saved(per.groupBy("key", "own").agg(pieces), "pieces")
    blocks = parts.select("key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("no"))
    two = blocks.withColumnsRenamed({"own": "own_b", "no": "no_b"})
    pairs = blocks.join(two, "key").where("(own < own_b OR (own = own_b AND own = X'' AND no <= no_b))")
    ends = F.array(F.struct("own", "no", F.lit(0).alias("side")), F.struct(F.col("own_b").alias("own"), F.col("no_b").alias("no"), F.lit(1).alias("side")))
    once = (F.col("own") == F.col("own_b")) & (F.col("no") == F.col("no_b"))
    met = pairs.select("key", F.xxhash64("key", "own", "no", "own_b", "no_b").alias("pair"), F.explode(F.when(once, F.slice(ends, 1, 1)).otherwise(ends)).alias("end"))
    met = sent_if_small(s.saved(met.select("key", "pair", "end.*"), "block-pairs"))
    place = sent_if_small(s.saved(per.select("key", "comp", "own").join(parts, ["key", "own"]), "places"))
    rows = rest.join(place, ["key", "comp"]).withColumn("no", F.pmod(F.xxhash64("node"), F.col("pieces")))
    rows = rows.join(met, ["key", "own", "no"]).select("pair", "side", "node", "comp").join(sets, "node").select("pair", "side", "comp", "shingles")
    return s.saved(rows.groupBy("pair").applyInArrow(_block_links, "a binary, b binary").distinct(), "across")


def _joined(s: Scratch, labels: DataFrame, across: DataFrame) -> DataFrame:
    """labels after links (a, b) between the labels of components; only their small graph is labelled."""
    merged = components(s, across)
    onto = merged.select(F.col("node").alias("label"), F.col("label").alias("up"))
    old = labels.join(onto, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return s.saved(old.union(merged.join(labels, "node", "left_anti").select("node", "label")), "labels")


def _labels(s: Scratch, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, label) of the linked nodes."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * 4 * ROWS + 1, 4 * ROWS)) for i in range(BANDS)])
    members = nodes.select(F.explode(keys).alias("key"), "node")
    near = s.saved(_plausible(s.saved(_pairs(members), "pairs"), nodes.select("node", "sig")), "plausible")
    ends = s.saved(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "ends")
    labels = components(s, s.saved(_verified(near, _sets_of(s, ends, nodes, docs)), "links"))
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {SMALL}").select("key")
    known = members.join(large, "key", "left_semi").join(sent_if_small(labels).withColumnRenamed("label", "comp"), "node", "left")
    known = s.saved(known.select("key", "node", F.coalesce("comp", "node").alias("comp")), "members")
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    rest = s.saved(known.join(mixed.select("key"), "key", "left_semi"), "rest")
    if not rest.isEmpty():
        some = s.saved(rest.select("node").distinct(), "texts")
        across = _across(s, rest, _sets_of(s, some, nodes, docs))
        if not across.isEmpty():
            labels = _joined(s, labels, across)
    return labels


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, per_node), both saved: rows (doc_id, rk, rk2, uid, node), per_node (node, class_size, best:
    the row of the class that stays). uid is a number of the row that the saved table gives it."""
    with Scratch(docs.sparkSession, "near") as s:
        rk, rk2 = row_keys(docs)
        slim = docs.select("doc_id", rk.alias("rk"), rk2.alias("rk2"), F.monotonically_increasing_id().alias("uid"), "text")
        id_type = docs.schema["doc_id"].dataType.simpleString()
        rows = s.saved(slim.mapInArrow(giving_back(_sign), f"doc_id {id_type}, rk long, rk2 long, uid long, node binary, sig binary"), "signatures", keep=True)
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *ROW)).alias("best")
        nodes = s.saved(rows.groupBy("node").agg(best, F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "nodes")
        known = nodes.drop("sig").join(sent_if_small(_labels(s, nodes, docs)), "node", "left").withColumn("comp", F.coalesce("label", "node"))
        classes = known.groupBy("comp").agg(F.min("best").alias("best"), F.sum("copies").alias("class_size"))
        return rows.drop("sig"), s.saved(known.select("node", "comp").join(classes, "comp").drop("comp"), "classes", keep=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of the class), class_size, kept."""
    rows, per_node = _classes(docs)
    out = rows.join(per_node, "node")
    return out.select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("best.uid")).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one for each class, with all columns. Of rows that repeat both doc_id
    and text any one stays."""
    rows, per_node = _classes(docs)
    reps = rows.join(per_node.select("node", "best"), "node").where("rk = best.rk AND rk2 = best.rk2")
    reps = reps.groupBy(F.col("rk").alias("__rw_1"), F.col("rk2").alias("__rw_2")).agg(F.count(F.lit(1)).alias("__rw_times"))
    reps = saved(reps, "near-stay")
    rk, rk2 = row_keys(docs)
    rows = docs.withColumns({"__rw_1": rk, "__rw_2": rk2})
    out = rows.join(reps.where("__rw_times = 1"), ["__rw_1", "__rw_2"]).select(*docs.columns)
    more = reps.where("__rw_times > 1")
    if not more.isEmpty():
        out = out.unionByName(rows.join(more, ["__rw_1", "__rw_2"]).dropDuplicates(["__rw_1", "__rw_2"]).select(*docs.columns))
    return out


# Every pair of texts that shares a shingle is compared, and links are followed to their end.
SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN ['short ' || array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM classes
"""
