import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from rankweave.llm import mixing, quality


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = ["river", "stone", "walk", "light", "house", "green", "over", "under", "cloud", "seven"]
    rows = []
    for i in range(300):
        text = " ".join(f"{rng.choice(words)}{rng.randrange(50)}" for _ in range(rng.randint(20, 80)))
        rows.append([i, text if i % 4 else text.upper().replace(" ", "!! ") + "!!"])
    rows += [[1000 + k, rows[5][1]] for k in range(20)] + [[2000 + k, rows[6][1] + f" extra{k}"] for k in range(20)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = quality.fit(*quality.labelled_sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    scores = quality.score_texts(net, [t for _, t in rows])
    good = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    assert {r[0] for r in rows if r[0] % 4 and r[0] < 300} <= {r[0] for r in good}
    latest = {}
    for i, t in good:
        k = t.lower()
        latest[k] = max(latest.get(k, (-1, "")), (i, t))
    kept, seen = [], []
    for i, t in sorted(latest.values()):
        w = t.lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if not any(len(s & o) >= 0.8 * len(s | o) for o in seen):
            kept.append((i, t))
        seen.append(s)
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in kept], "doc_id long, text string, source string")
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(df).collect() if r.taken}
    starts = Counter(r.doc_id for r in out if r.start == 0)
    assert starts == Counter(times)
    tokens = Counter()
    for r in out:
        tokens[r.doc_id] += r.length
    assert all(tokens[i] == n * next(r.doc_tokens for r in out if r.doc_id == i) for i, n in times.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_pipeline_with_nulls_empties_and_clashing_columns(spark, tmp_path, odd, odd_rows, empty):
    names = ["score", "node", "class_id", "h", "target", "uid", "key", "label"]
    docs = odd.withColumns({n: F.lit("own").cast("string") for n in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(None, 1), (3000, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.count() > 0 and at.where("score <> 'own' OR label <> 'own' OR node <> 'own'").isEmpty(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in at.collect())
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
