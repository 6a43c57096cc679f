import json
import os
import random
import time
from threading import Event

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rankweave.engine import Config, Engine, ResultCache
from rankweave.functions import network
from rankweave.functions import text as T
from rankweave.functions import vectors as V
from rankweave.operators import ann, chunking, embed, evaluate, fusion, index, lexicon, lifecycle, routing, search, versions
from rankweave.sources import connectors, crawl, html, relational, shared
from rankweave.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fnv_and_byte_distance(spark):
    assert one(spark, T.fnv1a32(F.lit("foobar"))) == 0xBF9CF968
    assert one(spark, T.fnv1a32(F.lit(""))) == 0x811C9DC5
    assert one(spark, T.byte_levenshtein(F.lit("naïve"), F.lit("naive"))) == 2


def test_vector_identities(spark):
    a, z = V.literal([1, 2, 3]), V.literal([0, 0, 0])
    assert one(spark, V.cosine(a, a)) == pytest.approx(1) and one(spark, V.cosine(a, z)) == 0
    assert one(spark, V.cosine(V.literal([]), a)) == 0
    assert one(spark, V.l2_squared(a, z)) == 14
    q = V.scalar_quantize(V.literal([-1, 0, 1, 9]), -1, 1)
    assert one(spark, q) == [-128, 0, 127, 127]
    assert one(spark, V.scalar_quantize(a, 1, 1)) == [0, 0, 0]
    assert one(spark, V.binary_quantize(V.literal([1.0] * 64), 64)) == [-1]
    assert one(spark, V.hamming(V.binary_quantize(V.literal([1, -1] * 40), 80), V.binary_quantize(V.literal([1.0] * 80), 80))) == 40


def test_rrf_values(spark):
    df = spark.createDataFrame([(1, 10.0, 0.5), (2, 5.0, 0.9), (3, 15.0, 0.3)], "id long, bm25 double, cosine double")
    got = search.rrf(df, 3).collect()
    assert [r.id for r in got] == [2, 3, 1]
    assert search.rrf(df.where("id = 1"), 5).first()["fused"] == pytest.approx(2 / 61)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fusion_counts_ranks_exactly(spark, kind):
    rng = random.Random(1)
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    rows = [(name(i), rng.choice("xyz"), rng.choice([0.0, 0.0, 1.5, round(rng.random() * 9, 1)]), round(rng.random(), 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, f"id {kind}, source string, bm25 double, cosine double").repartition(5)

    def naive(some):
        lex = {r[0]: n for n, r in enumerate(sorted(some, key=lambda r: (-r[2], r[0])), 1)}
        sem = {r[0]: n for n, r in enumerate(sorted(some, key=lambda r: (-r[3], r[0])), 1)}
        order = sorted((-round(1 / (60 + lex[r[0]]) + 1 / (60 + sem[r[0]]), 9), r[0]) for r in some)
        return [(i, lex[i], sem[i]) for _, i in order]

    for k in (1, 7, 40):
        assert [(r.id, r.lex_rank, r.sem_rank) for r in fusion.best(df, k).collect()] == naive(rows)[:k]
    got = {(r.source, r.position): (r.id, r.lex_rank, r.sem_rank) for r in fusion.best(df, 5, "source").collect()}
    assert got == {(s, n): x for s in "xyz" for n, x in enumerate(naive([r for r in rows if r[1] == s])[:5], 1)}
    assert fusion.best(df.limit(0), 3).count() == 0 and fusion.best(df, 5000).count() == 3000


def test_rerank(spark):
    df = spark.createDataFrame([(i, f"text {i}", [float(i), 1.0]) for i in range(30)], "id long, text string, vector array<float>")
    plain = [r.id for r in search.hybrid_search(df, "text", [1.0, 0.0], k=5).collect()]
    asked = []

    def backwards(texts):
        asked.append(texts)
        return range(len(texts) - 1, -1, -1)

    got = search.hybrid_search(df, "text", [1.0, 0.0], k=5, rerank=backwards, depth=8).orderBy("position").collect()
    wide = [r.id for r in search.hybrid_search(df, "text", [1.0, 0.0], k=8).collect()]
    assert [r.id for r in got] == wide[::-1][:5] and asked == [[f"text {i}" for i in wide]]
    for bad in (lambda t: [0] * len(t), lambda t: 1 / 0, lambda t: [0]):
        assert [r.id for r in search.hybrid_search(df, "text", [1.0, 0.0], k=5, rerank=bad, depth=8).orderBy("position").collect()] == plain


def test_query_terms_split_as_texts_do(spark):
    for text in ("x² a_b ½ Été 3,14 naïve①", "日本 ١٢ Ⅷ"):
        assert search.query_terms(text) == one(spark, F.array_distinct(T.tokens(F.lit(text))))


def test_index(spark, tmp_path):
    data, df = vectors(spark)
    corpus = df.withColumns({"text": F.concat(F.lit("word"), F.col("id") % 7, F.lit(" golang "), F.repeat(F.lit("go "), F.col("id").cast("int") % 3)), "lang": F.when(F.col("id") % 2 == 0, "a").otherwise("b")})
    corpus = corpus.unionByName(spark.createDataFrame([(1000, None, None, "a"), (1001, "golang alone", None, None)], "id long, text string, vector array<float>, lang string"))
    ix = index.SearchIndex.build(corpus, f"file://{tmp_path}/ix", rate=20)
    assert index.SearchIndex.exists(spark, f"file://{tmp_path}/ix") and not index.SearchIndex.exists(spark, f"file://{tmp_path}/no")
    assert ix.manifest["n"] == 402 and ix.manifest["lists"] == 20 and ix.warm_up() > 402
    q = data[7].tolist()
    for text, filters in (("go golang", None), ("go golang", {"lang": "b"}), ("", {"lang": "a"}), ("nothing", None)):
        want = [tuple(r) for r in search.text_search(corpus, text, filters, 12, 2).select("id", "bm25").collect()]
        assert [(r.id, r.bm25) for r in ix.text_search(text, filters, 12, 2).collect()] == want
    want = [tuple(r) for r in search.hybrid_search(corpus, "go golang", q, {"lang": "a"}, 9).collect()]
    assert [tuple(r) for r in ix.hybrid("go golang", q, {"lang": "a"}, 9).select("id", "bm25", "cosine", "lex_rank", "sem_rank", "fused").collect()] == want
    exact = [r.id for r in search.knn(df, q, 10).collect()]
    assert [r.id for r in ix.ivf(q, 10, 20).collect()] == exact
    assert [r.id for r in ix.bbq(q, 10, ef=402).collect()] == exact and len({r.id for r in ix.bbq(q, 10).collect()} & set(exact)) >= 5
    many = ix.vector_batch(df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 10)
    for i in (0, 150):
        assert [r.id for r in many.where(f"query_id = {i}").orderBy("rank").collect()] == [r.id for r in search.knn(df, data[i].tolist(), 10).collect()]
    assert ix.hybrid("go", q, k=3, rerank=lambda t: range(len(t) - 1, -1, -1)).count() == 3
    assert index.probe_count(10) == 5 and index.probe_count(400) == 40 and index.probe_count(9999) == 100


def test_bm25_contract(spark):
    df = spark.createDataFrame([(1, "golang tips", "go"), (2, "golang " * 5 + "words", "go"), (3, "python", "py")], "id long, text string, lang string")
    assert [r.id for r in search.text_search(df, "golang").collect()] == [2, 1]
    assert {r.id for r in search.text_search(df, "", {"lang": "go"}).collect()} == {1, 2}
    assert search.text_search(df, "").count() == 3
    assert search.text_search(df.limit(0), "golang").count() == 0


def test_shard_merge(spark):
    rows = [("a", 1, 1, 10.0), ("a", 5, 2, 9.0), ("a", 3, 3, 8.0), ("b", 5, 1, 7.0), ("b", 7, 2, 6.0), ("b", 1, 3, 15.0)]
    got = search.shard_merge(spark.createDataFrame(rows, "shard_id string, id long, rank long, bm25 double"), 5).collect()
    assert got[0].id == 5 and {r.id: r.bm25 for r in got}[1] == 15


def test_metrics(spark):
    rows = [("q", i + 1, r, g) for i, (r, g) in enumerate(zip([True, False, True, False, True], [3, 2, 1, 0, 0], strict=True))] + [("p", i + 1, i == 2, 3 - i) for i in range(4)]
    got = {r.query_id: r for r in evaluate.metrics(spark.createDataFrame(rows, "query_id string, rank int, relevant boolean, grade int"), 3).collect()}
    assert got["q"].recall == pytest.approx(2 / 3, abs=1e-6) and got["p"].mrr == pytest.approx(1 / 3, abs=1e-6) and got["p"].ndcg == 1
    assert evaluate.report(evaluate.metrics(spark.createDataFrame(rows, "query_id string, rank int, relevant boolean, grade int"))).first()["queries"] == 2


def vectors(spark, n=400, dim=32):
    rng = np.random.default_rng(42)
    data = rng.normal(size=(n, dim)) + 3 * rng.integers(0, 5, (n, 1))
    return data, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<float>").cache()


def test_ann_recall_floors(spark):
    data, df = vectors(spark)
    q = data[7].tolist()
    exact = {r.id for r in search.knn(df, q, 10).collect()}
    routed = ann.route(df, 20).cache()
    assert routed.count() == 400 and routed.where("is_centroid").count() == 20
    far = 1 - (data @ data[::20].T) / np.linalg.norm(data, axis=1)[:, None] / np.linalg.norm(data[::20], axis=1)
    assert all(r.centroid_id == 20 * int(np.round(far[r.id], 6).argmin()) for r in routed.where("NOT is_centroid").collect())
    assert len({r.id for r in ann.bbq_search(df, q, 10, ef=100).collect()} & exact) >= 5
    pq = ann.ProductQuantizer.train(df, 32, 8, 16)
    coded = df.join(pq.encoded(df), "id")
    row = coded.select(pq.adc(F.col("codes"), q).alias("a"), V.l2_squared(pq.decode(F.col("codes")), V.literal(q)).alias("b")).limit(20).collect()
    assert all(r.a == pytest.approx(r.b, rel=1e-6, abs=1e-6) for r in row)
    with pytest.raises(ValueError):
        ann.ProductQuantizer.train(df, 32, 5, 16)
    with pytest.raises(ValueError):
        ann.ProductQuantizer.train(df.limit(9), 32, 8, 16)


def test_pq_recall_floor(spark):
    """2,000 vectors of 64 dimensions, 16 sub-spaces of 256 words: half of the ten nearest at least."""
    rng = np.random.default_rng(42)
    data = rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<float>").repartition(4).cache()
    pq = ann.ProductQuantizer.train(df, 64, 16, 256)
    coded, recalls = pq.encoded(df).cache(), []
    for _ in range(8):
        q = rng.normal(size=64)
        exact = set(np.argsort(((data - q) ** 2).sum(axis=1))[:10].tolist())
        recalls.append(len(exact & {r.id for r in pq.search(coded, q.tolist(), 10).collect()}) / 10)
    assert np.mean(recalls) >= 0.5


def test_ring(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    three = {r.k: r.node for r in routing.assign(keys, "k", routing.ring(spark, ["a", "b", "c"])).collect()}
    four = {r.k: r.node for r in routing.assign(keys, "k", routing.ring(spark, ["a", "b", "c", "d"])).collect()}
    assert len(three) == 3000 and all(four[k] in (n, "d") for k, n in three.items())
    arcs = [tuple(r) for r in routing.ring(spark, ["a", "b", "c"]).collect()]
    assert len(set(routing.replicas(["a", "b", "c"], 12345, arcs, 5))) == 3


def test_lifecycle(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "u1"), (2, None, "u2"), (3, "b", "u3")], "id long, lang string, url string")
    assert {r.id for r in lifecycle.delete_where(df, {"lang": "a"}).collect()} == {2, 3}
    with pytest.raises(ValueError):
        lifecycle.delete_where(df, {})
    snap = lifecycle.Snapshots(spark, f"file://{tmp_path}/s")
    snap.save(df.withColumn("shard_id", F.col("id") % 2))
    assert snap.save(df.limit(2).withColumn("shard_id", F.lit(0)))["doc_count"] == 2 and snap.load().count() == 2
    c = lifecycle.Catalog()
    c.create("x", "t1", {"dim": 0, "rate": 5})
    assert c.resolved("x", {"dim": 8, "rate": 9}) == {"dim": 8, "rate": 5}
    c.update("x", "t1", status="paused")
    for bad in (lambda: c.get("x", "t2"), lambda: c.create(".."), lambda: c.create("x"), lambda: c.delete("_default"), lambda: c.update("x", status="error")):
        with pytest.raises((KeyError, ValueError)):
            bad()
    c.delete("x")
    assert [r["id"] for r in c.list()] == ["_default"]
    assert lifecycle.Catalog([{"id": "old", "status": "deleting"}]).list()[0]["id"] == "_default"


def test_chunkers():
    assert len(chunking.split_sentences("Dr. Smith lives in the U.S. and pays 3.14 dollars.")) == 1
    assert chunking.split_sentences("One. Two! Three?") == ["One.", "Two!", "Three?"]
    assert chunking.split_sentences("  ") == []
    assert len(chunking.syntax_chunks("def a():\n  def b(): pass\n\nclass C:\n  def m(self): pass\n\nasync def d(): pass\nx = 1")) == 3
    assert chunking.syntax_chunks("x = 1") == [] == chunking.syntax_chunks("def (")
    assert len(chunking.syntax_chunks("package m\nfunc A() {\n if x { y() }\n}\ntype T struct {\n a int\n}\n", "go")) == 2


def test_html():
    page = "<html><head><title>t</title><script>x</script></head><body><nav><a href='/n'>n</a></nav><h1>Hi</h1><p>A <b>bold</b> <a href='http://x.org/a'>link</a></p><a href='/rel'>r</a><a href='mailto:a@b'>m</a><a href='#f'>f</a><a href='ftp://z/'>z</a><div class='ad-banner'>buy <div>x</div></div><p>end"
    text, hrefs = html.convert(page)
    assert text.startswith("# Hi") and "**bold**" in text and "buy" not in text and text.endswith("end") and "[link](http://x.org/a)" in text
    assert html.resolve(hrefs) == ["http://x.org/a"]
    assert html.resolve(hrefs, "https://b.org/d/") == ["http://x.org/a", "https://b.org/rel", "ftp://z/"]
    assert html.convert(None) == ("", []) and html.convert("<p><div></p") [1] == []


def test_highlight(spark):
    text = "start " + "filler " * 80 + "needle in a haystack " + "filler " * 80
    got = one(spark, T.highlight(F.lit(text), "Needle"))
    assert len(got) == 1 and "<mark>needle</mark>" in got[0] and got[0].startswith("...") and got[0].endswith("...")
    assert one(spark, T.highlight(F.lit(""), "x")) == [] and one(spark, T.highlight(F.lit("short"), "x")) == ["short"]


def test_suggest_and_spelling(spark):
    docs = spark.createDataFrame([("t1", "alpha", "alphabet alphabet"), ("t2", "alpine", "x")], "tenant string, title string, text string")
    d = lexicon.suggest_dictionary(docs)
    assert [r.term for r in lexicon.suggest(d, "AL", "t1").collect()] == ["alpha", "alphabet"]
    assert {r.term for r in lexicon.suggest(d, "al").collect()} == {"alpha", "alphabet", "alpine"}
    words = spark.createDataFrame([(0, "alphabett"), (1, "zzz"), (2, "alphabet")], "pos long, word string")
    fixed = lexicon.spell_candidates(words, lexicon.spell_dictionary(docs))
    assert lexicon.spell_suggest(fixed).first()[0] == "alphabet  alphabet"


def pages_fetch(pages):
    iters = {k: iter(v) for k, v in pages.items()}
    return lambda path, params: next(iters[path])


def test_connectors(spark):
    slack = connectors.Slack({"channels": "c"}, pages_fetch({
        "/conversations.history": [{"messages": [{"ts": "3", "text": "root", "reply_count": 1}, {"ts": "2", "subtype": "channel_join"}], "response_metadata": {"next_cursor": "n"}}, {"messages": [{"ts": "1", "text": "old"}]}],
        "/conversations.replies": [{"messages": [{"ts": "3", "text": "root"}, {"ts": "4", "text": "answer"}]}],
    }))
    state = {}
    got = []
    assert connectors.sync(slack, "c", state, got.extend, collection="k") == 2
    assert got[0].content == "root\n---\nanswer" and state == {"c": "3"} and got[0].metadata["_collection_id"] == "k"
    jira = connectors.Jira({"base_url": "https://j", "project": "P"}, pages_fetch({"/rest/api/3/search": [{"issues": [{"key": "P-1", "fields": {"summary": "S", "updated": "2024", "description": {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "body"}]}]}, "comment": {"comments": [{"body": "note"}]}}}]}]}))
    assert [r.content for r in jira.read("issues", None)] == ["# S\n\nbody\n\nnote"] and jira.query("x").endswith('updated > "x" ORDER BY updated ASC')
    drive = connectors.Drive({}, pages_fetch({"/changes": [{"changes": [{"fileId": "f", "removed": True}]}]}))
    assert [r.action for r in drive.read("files", "tok")] == ["delete"]
    sf = connectors.Salesforce({"base_url": "b", "object": "Account", "fields": "Name"}, pages_fetch({"/services/data/query": [{"records": [{"Id": "1", "Name": "n", "SystemModstamp": "t"}], "nextRecordsUrl": "/more"}], "/more": [{"records": []}]}))
    assert [r.content for r in sf.read("Account", None)] == ["Name: n"] and "WHERE SystemModstamp > c" in sf.query("c")
    sp = connectors.SharePoint({"drives": "d"}, pages_fetch({"/drives/d/root/delta": [{"value": [{"id": "1", "deleted": {}}, {"id": "2", "folder": {}}]}]}))
    assert [(r.id, r.action) for r in sp.read("d", None)] == [("1", "delete")]
    conf = connectors.Confluence({"base_url": "b"}, pages_fetch({"/api/v2/pages": [{"results": [{"id": 1, "title": "T", "createdAt": "2"}, {"id": 2, "title": "U", "createdAt": "1"}]}]}))
    assert [r.id for r in conf.read("pages", "1")] == ["1"]
    tw = connectors.Twitter({"users": "u", "searches": "a b", "lists": "7"}, pages_fetch({"/users/u/tweets": [{"data": [{"id": "9", "text": "a"}, {"id": "10", "text": "b"}]}], "/tweets/search/recent": [{}], "/lists/7/tweets": [{"data": [{"id": "3", "text": "c"}]}]}))
    state = {}
    assert tw.streams() == ["timeline:u", "search:a b", "list:7"]
    assert [connectors.sync(tw, s, state, lambda r: None) for s in tw.streams()] == [2, 0, 1]
    assert state == {"timeline:u": "10", "search:a b": None, "list:7": "3"}
    with pytest.raises(ValueError):
        connectors.sync(connectors.Jira({}, None), "issues", {}, print)
    answers = iter([(500, {}), (401, {}), (200, {"ok": 1})])
    assert connectors.with_retry(lambda: next(answers), sleep=lambda s: None) == {"ok": 1}
    connectors.register(spark)
    rows = spark.read.format("connector").option("kind", "twitter").option("users", "u").option("pages", '{"/users/u/tweets": [{"data": [{"id": "1", "text": "x"}]}]}').load().collect()
    assert [(r.id, r.content) for r in rows] == [("1", "x")]
    with pytest.raises(ValueError):
        relational.identifier("a;drop")


def test_object_source(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello")
    (tmp_path / "b.bin").write_text("x" * 100)
    got = relational.read_objects(spark, str(tmp_path), ["txt"]).collect()
    assert [r.mime_type for r in got] == ["text/plain"]
    assert relational.read_objects(spark, str(tmp_path), max_bytes=50).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(i, f"u{i % 7}", 1_700_000_000 + i * 3) for i in range(60)]
    spark.createDataFrame(rows, "id long, domain string, t long").selectExpr("id", "domain", "timestamp_seconds(t) ts").coalesce(1).write.parquet(str(src))
    schema = "id long, domain string, ts timestamp"
    stream = spark.readStream.schema(schema).parquet(str(src))
    limited = ingest.rate_limited(stream, "domain", "ts", 2, 60.0, "id")
    limited.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    batch = ingest.rate_limited_batch(spark.read.parquet(str(src)), "domain", "ts", 2, 60.0, "id")
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, batch.collect()))
    first = ingest.idempotent(spark.readStream.schema(schema).parquet(str(src)), "domain", "ts")
    first.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("firsts").count() == 7
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "x.txt").write_text('{"url": "a", "content": "t", "metadata": {"_collection_id": "k"}}\n{broken\n{"url": "b", "content": ""}\n')
    good, bad = [], []
    q = ingest.start(spark.readStream.text(str(raw)), str(tmp_path / "c3"), lambda df, i: good.extend(df.collect()), lambda df, i: bad.extend(df.collect()))
    q.awaitTermination()
    assert [(r.url, r.collection_id) for r in good] == [("a", "k")] and sorted(r.error for r in bad) == ["empty", "undecodable"]


def test_admission():
    flags, _ = ingest.admit([0, 1, 2, 10, 10.5, 11], [], 2, 10)
    assert flags == [True, True, False, True, False, True]


def test_embedders(spark):
    texts = ["", "a", "Été ☃", None, "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    hashed = embed.HashEmbedder(12)
    got = [r.vector for r in embed.embedded(df, hashed).orderBy("id").collect()]
    assert np.allclose(got, hashed.embed_batch([t or "" for t in texts]), atol=1e-6) and np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-5)
    asked, answers = [], iter([(503, {})])

    def post(url, body, head):
        failed = next(answers, None)
        if failed:
            return failed
        asked.append(body["input"])
        return 200, {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}

    service = embed.HttpEmbedder("http://e", "m", 2, "key", batch=2, post=post)
    assert service.embed_batch(["x", "yy", "zzz"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and asked == [["x", "yy"], ["zzz"]]
    with pytest.raises(ValueError):
        embed.HttpEmbedder("http://e", "m", 3, post=post).embed("x")
    assert len({tuple(v) for v in embed.HashEmbedder(64).embed_batch([f"t{i}" for i in range(50)])}) == 50


def engine_of(spark, root, **options):
    return Engine(spark, Config(f"file://{root}", embed.HashEmbedder(8), max_tokens=4, **options), clock=lambda: 1000)


def test_engine_ingests_searches_and_forgets(spark, tmp_path):
    e = engine_of(spark, tmp_path, hooks={"before_chunk": [lambda t: F.replace(t, F.lit("secret"), F.lit("***"))], "before_index": [F.upper]})
    rows = [("a", "one two three four five secret", {"_tenant": "forged"}, 1, "c1"), ("b", "six seven", None, 1, "c2"), ("a", "older text", None, 0, "c1"), ("p", "<p>page <b>text</b></p><nav>n</nav>", {"mime_type": "text/html"}, 1, "c2")]
    df = spark.createDataFrame(rows, "url string, content string, metadata map<string,string>, crawled_at long, collection_id string")
    e.ingest(df, "acme", ("s", 4))
    e.ingest(df.where("url = 'none'"), "acme", ("s", 3))
    got = sorted((r.url, r.chunk_idx, r.text, r.tenant, r.metadata["_tenant"]) for r in e.chunks.read().collect())
    assert got == [("a", 0, "ONE TWO THREE FOUR", "acme", "acme"), ("a", 1, "FIVE ***", "acme", "acme"), ("b", 0, "SIX SEVEN", "acme", "acme"), ("p", 0, "PAGE **TEXT**", "acme", "acme")]
    for c in ("c1", "c2"):
        e.catalog.create(c, "acme")
    e.catalog.store(spark, f"file://{tmp_path}/catalog")
    e.catalog.set_alias("all", ["c1", "c2"], {"lang": "en"})
    e.catalog.set_alias("all", ["c2"], {"lang": "en"})
    e.catalog.store(spark, f"file://{tmp_path}/catalog")
    again = engine_of(spark, tmp_path).catalog
    assert again.resolve_alias("all", {"lang": "de"}) == (["c2"], {"lang": "de"}) and len(again.list("acme")) == 2
    found = e.search("seven", 2, "acme")
    assert found["total"] == 2 and found["results"][0]["bm25"] > 0 and e.search("seven", 2, "acme", offset=1, page=5)["results"] == found["results"][1:]
    assert e.stats()["cache_hits"] == 1 and e.search("seven", 2, "other")["total"] == 0
    assert {r["collection_id"] for r in e.search("seven two", 5, "acme", ["c1", "c2", "gone"])["results"]} == {"c1", "c2"}
    assert len(e.search("seven", 5, "acme", ["c2"])["results"]) == 2
    with pytest.raises(KeyError):
        e.search("seven", collections=["gone"])
    rag = e.rag("seven", 1)
    assert rag["context"] == "[1] SIX SEVEN" and len(rag["citations"]) == 1
    assert e.delete_where({"url": "b"}) == 1 and e.delete_where({"url": "b"}) == 0 and e.search("seven", 9, "acme")["total"] == 3
    assert e.delete_ids(e.chunks.read().where("chunk_idx = 1").select("id"), {"collection_id": "c1"}) == 1 and e.stats()["chunks"] == 2
    assert e.chunks.vacuum() > 0 and e.stats()["chunks"] == 2
    with pytest.raises(ValueError):
        e.delete_where({})


@pytest.mark.parametrize("chunker", ["semantic", "syntax"])
def test_engine_chunkers(spark, tmp_path, chunker):
    e = engine_of(spark, tmp_path, chunker=chunker, threshold=2.0)
    text = "One here. Two there. Three." if chunker == "semantic" else "def a():\n  pass\nx = 1\nclass B:\n  pass"
    e.ingest(spark.createDataFrame([("u", text, None, 1, "c"), ("v", "", None, 1, "c")], "url string, content string, metadata map<string,string>, crawled_at long, collection_id string"))
    want = ["One here.", "Two there.", "Three."] if chunker == "semantic" else ["def a():\n  pass", "class B:\n  pass"]
    assert [r.text for r in e.chunks.read().orderBy("chunk_idx").collect()] == want


def test_stream_equals_batches(spark, tmp_path):
    """Records of two files, one of them read again after its batch was taken in, give what one batch gives."""
    src, listener = tmp_path / "in", ingest.Progress()
    src.mkdir()
    spark.streams.addListener(listener)
    e = engine_of(spark, tmp_path / "e")
    lines = [json.dumps({"url": f"u{i % 6}", "content": f"text number {i} and more words", "crawled_at": i}) for i in range(12)]
    for n, part in enumerate((lines[:7] + ["{broken"], lines[7:] + ['{"url": "x", "content": ""}'])):
        (src / f"{n}.txt").write_text("\n".join(part))
        stream = spark.readStream.text(str(src))
        e.stream(stream, str(tmp_path / "cp"), "feed", "acme").awaitTermination()
    raw = spark.createDataFrame([(x,) for x in ["{broken"]], "value string")
    e.ingest_raw(raw, "acme", ("feed", 1))
    b = engine_of(spark, tmp_path / "b")
    b.ingest(ingest.parse(spark.createDataFrame([(x,) for x in lines], "value string")).drop("error", "value"), "acme")
    columns = ["collection_id", "url", "chunk_idx", "text", "tenant", "crawled_at"]
    assert sorted(map(tuple, e.chunks.read().select(columns).collect())) == sorted(map(tuple, b.chunks.read().select(columns).collect()))
    dead = spark.read.json(f"file://{tmp_path}/e/dead/*")
    assert sorted(r.error for r in dead.collect()) == ["empty", "undecodable"] or dead.count() >= 2
    deadline = time.time() + 20
    while listener.rows.get("feed", 0) < 14 and time.time() < deadline:
        time.sleep(0.2)
    assert listener.rows["feed"] == 14 and listener.last["feed"]["lag"] == 0
    spark.streams.removeListener(listener)


def test_versions_detect_damage(spark, tmp_path):
    t = versions.VersionedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], buckets=4)
    t.replace(None, spark.createDataFrame([(i, "a") for i in range(9)], "k long, v string"))
    t.replace(spark.createDataFrame([(1,), (None,)], "k long"), spark.createDataFrame([(1, "b"), (None, "n")], "k long, v string"), ("s", 1))
    t.replace(spark.createDataFrame([(None,)], "k long"), None, ("s", 2))
    assert sorted(map(str, t.read().collect())) == sorted(str(Row(k=i, v="b" if i == 1 else "a")) for i in range(9)) and t.manifest()["version"] == 3
    assert t.replace(spark.createDataFrame([(2,)], "k long"), None, ("s", 2))["version"] == 3 and t.read().count() == 9
    t.snapshot("s")
    for p in (tmp_path / "t/snapshots/s/manifest").glob("part*"):
        p.write_text(p.read_text().replace('"crc":', '"crc":1'))
    for p in (tmp_path / "t/snapshots/s/manifest").glob(".*.crc"):
        p.unlink()
    with pytest.raises(versions.Damaged):
        t.restore("s")


def test_result_cache():
    now = [0.0]
    c = ResultCache(2, 10, lambda: now[0])
    c.put("a", 1), c.put("b", 2), c.get("a"), c.put("c", 3)
    assert (c.get("a"), c.get("b"), c.get("c"), c.hits, c.misses) == (1, None, 3, 3, 1)
    now[0] = 11
    assert c.get("a") is None


def test_connectors_keep_the_cursor_of_the_service(tmp_path):
    calls = []

    def fetch(pages):
        answers = {k: iter(v) for k, v in pages.items()}

        def run(path, params):
            calls.append((path, params.get("pageToken")))
            return next(answers[path])

        return run

    file = {"id": "f", "mimeType": "text/plain", "modifiedTime": "2024-01-01T00:00:00Z"}
    jobs, got = connectors.Jobs(str(tmp_path / "jobs.json"), lambda: clock[0]), []
    clock = [100.0]
    first = connectors.Drive({}, fetch({"/changes/startPageToken": [{"startPageToken": "t1"}], "/files": [{"files": [file]}], "/files/f": [{"text": "x"}]}))
    assert jobs.due("d", 60) and jobs.run("d", first, got.extend) == 1 and not jobs.due("d", 60) and not jobs.due("d")
    second = connectors.Drive({}, fetch({"/changes": [{"changes": [{"fileId": "g", "removed": True}], "nextPageToken": "p2"}, {"changes": [], "newStartPageToken": "t2"}]}))
    clock[0] = 160.0
    assert jobs.due("d", 60)
    again = connectors.Jobs(str(tmp_path / "jobs.json"), lambda: clock[0])
    assert again.run("d", second, got.extend) == 1 and [r.action for r in got] == ["upsert", "delete"]
    assert calls[-2:] == [("/changes", "t1"), ("/changes", "p2")] and again.state["d"]["cursors"] == {"files": "t2"} and again.state["d"]["status"] == "done"
    with pytest.raises(KeyError):
        again.run("d", connectors.Drive({}, fetch({})), got.extend)
    assert connectors.Jobs(str(tmp_path / "jobs.json")).state["d"]["cursors"] == {"files": "t2"} and again.state["d"]["status"] == "failed"
    state = {}
    sp = connectors.SharePoint({"drives": "d"}, fetch({"/drives/d/root/delta": [{"value": [], "@odata.nextLink": "/next"}], "/next": [{"value": [], "@odata.deltaLink": "/delta?token=1"}]}))
    connectors.sync(sp, "d", state, got.extend)
    connectors.sync(connectors.SharePoint({"drives": "d"}, fetch({"/delta?token=1": [{"value": [{"id": "1", "deleted": {}}], "@odata.deltaLink": "/delta?token=2"}]})), "d", state, got.extend)
    assert state == {"d": "/delta?token=2"}
    conf = connectors.Confluence({"base_url": "b"}, pages_fetch({"/api/v2/pages": [{"results": [{"id": 1, "title": "T"}]}]}))
    assert [r.emitted_at for r in conf.read("pages", None)] == [""] and conf.discover()[0]["stream"] == "pages" and conf.spec()["required"] == ["base_url"]
    waits = []
    pace = connectors.Pacer(2, lambda: 5.0, waits.append)
    pace.wait(), pace.wait(), pace.wait()
    assert waits == [0.5, 1.0]


def test_jdbc_options():
    assert relational.jdbc_options("jdbc:mysql://h/d", "t")["dbtable"] == "`t`" and relational.jdbc_options("jdbc:postgresql://h/d", "t")["dbtable"] == '"t"'
    whole = dict(partitionColumn="id", lowerBound="0", upperBound="9", numPartitions="3")
    assert relational.jdbc_options("jdbc:x:y", "t", **whole)["numPartitions"] == "3"
    with pytest.raises(ValueError):
        relational.jdbc_options("jdbc:x:y", "t", partitionColumn="id")


def test_addresses(spark):
    cases = {"8.8.8.8": False, "192.88.99.1": False, "10.1.2.3": True, "256.1.1.1": True, "1.2.3": True, "": True, "2606:4700::1111": False, "::1": True, "::": True, "fe80::1%eth0": True, "fd00::1": True, "ff02::1": True, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "[2001:db8::1]": False, "x::y": True}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "ip string")
    assert {r.ip: r.b for r in df.select("ip", network.blocked_address(F.col("ip")).alias("b")).collect()} == {**cases, None: True}


def test_changes_that_repeat_or_tie(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "id long, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (4, "z", 1)], "id long, v string, n int")
    got = lifecycle.upsert(old, new, order=[F.col("n")]).collect()
    assert sorted((r.id, r.v) for r in got) == [(1, "y"), (2, "old"), (3, "old"), (4, "z")]
    assert lifecycle.upsert(old, new.drop("n")).count() == 4
    rows = [(1, "a", "upsert", 5, 1), (1, "a", "delete", 5, 2), (2, "b", "delete", 5, 1), (2, "b", "upsert", 5, 2)]
    changes = spark.createDataFrame(rows, "id long, v string, action string, emitted_at long, arrival long")
    assert sorted((r.id, r.v) for r in lifecycle.apply_changes(old, changes).collect()) == [(2, "b"), (3, "old")]
    assert sorted((r.id, r.v) for r in lifecycle.apply_changes(old, changes.drop("arrival")).collect()) == [(3, "old")]


def test_crawl(spark, tmp_path):
    def get(url):
        n = int(url.rsplit("/", 1)[1])
        if n == 4:
            return 404, "", b""
        if n == 5:
            raise OSError("no route")
        if n == 6:
            return 200, "text/plain", b"plain"
        return 200, "text/html", f"<h1>Page {n}</h1><a href='/{2 * n + 1}#x'>l</a><a href='{2 * n + 2}'>r</a><a href='http://other.org/1'>o</a><a href='http://bad.org/1'>b</a>".encode()

    seeds = spark.createDataFrame([("http://site.org/0",), ("http://site.org/0#top",), ("nonsense",)], "url string")
    resolve = lambda host: ["10.0.0.1"] if host == "other.org" else ["8.8.8.8"]
    rows = crawl.crawl(seeds, get, resolve, rounds=4, most=9, blocked=["bad.org"]).collect()
    got = {r.url.removeprefix("http://site.org/"): r for r in rows}
    assert len(rows) == 9 and {k: r.round for k, r in got.items()} == {"0": 0, "1": 1, "2": 1, "http://other.org/1": 1, "3": 2, "4": 2, "5": 2, "6": 2, "7": 3}
    assert got["0"].text.startswith("# Page 0") and got["4"].error == "status 404" and got["5"].error == "no route" and got["6"].text == "plain" and got["http://other.org/1"].error == "blocked address"
    only = crawl.crawl(seeds, get, resolve, rounds=2, allowed=["site.org"]).collect()
    assert sorted(r.url for r in only) == ["http://site.org/0", "http://site.org/1", "http://site.org/2"]
    with pytest.raises(OSError):
        crawl.addresses("no such host.invalid")


def test_plugins_are_found(monkeypatch):
    class Point:
        name = "extra"

        def load(self):
            return connectors.Slack

    monkeypatch.setattr(connectors, "entry_points", lambda group: [Point()] if group == "rankweave.connectors" else [])
    monkeypatch.setattr(connectors, "REGISTRY", dict(connectors.REGISTRY))
    connectors.load_plugins()
    assert connectors.REGISTRY["extra"] is connectors.Slack


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_recall_of_lists_and_codes(spark):
    """Rows with id divisible by 50 as queries against all rows, the query itself counted."""
    from rankweave.plans import registry

    d = "/root/testdata/sf0.01"
    ix, exact = registry.vector_index_of(spark, d), {}
    for r in registry.batch_knn(spark, d).collect():
        exact.setdefault(r.query_id, set()).add(r.id)
    asked = {r.id: list(r.vector) for r in registry.vectors_of(spark, d).where("id % 50 = 0").collect()}
    for search_one in (lambda v: ix.ivf(v, 10), lambda v: ix.bbq_share(v, 10)):
        assert np.mean([len(exact[i] & {r.id for r in search_one(v).collect()}) / 10 for i, v in asked.items()]) >= 0.9


def test_alias_search_and_sweeps(spark, tmp_path):
    e = engine_of(spark, tmp_path)
    rows = [(f"u{i}", f"needle {i}" if i % 3 == 0 else f"other {i}", {"_ttl": "10s"} if i > 7 else None, 1, "abc"[i % 3 - 1]) for i in range(9)]
    e.ingest(spark.createDataFrame(rows, "url string, content string, metadata map<string,string>, crawled_at long, collection_id string"), "t")
    e.catalog.set_alias("two", ["a", "c"], {"tenant": "t"})
    found = e.search_alias("needle", "two", 4)
    index = {r["id"]: r["collection_id"] for r in e.refresh().table("cards").collect()}
    assert len(found) == 4 and {index[r["id"]] for r in found} == {"a", "c"} and max(r["bm25"] for r in found) > 0
    assert e.search_alias("needle", "two", 4, {"tenant": "none"}) == []
    e.clock, stopped = (lambda: 2000), Event()
    stopped.set()
    assert e.sweep_until(stopped, 0.01) == 1 and e.stats()["chunks"] == 8


def test_object_store(spark, tmp_path):
    store = shared.ObjectStore(spark, f"file://{tmp_path}/objects", cache_bytes=5)
    store.put("a/one", b"123"), store.put("b", b"\x00\xff45"), store.put("big", b"x" * 9)
    assert list(store.cache) == ["b"] and store.get("a/one") == b"123" and store.get("big") == b"x" * 9 and list(store.cache) == ["a/one"]
    assert store.list() == ["a/one", "b", "big"] and store.list("a/") == ["a/one"] and store.get("b") == b"\x00\xff45"
    store.delete("b")
    with pytest.raises(FileNotFoundError):
        store.get("b")
    for bad in ("", "/x", "../x"):
        with pytest.raises(ValueError):
            store.get(bad)
