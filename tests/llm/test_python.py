import hashlib
import random
import tarfile
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from rankweave.llm import arrays, html_text, media, near_dedup, packing, quality


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute_classes(rows):
    sets = [brute_shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    margin = 1.0
    for i in range(len(rows)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            margin = min(margin, abs(s - 0.8))
            if s >= 0.8:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def near_rows(seed, groups=12, size=14):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def partition_of(pairs):
    groups = defaultdict(set)
    for k, v in pairs:
        groups[v].add(k)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    rows = near_rows(seed) + [(900, ""), (901, None), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert partition_of((r.doc_id, r.class_id) for r in got) == partition_of(zip((r[0] for r in rows), brute_classes(rows), strict=True))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(200)] = f"x{i}-{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_pairs_inside_a_large_family_of_templates(spark):
    """Background similarity 146 / 196; 60 pairs are told apart from the family by 12 shingles."""
    template = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(300):
        twin = [f"p{i // 2}-{k}" for k in range(12)] if i < 120 else []
        rows.append((i, " ".join(template + twin + [f"x{i}-{k}" for k in range(25 - len(twin))])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert partition_of((r.doc_id, r.class_id) for r in got) == partition_of(zip((r[0] for r in rows), brute_classes(rows), strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_star_of_a_template_is_one_class(spark, seed):
    """300 texts of similarity 0.878 to one template and under 0.8 to each other: the template links them all."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(6000)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        words = list(base)
        for at in rng.sample(range(1199), 78):
            words[5 * at + 2] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    sets = [brute_shingles(t) for _, t in rows[:20]]
    assert all(0.87 < len(s & sets[0]) / len(s | sets[0]) < 0.89 for s in sets[1:])
    assert all(len(s & t) / len(s | t) < 0.8 for i, s in enumerate(sets[1:]) for t in sets[1 : i + 1])
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_near_dedup_tells_rows_of_one_doc_id_apart(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one, "x"), (1, two, "y"), (2, one, "z"), (3, two, "z"), (1, one, "w"), (None, two, "v"), (4, thue_morse(11)[0], ""), (5, thue_morse(11)[1], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.text[:1], len(r.text)) for r in near_dedup.near_dedup(df).collect())
    assert got == sorted([(1, "a", len(one)), (1, "b", len(two)), (4, "a", 2048), (5, "b", 2048)])
    report = near_dedup.near_duplicates(df).collect()
    assert sum(r.kept for r in report) == 4 and sorted(r.class_size for r in report) == [1, 1, 3, 3, 3, 3, 3, 3]
    named = near_dedup.near_duplicates(df.select(F.concat(F.lit("n"), F.col("doc_id")).alias("doc_id"), "text")).collect()
    assert sum(r.kept for r in named) == 4


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n if n else None for n in (0, 5, 100, 3, 0, 40, 41, 1)], "n": list(range(8))})
    parts = list(arrays.slices([batch, batch.slice(0, 0)], "text", 50))
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(8))
    assert all(p.num_rows <= 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 50 for p in parts)


def test_block_links_match_brute_force(monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 130, 220).astype(np.uint64)) for _ in range(40)]
    common = near_dedup._common(sets[:15], sets[15:])
    assert common.tolist() == [[len(np.intersect1d(s, t)) for t in sets[15:]] for s in sets[:15]]


def test_near_dedup_odd_rows(odd, odd_rows, empty):
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns
    report = near_dedup.near_duplicates(odd).collect()
    assert len(report) == len(odd_rows) and kept.count() == sum(r.kept for r in report)
    assert near_dedup.near_dedup(empty).count() == near_dedup.near_duplicates(empty).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, 80, dtype=np.uint64) for _ in range(80)]
    a = [rng.uniform(0.2, 9, 80) for _ in sets]
    b = [w * rng.uniform(0.5, 1.6, 80) for w in a]
    truth = np.mean([np.minimum(x, y).sum() / np.maximum(x, y).sum() for x, y in zip(a, b, strict=True)])
    found = (near_dedup.dart_signatures(sets, a) == near_dedup.dart_signatures(sets, b)).mean()
    assert abs(found - truth) < 0.02
    assert (near_dedup.dart_signatures(sets) == near_dedup.dart_signatures(sets, [np.ones(80)] * 80)).mean() < 1.01


def noisy(rng, good):
    words = [rng.choice(["river", "stone", "walk", "light", "house", "green", "over"]) for _ in range(rng.randint(5, 200))]
    return " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)


def test_quality_learns_and_keeps_the_fold_out(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, noisy(rng, i % 4 > 0), i % 4 > 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.1), (7777, "", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows] + [(3, None), (3, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == len(held) + (zlib.crc32(b"7777") % 5 == 0)
    assert np.mean([got[i].predicted == (i % 4 > 0) for i in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values())
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_scores_cover_whole_texts():
    rng = random.Random(6)
    texts = [noisy(rng, i % 2) for i in range(200)]
    net = quality.fit(texts, np.array([float(i % 2) for i in range(200)]), epochs=6)
    alone = [quality.score_texts(net, [t])[0] for t in texts]
    assert np.allclose(alone, quality.score_texts(net, texts, block=3000))
    long = "river stone walk " * 3000
    assert quality.score_texts(net, [long])[0] != quality.score_texts(net, [long + "RIVER!! STONE!! " * 50])[0]


def naive_score(net, text):
    """Filters slid over every chunk one window at a time."""
    raw = (text or "").encode()
    chunks = 1 + max(0, -(-(len(raw) - quality.CHUNK) // quality.HOP))
    raw = raw.ljust(quality.CHUNK + quality.HOP * (chunks - 1) + quality.WIDTH, b"\0")
    features = []
    for c in range(chunks):
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK, quality.STEP):
            window = raw[c * quality.HOP + at :][: quality.WIDTH]
            best = np.maximum(best, sum(net.embedding[b] @ net.weights[k] for k, b in enumerate(window)))
        features.append(np.maximum(best + net.bias, 0))
    z = net.out @ np.concatenate((np.mean(features, axis=0), np.max(features, axis=0))) + net.shift[0]
    return 1 / (1 + np.exp(-z))


def test_scores_match_naive_convolution(monkeypatch):
    rng = random.Random(8)
    texts = [noisy(rng, i % 2) for i in range(60)]
    net = quality.fit(texts, np.array([float(i % 2) for i in range(60)]), epochs=4)
    tried = ["", None, "a", "é" * 300, "x" * 512, "x" * 513, *texts[:5], " ".join(texts[:4])]
    monkeypatch.setattr(quality, "PIECE", 2 * quality.SEGMENT)
    assert np.allclose(quality.score_texts(net, tried, block=2000), [naive_score(net, t) for t in tried], atol=1e-5)


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    net = quality.Network.fresh(rng)
    net.out[:] = rng.normal(size=net.out.shape)
    docs = [rng.integers(32, 120, (n, quality.CHUNK + quality.REACH)).astype(np.uint8) for n in (1, 3, 2)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0
        for d, y in zip(docs, labels, strict=True):
            table = net.embedding @ net.weights
            windows = sum(table[p][d[:, p : p + quality.CHUNK : quality.STEP]] for p in range(quality.WIDTH)).max(axis=1)
            f = np.maximum(windows + net.bias, 0)
            p = 1 / (1 + np.exp(-(net.out @ np.concatenate((f.mean(axis=0), f.max(axis=0))) + net.shift[0])))
            total -= (y * np.log(p) + (1 - y) * np.log(1 - p)) / len(docs)
        return total + 0.5e-4 * (net.out**2).sum()

    for p, g in zip(net.parameters(), quality._gradient(net, docs, labels), strict=True):
        for at in rng.integers(0, p.size, 6):
            flat, old = p.reshape(-1), p.reshape(-1)[at]
            flat[at] = old + 1e-6
            up = loss()
            flat[at] = old - 1e-6
            down = loss()
            flat[at] = old
            assert (up - down) / 2e-6 == pytest.approx(g.reshape(-1)[at], abs=2e-4)


def test_labelled_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i} " * (1 + i % 9)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    texts, marks = quality.labelled_sample(docs, labels)
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(50)) and texts == quality.labelled_sample(docs.repartition(5), labels)[0]
    few, _ = quality.labelled_sample(docs, labels, most_bytes=300)
    assert 0 < sum(map(len, few)) <= 300 and set(few) <= set(texts)
    assert len(quality.labelled_sample(docs, labels, most=7)[0]) == 7


def test_media_round_trip(spark, odd, odd_rows, empty, tmp_path):
    rows = media.store_media(odd, str(tmp_path), shard_bytes=4000).collect()
    want = defaultdict(list)
    for i, t, *_ in odd_rows:
        raw = (t or "").encode()
        want[i].append((len(raw), hashlib.sha256(raw.ljust(max(192, -(-len(raw) // 192) * 192))).hexdigest()))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_bytes, r.payload_sha256))
        with open(r.shard, "rb") as f:
            f.seek(r.offset)
            image = f.read(r.media_bytes)
        payload = media.from_png(image)
        assert hashlib.sha256(image).hexdigest() == r.media_sha256 and len(payload) == r.payload_bytes == r.width * r.height
        assert zlib.crc32(payload[-16:]) == r.tail_crc32
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({r.shard for r in rows}) > 3
    for shard in {r.shard for r in rows}:
        names = tarfile.open(shard).getnames()
        assert set(names) == {f"{r.media_sha256}.png" for r in rows if r.shard == shard} and len(names) == len(set(names))
    assert media.store_media(empty).count() == 0


def test_tokenizer_equals_library():
    tok = packing.BatchTokenizer(packing.default_tokenizer())
    rng = random.Random(1)
    texts = ["it's John's 'tis we'll don't  they've'd  \n\n a\tb 12'34 'll  ''s", "", " ", "\n", "<|endoftext|> x", "☃ snow's", "a" * 5000, "x" + " " * 3000]
    texts += ["".join(rng.choice("ab '\n\tstrevlmd1.é   ­\u0085\x00\x7f") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    assert [x.tolist() for x in tok(texts)] == [e.ids for e in tok.slow.encode_batch(texts, add_special_tokens=False)]


def test_tokenizer_with_long_texts_and_other_scripts(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 300)
    rng = random.Random(2)
    letters = "ab1 '\n\t.,—’“”é☃жщ漢字ไทย\u3000\u2009\u180e٣½ⅷ\u0301\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(400)]
    texts += [" ".join(rng.choice(["it's", "we'll", "12", "x\n", "  y", "don’t"]) for _ in range(300)) for _ in range(20)]
    tok = packing.BatchTokenizer(packing.default_tokenizer(), keep=200)
    assert [x.tolist() for x in tok(texts)] == [e.ids for e in tok.slow.encode_batch(texts, add_special_tokens=False)]
    long = " ".join(texts[-20:])
    assert "".join(packing.segments(long, 50)) == long and max(map(len, packing.segments(long, 50))) < 120
    whole = tok.slow.encode(long, add_special_tokens=False).ids
    assert [i for part in packing.segments(long, 50) for i in tok([part])[0].tolist()] == whole


def test_tokenizer_compares_words_of_equal_hash(monkeypatch):
    one, two = thue_morse(11)
    texts = [one, two, "these words all share a hash", "and so do those", "x", one, "a\0b a a\0 a\0\0", "abcdefgh abcdefgh\0 abcdefghijklmno abcdefghijklmnop abcdefghijklmnopq"]
    tok = packing.BatchTokenizer(packing.default_tokenizer())
    want = [e.ids for e in tok.slow.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tok(texts)] == want
    monkeypatch.setattr(tok, "_hash", lambda parts: np.ones(len(parts[0]), np.uint64))
    assert [x.tolist() for x in tok(texts)] == want


@pytest.mark.parametrize("kind", ["smallint", "decimal(10,2)", "double", "date"])
def test_any_type_of_doc_id(spark, kind):
    value = "DATE '2024-01-01'" if kind == "date" else f"CAST(7 AS {kind})"
    df = spark.sql(f"SELECT {value} AS doc_id, 'some text' AS text")
    want = df.first().doc_id
    assert [r.doc_id for r in packing.pack(df).collect()] == [r.doc_id for r in media.store_media(df).collect()] == [want]
    assert [r.class_id for r in near_dedup.near_duplicates(df).collect()] == [want]


def test_tokenizer_keeps_added_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "no token here", "☃ <|endoftext|> x"]
    got = [x.tolist() for x in packing.BatchTokenizer(packing.default_tokenizer())(texts)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert got[0] == [50256]


def test_packing(spark, odd, odd_rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(odd, open_windows=4).collect()
    want = defaultdict(int)
    for i, t, *_ in odd_rows:
        want[i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    covered = defaultdict(list)
    for r in rows:
        covered[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    assert set(covered) == set(want)
    texts = {r[0]: r[1] for r in odd_rows if r[0] is not None}
    for (i, total), pieces in covered.items():
        assert sum(n for _, n, _ in pieces) == total * want[i, total]
        if want[i, total] == 1:
            at = 0
            for start, n, crc in sorted(pieces):
                assert start == at
                at += n
                if i is not None:
                    ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
                    assert zlib.crc32(ids[start : start + n].tobytes()) == crc
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    fills = []
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        fills.append(at)
    assert max(fills) <= 1024 and sum(fills) >= 0.97 * 1024 * (len(fills) - 1)
    assert packing.pack(empty).count() == 0


PAGES = [
    ("<body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p>First  text\n here.<p>Second &eacute;&#x41;</article><footer>f</footer>", "Title & more\nFirst text here.\nSecond éA"),
    ("<body><div class='site-header'>x</div><div id=content><h2>T</h2><p>Long text of the article, with <a href=x>link</a> inside.<p>and <b>bold</b> words</div><div class=comments><p>Great post!</div><form>q</form>", "T\nLong text of the article, with link inside.\nand bold words"),
    ("<body><h1>Head</h1><div><p>some long paragraph text here with words</p><p>more of it in the same section</p></div><h2>x</h2><div><p>other section with a text that is long</p></div><ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></ul></body>", "Head\nsome long paragraph text here with words\nmore of it in the same section\nx\nother section with a text that is long"),
    ("just text &lt; more", "just text < more"), ("", ""), (None, ""), ("<p>", ""), ("<script>var a='<p>x</p>';</script><style>p{}</style>", ""),
    ("<article><p><b>One.<br><p>Two.</article>", "One.\nTwo."), ("<article><p>a</p><aside>side</aside><p>b</p><div class='cookie-notice'>c</div><section class=comments>no</section></article>", "a\nb"),
    ("<article><header><h1>Kept headline</h1></header><p>Body text</p></article>", "Kept headline\nBody text"), ("</div></p>stray<td>cell", "stray\ncell"),
]


def test_html(spark):
    for page, text in PAGES:
        assert html_text.extract(page) == text
    df = spark.createDataFrame([(i, "u", p, "x") for i, (p, _) in enumerate(PAGES)] * 2 + [(None, None, "<p>x", None)], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(df).collect()
    assert len(got) == 2 * len(PAGES) + 1 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id is not None} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract_pages(df.limit(0)).count() == 0
    assert html_text.extract("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"


def test_html_reads_attributes_by_name():
    shown = ['class="post" style="overflow:hidden"', 'aria-hidden="false"', 'title="Hidden gems"', 'data-hidden="0"', 'data-id="nav-3"', "title='a class=\"menu\" hidden'", "data-role=navigation", 'data-x=1 title="x > hidden"']
    for attributes in shown:
        assert html_text.extract(f"<body><div {attributes}><p>The text of the page</p></div></body>") == "The text of the page", attributes
    for attributes in ["hidden", 'class="post" hidden', 'hidden=""', "HIDDEN=hidden", 'aria-hidden="true"', 'data-x="1"hidden', "role = 'navigation'", "class=menu", "title='x' id=\"menu\""]:
        assert html_text.extract(f"<body><p>The text of the page</p><div {attributes}>cut</div></body>") == "The text of the page", attributes


STORY = "<h1>Title</h1><p>A long paragraph of the article with many words in it.</p><p>And a second one, with more words of the same article.</p>"
TOLD = "Title\nA long paragraph of the article with many words in it.\nAnd a second one, with more words of the same article."


def test_html_words_of_class_do_not_cut_the_article():
    for name in ["layout has-sidebar", "content-with-nav", "cookie-consent-ready", "page widget", "no-comments"]:
        assert html_text.extract(f"<body><div class='{name}'><article>{STORY}</article></div><div class=sidebar>side</div></body>") == TOLD, name
        assert html_text.extract(f"<body><div class='{name}'>{STORY}</div><div class=sidebar>side</div></body>") == TOLD, name
    for name, title in [("related-work", "Related work"), ("social-history", "A social history"), ("menu-design", "Menu design"), ("share-prices", "Share prices")]:
        want = f"{TOLD}\n{title}\nMore about it."
        assert html_text.extract(f"<body><article>{STORY}<h2 id={name}>{title}</h2><p>More about it.</p></article></body>") == want
        assert html_text.extract(f"<body><article>{STORY}<section id={name}><h2>{title}</h2><p>More about it.</p></section></article></body>") == want


def test_html_words_of_class_still_cut_the_rest():
    thread = "<h2>Comments</h2>" + "<article class=comment-body><p>A very long comment of a reader, at length and with many words.</p></article>" * 9
    for rest in [f"<div id=comments>{thread}</div>", "<div class=related-posts><h2>More</h2><article><p>Teaser</p></article></div>", "<section id=cookie-consent><h2>Cookie consent</h2><p>We use some.</p></section>"]:
        assert html_text.extract(f"<body><main><article>{STORY}</article>{rest}</main></body>") == TOLD
    advert = "<div class=ad>An advert of more words than the whole article has.</div>"
    assert html_text.extract(f"<body>{advert}<article><p>Short.</p></article></body>") == html_text.extract(f"<body><article><p>Short.</p>{advert}</article></body>") == "Short."
    assert html_text.extract(f"<body><article><h1>T</h1><div class='entry social'>{STORY}</div></article></body>") == "T\n" + TOLD


def test_html_keeps_what_the_article_holds():
    for extra, want in [
        ("<div class='share-price'><p>The price of a share fell.</p></div>", "The price of a share fell."),
        ("<section class='related-work'><h2>Related work</h2><p>Others did this.</p></section>", "Related work\nOthers did this."),
        ("<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li><li><a href=3>Third source</a></li></ul>", "First source\nSecond source\nThird source"),
        ("<p>R&am<b>p;</b>D and R&amp;D</p>", "R&amp;D and R&D"),
    ]:
        assert html_text.extract(f"<body><nav>n</nav><article>{STORY}{extra}</article></body>") == f"{TOLD}\n{want}"
        assert html_text.extract(f"<body><div id=content>{STORY}{extra}{STORY}</div></body>") == f"{TOLD}\n{want}\n{TOLD}"
    for rest in ["<div class=related-posts><p>Some other post</p></div>", "<div class='ad ad-slot'>Buy</div>", "<div id=share-buttons>Tell it</div>", "<form>Search</form>"]:
        assert html_text.extract(f"<body><div id=content>{STORY}{rest}</div></body>") == TOLD
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(5)) + "</ul>"
    assert html_text.extract(f"<body><div>{menu}{STORY}{menu}</div></body>") == TOLD


@pytest.mark.parametrize("page", ["<a " + "''" * 500_000, "<a x=" + "'\"" * 300_000, "<a x=' <b y=\" " * 60_000, "<p>" + "<i>" * 60_000 + "<p>x" * 60_000, "<i>" * 60_000 + "</x>" * 100_000, "<!--" * 300_000, "<" * 300_000, "<div class=ad>" * 60_000])
def test_html_takes_time_in_proportion(page):
    start = time.process_time()
    html_text.extract(page)
    assert time.process_time() - start < 5


def test_html_tree():
    for page, text in [
        ("<head><title>t</title><p>In the body</p>", "In the body"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<div>a</span></p></x>b</div>", "ab"), ("<p>text <b", "text"), ("<p a='x>y'>in</p>", "in"), ("<div><table><tr><td>x</div>y</table>z</div>", "xy\nz"), ("<BODY><P CLASS='x'>Up</BODY>", "Up"),
    ]:
        assert html_text.extract(page) == text, page


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        words = " ".join(rng.choice(["alpha", "be", "gamma", "of"]) for _ in range(rng.choice([0, 2, 8, 30])))
        kind = rng.choice(["text", "p", "div", "section", "ul", "a", "b", "h2", "span"])
        if kind == "text" or depth > 4:
            parts.append(words)
        elif kind == "ul":
            parts.append("<ul>" + "".join(f"<li><a href=x>{words[:12]} {i}</a></li>" for i in range(rng.randint(1, 4))) + "</ul>")
        elif kind in ("div", "section", "span", "b"):
            parts.append(f"<{kind}>{random_page(rng, depth + 1)}</{kind}>")
        else:
            parts.append(f"<{kind}>{words}</{kind}>")
    return " ".join(parts)


def naive_choice(body):
    """The same definition, every node counted anew from its own text."""

    def inside(node, links=False):
        for p in node.parts:
            if isinstance(p, str):
                yield "text", len("".join(p.split())), links or node.tag == "a"
            else:
                yield p.tag, 0, False
                yield from inside(p, links or node.tag == "a")

    def counts(node):
        seen = list(inside(node))
        above = node.parent
        while above:
            if above.tag == "a":
                seen = [(k, n, True) for k, n, _ in seen]
            above = above.parent
        return sum(n for _, n, _ in seen), sum(k != "text" and k not in html_text.INLINE for k, _, _ in seen), sum(n for _, n, x in seen if x), sum(k == "a" for k, _, _ in seen)

    whole = counts(body)

    def density(node):
        c, t, lc, lt = counts(node)
        if not c:
            return 0.0
        t = max(t, 1)
        base, ratio = np.log(c * lc / max(c - lc, 1) + whole[2] / max(whole[0], 1) * c + np.e), c / max(lc, 1) * t / max(lt, 1)
        if base <= 1 + 1e-12:
            return c / t * max(np.log(ratio), 0)
        return c / t * np.log(ratio) / np.log(base) if ratio > 1 else 0.0

    def children(node):
        return [p for p in node.parts if not isinstance(p, str)]

    def ancestors(node):
        return [node] if node is body else [node, *ancestors(node.parent)]

    def below(node):
        return [node, *(x for p in children(node) for x in below(p))]

    nodes = below(body)
    sums = [sum(density(p) for p in children(n) if p.tag not in html_text.INLINE) for n in nodes]
    best = nodes[int(np.argmax(np.array(sums) > max(sums) - 1e-9))]
    if max(sums) <= 0:
        return [body]
    path = ancestors(best)
    threshold = min(map(density, path))
    held = [best] + [p for n in path[1:] for p in children(n) if p not in path and p.tag not in html_text.INLINE and counts(p)[0] and density(p) >= threshold - 1e-12]
    lowest = next(n for n in path if all(n in ancestors(x) for x in held))
    if lowest is not body or best is body:
        return html_text._without_lists(lowest)
    places = [i for i, p in enumerate(body.parts) if any(p in ancestors(x) for x in held)]
    first = min(places)
    while first and (isinstance(body.parts[first - 1], str) and not body.parts[first - 1].strip() or not isinstance(body.parts[first - 1], str) and body.parts[first - 1].tag in html_text.HEADINGS):
        first -= 1
    return body.parts[first : max(places) + 1]


def test_html_choice_matches_naive_densities():
    rng, kinds = random.Random(12), set()
    for _ in range(300):
        root = html_text.parse(f"<body>{random_page(rng)}</body>")
        body = html_text._measure(root)
        got = html_text._chosen(body)
        assert html_text._blocks(got) == html_text._blocks(naive_choice(body))
        kinds.add(got[0] is body)
    assert kinds == {True, False}
