"""Operators that compare texts with each other, and the pipeline, held against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corrweave.llm import chunks, lm, neardup, queries, urls

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _components(docs, width=3, percent=85):
    """Exact classes by comparing all pairs."""
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def _near_docs(seed=6):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 6)))
    docs = []
    for base in range(6):
        text = [word() for _ in range(rnd.choice([12, 60, 150]))]
        for copy in range(25):
            mine = list(text)
            for _ in range(rnd.randint(0, max(1, len(text) // 14))):
                mine[rnd.randrange(len(mine))] = word()
            docs.append((base * 100 + copy, " ".join(mine)))
    docs += [(900 + k, docs[3][1].upper()) for k in range(5)] + [(950, "two words"), (951, "Two  words"), (952, ""), (953, None), (954, "\n"), (955, "one")]
    return docs


def test_near_duplicates_are_exact(spark):
    docs = _near_docs()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, (n, c) in _components(docs).items():
        assert got[d] == (n, c, c == d)


def test_star_of_copies_is_one_component(spark):
    """Copies that are alike only through their base are found through it, whatever its id."""
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    docs = [(500, " ".join(base))]
    for k in range(60):
        mine = list(base)
        for j in range(4):
            mine[(k * 3 + j * 50) % 200] = f"c{k}x{j}"
        docs.append((k, " ".join(mine)))
    rnd.shuffle(docs)
    want = _components(docs)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["kept"] for r in rows)  # the repeated row is one document
    assert neardup.near_duplicates(no_docs).count() == 0


def test_components_of_long_paths(spark):
    from corrweave.plans.components import connected_components

    edges = [(k, k + 1) for k in range(100, 140)] + [(7, 7), (1, None), (5, 3), (3, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, 3: 3, 5: 3}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cut_points_resist_shifts():
    rnd = random.Random(1)
    text = "".join(rnd.choices("abcdefgh éü", k=4000)).encode()
    params = chunks.ChunkParams()
    ends = chunks.cut_points(text, params)
    assert ends[-1] == len(text) and all(b - a <= params.most for a, b in zip([0, *ends[:-1]], ends, strict=True))
    for a in ends:
        text[:a].decode()
    cut = lambda t: {t[a:b] for a, b in zip([0, *chunks.cut_points(t, params)[:-1]], chunks.cut_points(t, params), strict=True)}
    moved = cut(b"inserted " + text)
    assert len(cut(text) - moved) <= 3
    plain = 0
    for k in range(64):  # one step a byte gives the same hash
        plain = ((plain << 1) + int(chunks._GEAR[text[k]])) & 0xFFFFFFFF
        assert plain == chunks.gear_hashes(__import__("numpy").frombuffer(text[: k + 1], "u1"))[-1]


def test_repeated_passages(spark, odd_docs, no_docs):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklm", k=rnd.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage = [some(60) for _ in range(4)]
    docs = [(k, some(rnd.randint(20, 150))) for k in range(60)]
    docs += [(100 + k, f"{some(rnd.randint(0, 40))} {passage[k % 4]} {some(rnd.randint(0, 40))}") for k in range(12)]
    docs += [(200, passage[0] + " " + some(5)), (300, None), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = chunks.repeated_passages(df).collect()
    assert {r["doc_id"] for r in rows} == {*range(100, 112), 200}
    texts = dict(docs)
    for r in rows:
        piece = texts[r["doc_id"]].encode()[r["at"] : r["end"]]
        assert any(piece.decode().strip()[5:-5] in p for p in passage) and r["words"] >= 20
        assert r["drop"] == (r["first_doc"] < r["doc_id"])
    assert {100, 101, 102, 103} <= {r["first_doc"] for r in rows} <= {*range(100, 112)}
    assert chunks.repeated_passages(odd_docs).count() == 0 and chunks.repeated_passages(no_docs).count() == 0


def test_spans_of_earlier_documents_inside_a_passage(spark):
    rnd = random.Random(8)
    some = lambda n: " ".join("".join(rnd.choices("abcdefghijklm", k=rnd.randint(2, 8))) for _ in range(n))
    old, new = some(80), some(80)
    docs = [(1, old), (5, f"{old} {new}"), (9, new), (12, f"{old} {new}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in chunks.repeated_passages(df).collect() if r["words"] >= 100 or r["doc_id"] in (1, 9)}
    whole = len(docs[1][1])
    assert (rows[5]["at"], rows[5]["end"], rows[5]["drop"]) == (0, whole, False)  # what document 1 has, then what is first seen here
    ((a, b),) = rows[5]["earlier"]
    assert a == 0 and abs(b - len(old)) <= 128
    assert [tuple(s) for s in rows[12]["earlier"]] == [(0, whole)] and rows[12]["drop"]
    assert rows[1]["earlier"] == [] and [tuple(s) for s in rows[9]["earlier"]] == [(rows[9]["at"], rows[9]["end"])]


def _held(d, m):
    return zlib.crc32(str(d).encode()) % m == 2


def test_language_model(spark, odd_docs, no_docs):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(vocabulary[min(int(rnd.expovariate(0.03)), 299)].title() for _ in range(rnd.randint(0, 60)))) for k in range(150)] + [(900, None), (901, "unseen words only")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tokens = {d: [*WORD.findall((t or "").translate(LOW)), "\n"] for d, t in docs}
    count = Counter(w for d, x in tokens.items() if not _held(d, 7) for w in x)
    n, v = sum(count.values()), len(count)
    for params in (lm.LmParams(), lm.LmParams(words=20, hot_bigrams=64)):
        for r in lm.score(df, ~queries.held_out(7), params).collect():
            x = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(count[w] > 0 for w in x), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), rel=1e-9)
            assert -math.inf < r["score"] < 0
    assert lm.score(odd_docs, ~queries.held_out(7)).count() == odd_docs.count()
    assert lm.score(no_docs, ~queries.held_out(7)).count() == 0
    assert lm.score(df, F.lit(False)).where("n_known > 0").count() == 0


def test_language_model_against_its_formula(spark):
    """With the weights that EM finds, every text's score is the plain sum of the mixture's logarithms."""
    rnd = random.Random(4)
    docs = [(k, " ".join(f"w{min(int(rnd.expovariate(0.2)), 40)}" for _ in range(30))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = {}
    plain = lm.expectation_maximisation

    def spy(*a):
        seen["w"] = plain(*a)
        return seen["w"]

    lm.expectation_maximisation = spy
    try:
        got = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("doc_id") % 5 != 0, lm.LmParams(hot_bigrams=100)).collect()}
    finally:
        lm.expectation_maximisation = plain
    tokens = {d: [*t.split(), "\n"] for d, t in docs}
    one = Counter(w for d, x in tokens.items() if d % 5 for w in x)
    two = Counter(p for d, x in tokens.items() if d % 5 for p in zip(["\n", *x], x, strict=False))
    n, v = sum(one.values()), len(one)
    for d, x in tokens.items():
        total = 0.0
        for h, w in zip(["\n", *x], x, strict=False):
            l2, l1, l0 = seen["w"][1 + int(math.log2(one[h])) if one[h] else 0]
            total += math.log10(l2 * two[h, w] / max(one[h], 1) + l1 * one[w] / n + l0 / (v + 1))
        assert got[d] == pytest.approx(total, rel=1e-9)


def test_language_model_counts_bigrams_of_all_words(spark):
    """The tables are fast paths alone: scores and EM's histogram are the same with a table of any size."""
    rnd = random.Random(14)
    docs = [(k, " ".join(f"w{min(int(rnd.expovariate(0.05)), 200)}" for _ in range(40))) for k in range(80)] + [(900, "rare pair"), (901, "rare pair"), (902, "rare pair"), (903, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen, scores = [], []
    plain = lm.expectation_maximisation

    def spy(cells, *a):
        seen.append(dict(cells))
        return plain(cells, *a)

    lm.expectation_maximisation = spy
    try:
        for params in (lm.LmParams(), lm.LmParams(words=8, hot_bigrams=50), lm.LmParams(words=0)):
            scores.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in lm.score(df, F.col("doc_id") % 5 != 0, params).collect()})
    finally:
        lm.expectation_maximisation = plain
    assert sum(seen[0].values()) == sum(len(t.split()) + 1 for d, t in docs if d % 5)
    for cells, got in zip(seen[1:], scores[1:], strict=True):
        assert cells == seen[0]
        for d, values in scores[0].items():
            assert got[d] == pytest.approx(values, rel=1e-9)


def test_em_finds_the_mixture():
    rnd = random.Random(2)
    cells = defaultdict(float)
    for _ in range(20_000):  # tokens of which 70 % follow the bigram estimate
        good = rnd.random() < 0.7
        cells[5, 4 if good else lm._BINS - 1, 40] += 1
    w = lm.expectation_maximisation(cells, 1e-6, 500)[5]
    assert w.sum() == pytest.approx(1) and 0.66 < w[0] < 0.72


def test_url_rules_and_hosts(spark):
    pages = [(1, "https://a.example.com/en/7/x?q#f"), (2, "http://a.example.com/en/8"), (3, "http://NET/de/1"), (4, "http://x.example.net/de/88"), (5, "http://x.example.org/es/"), (6, None), (7, "no scheme/en/"), (8, "http://notcom/en/1"), (9, "http://h.org?x=/es/1"), (10, "http://"), (11, "ftp://A.com/en/#y")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), queries.URL_RULES).collect()}
    want = {
        1: ("a.example.com", "/en/7/x", "example.com/en/7", "allow"),
        2: ("a.example.com", "/en/8", "com/en/", "block"),
        3: ("net", "/de/1", "net/de/", "allow"),
        4: ("x.example.net", "/de/88", "example.net/de/8", "block"),
        5: ("x.example.org", "/es/", "org/es/", "block"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("notcom", "/en/1", None, "allow"),
        9: ("h.org", "", None, "allow"),
        10: ("", "", None, "allow"),
        11: ("a.com", "/en/", "com/en/", "block"),
    }
    assert got == want
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


def test_url_templates_generalise_and_reject(spark):
    rows = [(k, f"http://h.net/spam/{k}/buy", 1 if k % 2 else None) for k in range(60)] + [(100 + k, f"http://h.net/news/{k}", 0 if k % 2 else None) for k in range(60)]
    rows += [(300 + k, f"http://h.net/{'a' if k % 2 else 'b'}/{k}", 1) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in urls.judge_urls(df, [], label_col="bad").collect()}
    assert got[0] == ("spam/*/buy", "block") and got[100] == ("news/*", "allow") and got[300] == ("b/*", "block")


def test_pipeline_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").unionByName(spark.createDataFrame([(10_001, "12 34 !!", "en", "s", 8), (10_002, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns = docs.columns
    kept = corpus_pipeline.identify_language(spark, docs, sf_small)
    assert kept.columns == columns and kept.count() == docs.count() - 2
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    near = corpus_pipeline.drop_near_duplicates(spark, kept.unionByName(kept.where("doc_id < 3")), sf_small)
    assert near.columns == columns
    want = {d for d, (_, c) in _components(before.items(), 5, 80).items() if c == d}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(want)
    clean = corpus_pipeline.drop_contaminated(spark, near, sf_small)
    assert clean.columns == columns and 0 < clean.count() < near.count()
    safe = corpus_pipeline.redact_secrets(spark, clean, sf_small)
    assert safe.columns == columns and safe.count() == clean.count()
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"]) for r in safe.collect())
    final = corpus_pipeline.encode(spark, safe, sf_small)
    assert final.count() == safe.count()
    ran = corpus_pipeline.run(spark, sf_small)
    assert ran.count() and set(ran.columns) == {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
