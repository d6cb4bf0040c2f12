"""Corpus operators against plain versions of what they compute, on rows that repeat, share ids, lack ids, and on the driver's small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corrweave.llm import chunks, decontaminate, lang_id, lm, neardup, queries, secrets, text, urls
from corrweave.llm.token_store import StoreParams, read_store, write_store
from corrweave.plans import shared

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- near-duplicates


def _rows_brute(rows, width=3, percent=85):
    """n_shingles, component and kept of each row; rows are documents, and those of one set are one."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    out = []
    for k, (d, _) in enumerate(rows):
        c = d if not sets[k] else least.get(root(k))
        out.append((d, len(sets[k]), c, c is None or c == d))
    return sorted(out, key=str)


def _got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r)[:4] for r in neardup.near_duplicates(df).collect()), key=str)


def _chain(n=60, words=120, seed=3):
    """Each text differs from the one before in a word or two: alike to its neighbours, not to those far off."""
    rnd = random.Random(seed)
    text, out = [f"w{rnd.randrange(10**6)}" for _ in range(words)], []
    for k in range(n):
        out.append((1000 + k, " ".join(text)))
        text = list(text)
        text[(k * 7) % words] = f"x{k}"
    rnd.shuffle(out)
    return out


def test_repeated_rows_lose_no_link(spark):
    rows = _chain()
    assert _got(spark, rows) == _rows_brute(rows)
    assert _got(spark, rows + rows) == _rows_brute(rows + rows)
    assert len({c for _, _, c, _ in _got(spark, rows + rows)}) == 1


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, b = _chain(8, 60, 5), _chain(8, 60, 6)
    rows = [(k % 3, t) for k, (_, t) in enumerate(a)] + [(k % 2 + 1, t) for k, (_, t) in enumerate(b)]
    assert _got(spark, rows) == _rows_brute(rows)
    assert _got(spark, rows + rows[::2]) == _rows_brute(rows + rows[::2])


def test_rows_without_an_id(spark):
    rows = _chain(10, 60, 7)
    some = [(None if k % 2 else d, t) for k, (d, t) in enumerate(rows)] + [(None, t) for _, t in _chain(4, 50, 8)] + [(None, None), (None, ""), (7, None)]
    assert _got(spark, some + some) == _rows_brute(some + some)


def _edited(n, edits, words=150, choice=10**6, seed=12):
    """Copies of one text with up to ``edits`` words changed, each into one of ``choice`` words."""
    rnd = random.Random(seed)
    base, out = [f"w{k}" for k in range(words)], []
    for k in range(n):
        mine = list(base)
        for _ in range(rnd.randint(1, edits)):
            mine[rnd.randrange(words)] = f"x{rnd.randrange(choice)}"
        out.append((k, " ".join(mine)))
    return out


def test_near_copies_give_few_pairs(spark, monkeypatch):
    """What is compared in full grows with the copies, not with the pairs that miss the threshold by little."""
    counts, write = [], neardup.materialize

    def counting(df, name):
        out = write(df, name)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(neardup, "materialize", counting)
    rows = _edited(200, 6)
    assert _got(spark, rows) == _rows_brute(rows)
    assert len(counts) == 1 and counts[0] <= 2 * len(rows)


def test_copies_that_share_edits_are_linked(spark):
    """Links between copies that are all far from the hub are found by what they changed alike."""
    for choice, edits, seed in ((1, 9, 1), (2, 14, 2), (10**6, 8, 3)):
        rows = _edited(150, edits, 100, choice, seed)
        far = rows[7][1].split()
        for k in range(0, 96, 8):
            far[k] = f"far{k}"
        rows += [(1000 + k, " ".join([*far[:k], "own", *far[k + 1 :]])) for k in range(1, 90, 9)]
        assert _got(spark, rows) == _rows_brute(rows)


def test_no_link_across_components_is_lost(spark):
    """The join alone against all pairs, whatever the families and their hubs are."""
    rnd = random.Random(4)
    for percent in (85, 80):
        sets, base = [], [rnd.sample(range(10**6), n) for n in (12, 40, 90)]
        for k in range(150):
            one = set(base[k % 3])
            for _ in range(rnd.randint(0, max(2, len(one) // 6))):
                one.discard(rnd.choice(base[k % 3])) if rnd.random() < 0.5 else one.add(rnd.randrange(10**6, 10**6 + 15))
            sets.append(sorted(one))
        linked = lambda a, b: 100 * len({*a} & {*b}) >= percent * len({*a} | {*b})
        component = [min(j for j in range(k % 3, k + 1, 3) if j == k or (j % 5 == 0 and linked(sets[j], sets[k]))) for k in range(150)]
        component = [component[component[k]] for k in range(150)]
        hubs = {f: rnd.choice([k for k in range(150) if component[k] % 4 == f]) for f in (0, 1, 2)}  # hubs of any kind, alike or not; a family holds whole components
        rows = [(k, len(sets[k]), component[k], f, (hubs[f], len(sets[hubs[f]]), component[hubs[f]]) if f in hubs else None) for k in range(150) for f in [component[k] % 4 if component[k] % 4 in hubs else 1000 + component[k]]]
        families = spark.createDataFrame(rows, "c long, n long, component long, family long, hub struct<c:long,n:long,component:long>")
        pairs, links = neardup._across_components(families, spark.createDataFrame(list(enumerate(sets)), "c long, shingles array<long>"), percent)
        pairs, links = {tuple(r) for r in pairs.collect()}, {tuple(r) for r in links.collect()}
        assert all(linked(sets[u], sets[v]) for u, v in links)
        by_hub = {(v, f) for f, h in hubs.items() for v in range(150) if (h, v) in links or (component[v] == component[h] and linked(sets[v], sets[h]))}
        for u in range(150):
            for v in range(u + 1, 150):
                if component[u] != component[v] and linked(sets[u], sets[v]):
                    f = component[u] % 4
                    both = f == component[v] % 4 and (u == hubs.get(f) or (u, f) in by_hub) and (v == hubs.get(f) or (v, f) in by_hub)
                    assert (u, v) in pairs or both


def test_pairs_at_the_threshold(spark):
    """Two classes that share 92 of 100 shingles each are a pair of the exact join, however often their rows repeat."""
    one = " ".join(f"w{k}" for k in range(102))
    two = " ".join([*(f"w{k}" for k in range(94)), *(f"v{k}" for k in range(8))])
    for times in (1, 2, 5):
        rows = [(1, one), (2, two)] * times
        assert _got(spark, rows) == _rows_brute(rows)


# ---- pipeline


def test_pipeline_of_odd_tables(spark, odd_docs, no_docs, sf_small):
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("_gone", "_leaking", "hash", "c", "text_hash", "component_id", "id2")})
    for docs in (clash, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, sf_small)
            assert after.columns == docs.columns, name
            assert after.count() <= docs.count()
        assert corpus_pipeline.encode(spark, docs, sf_small).count() == docs.count()
    near = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, clash, sf_small).collect()), key=str)
    assert near == sorted({(r["doc_id"], r["text"]) for r in odd_docs.collect()}, key=str)  # the repeated row stays once


def test_one_document_of_each_group_stays(spark, sf_small):
    base = " ".join(f"w{k}" for k in range(80))
    near = base.replace("w40", "x")
    rows = [(5, base), (5, near), (6, base), (None, base), (None, "alone without an id"), (None, "alone without an id"), (9, None), (10, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_small).collect()]
    assert sorted((d for d, _ in kept), key=str) == [10, 5, 9, None] and sum(t in (base, near) for _, t in kept) == 1


def test_filters_of_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([("a", "quick brown fox jumps over the lazy dog near the river")], "item_id string, text string")
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        found = decontaminate.find_leaks(odd_docs, bench, limit=limit)
        assert {r["doc_id"] for r in found.where(F.size("spans") > 0).collect()} == {1} and found.count() == odd_docs.count()
    left = decontaminate.drop_leaks(odd_docs, bench)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 1 and left.where("text is null").count() == 2
    assert decontaminate.drop_leaks(odd_docs, bench.limit(0)).count() == odd_docs.count()
    safe = secrets.redact(odd_docs, secrets.train(odd_docs))
    assert safe.columns == odd_docs.columns and safe.count() == odd_docs.count() and safe.where("text is null").count() == 2
    model = lang_id.train(odd_docs)
    kept = lang_id.keep_identified(odd_docs, model, 0.0)
    assert {r["doc_id"] for r in kept.collect()} == {1, 5, 6, None, 9}
    assert lang_id.train(no_docs).languages == []


def test_operators_leave_the_session_as_it_is(spark, odd_docs):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.unset(keys[0])
        spark.conf.unset(keys[1])
        plain = {k: spark.conf.get(k, None) for k in keys}
        neardup.near_duplicates(odd_docs).count()
        lm.score(odd_docs, F.lit(True)).count()
        assert {k: spark.conf.get(k, None) for k in keys} == plain
        text.limit_batches(spark)
        assert spark.conf.get(keys[0]) == str(text.BATCH_ROWS)
    finally:
        for k, v in before.items():
            if v is not None:
                spark.conf.set(k, v)


def test_intermediate_files_go(spark, odd_docs):
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared.shared_dir(spark))
    listed = lambda: {str(f.getPath()) for f in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)}
    shared.materialize(odd_docs, "held")
    before = listed()
    with shared.scratch(spark):
        assert neardup.near_duplicates(odd_docs).count() and listed() > before
    assert listed() == before


def test_one_operator_frees_what_another_keeps():
    calls = []
    text.keep("one", lambda: calls.append("one"))
    text.keep("one", lambda: calls.append("one"))
    assert calls == []
    list(text.blocks(iter([]), keeper="two"))
    assert calls == ["one"]
    list(text.blocks(iter([])))
    assert calls == ["one"]


# ---- URL templates


def _tree(pages, p=urls.UrlParams()):
    """Template, branch purity and verdict of each page (host, path, label), by plain dictionaries."""
    segments = [[s for s in path.split("/") if s] for _, path, _ in pages]
    template = [() for _ in pages]
    for level in range(max(map(len, segments), default=0)):
        count = Counter((h, template[k], segments[k][level]) for k, (h, _, _) in enumerate(pages) if len(segments[k]) > level)
        template = [t if len(s) <= level else (*t, s[level] if count[h, t, s[level]] >= p.least_rows else "*") for t, s, (h, _, _) in zip(template, segments, pages, strict=True)]
    leaf = defaultdict(lambda: [0, 0, 0])
    for t, (h, _, label) in zip(template, pages, strict=True):
        for i, v in enumerate((1, label is not None, label or 0)):
            leaf[h, t][i] += v
    branch = {key: key[1] for key in leaf}
    for level in range(max((i + 1 for _, t in leaf for i, s in enumerate(t) if s != "*"), default=0)):
        tails, node = defaultdict(Counter), defaultdict(lambda: [0, 0, 0])
        for key, b in branch.items():
            if len(b) > level:
                at = (key[0], b[:level], b[level])
                tails[at]["/".join(b[level + 1 :])] += leaf[key][0]
                node[at] = [x + y for x, y in zip(node[at], leaf[key], strict=True)]
        mark = {at: frozenset(t for t, n in tails[at].items() if n >= p.marking * node[at][0]) for at in node}
        group = defaultdict(list)
        for at in node:
            group[at[0], at[1], mark[at]].append(at)
        renamed = {}
        for (host, parent, m), members in group.items():
            if len(members) < 2:
                continue
            rows, labels, bad = (sum(node[a][i] for a in members) for i in range(3))
            pooled = sum((tails[a] for a in members), Counter())
            for a in members:
                far = sum(abs(tails[a][t] / node[a][0] - n / rows) for t, n in pooled.items()) / 2
                ok = far <= p.most_variation + 1e-12
                if node[a][1] >= p.least_labels:
                    whole = bad / labels
                    ok &= abs(node[a][2] / node[a][1] - whole) <= p.most_errors * (max(whole * (1 - whole), 0.01) / node[a][1]) ** 0.5 + 1e-12
                if ok:
                    renamed[a] = ("~", host, parent, m)
        for key, b in branch.items():
            if len(b) > level and (key[0], b[:level], b[level]) in renamed:
                branch[key] = (*b[:level], renamed[key[0], b[:level], b[level]], *b[level + 1 :])
    sums = defaultdict(lambda: [0, 0, 0])
    for key, v in leaf.items():
        sums[key[0], branch[key]] = [x + y for x, y in zip(sums[key[0], branch[key]], v, strict=True)]
    prior = (sum(v[2] for v in leaf.values()) + 1) / (sum(v[1] for v in leaf.values()) + 2)
    out = []
    for t, (h, _, _) in zip(template, pages, strict=True):
        rows, n, k = sums[h, branch[h, t]]
        purity = (k + p.prior_weight * prior) / (n + p.prior_weight)
        out.append(("/".join(t), purity, n >= p.least_labels and n >= p.least_cover * rows and purity >= p.reject_at))
    return out


def _held_against_tree(spark, rows):
    df = spark.createDataFrame([(k, f"http://{h}{path}", label) for k, (h, path, label) in enumerate(rows)], "page_id long, url string, bad int")
    got = {r["page_id"]: r for r in urls.judge_urls(df, [], label_col="bad").collect()}
    for k, (template, purity, blocked) in enumerate(_tree(rows)):
        assert got[k]["template"] == template and got[k]["purity"] == pytest.approx(purity), rows[k]
        assert got[k]["verdict"] == ("block" if blocked else "allow"), rows[k]


def test_templates_against_a_plain_tree(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(900):
        host = rnd.choice(["a.net", "b.org"])
        kind = rnd.choice(["sec", "user", "deep", "flat", "mix"])
        if kind == "sec":  # twenty-five equal sections, one of them bad
            s = rnd.randrange(25)
            rows.append((host, f"/s{s}/{rnd.randrange(10**6)}", rnd.choice([None, int(s == 3)])))
        elif kind == "user":
            rows.append((host, f"/user/{rnd.randrange(40)}/{rnd.choice(['photos', 'posts'])}/{k}", rnd.choice([None, None, 1])))
        elif kind == "deep":
            rows.append((host, "/a/b/c/d/e/f/" + rnd.choice(["spam", "news"]) + ("/x" * rnd.randrange(3)), None))
            rows[-1] = (*rows[-1][:2], 1 if "spam" in rows[-1][1] else 0)
        elif kind == "flat":
            rows.append((host, rnd.choice(["", "/", f"/{k}.html"]), None))
        else:
            rows.append((host, "/" + "/".join(rnd.choice("xyz") for _ in range(rnd.randrange(4))), rnd.choice([0, 1, None])))
    _held_against_tree(spark, rows)
    df = spark.createDataFrame([(k, f"http://{h}{p}", b) for k, (h, p, b) in enumerate(rows)], "page_id long, url string, bad int")
    got = {r["page_id"]: r for r in urls.judge_urls(df, [], label_col="bad").collect()}
    spam = {got[k]["verdict"] for k, (_, p, _) in enumerate(rows) if p.startswith("/a/b/c/d/e/f/spam")}
    news = {got[k]["verdict"] for k, (_, p, _) in enumerate(rows) if p.startswith("/a/b/c/d/e/f/news")}
    assert spam == {"block"} and news == {"allow"}  # segments below the sixth count


def test_templates_of_the_real_table(spark, sf_small):
    sf = sf_small.replace("sf0.001", "sf0.1")
    got = urls.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"), queries.URL_RULES).collect()
    label = {"block": 1, "allow": 0}
    want = _tree([(r["host"], r["path"], label[r["verdict"]] if r["rule"] else None) for r in got])
    for r, (template, purity, blocked) in zip(got, want, strict=True):
        assert (r["template"], r["purity"]) == (template, pytest.approx(purity))
        assert r["rule"] or r["verdict"] == ("block" if blocked else "allow")
    learned = [r for r in got if not r["rule"] and r["verdict"] == "block"]
    assert len(learned) > 100 and all(r["branch"].startswith("~") and r["purity"] >= 0.8 for r in learned)
    many = [urls.Rule("allow", f"h{k}.com", "/") for k in range(1500)] + queries.URL_RULES
    few = spark.createDataFrame([(1, "http://x.h1499.com/a"), (2, "http://example.com/en/7"), (3, "http://q.com/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in urls.judge_urls(few, many).collect()} == {1: "h1499.com/", 2: "example.com/en/7", 3: None}


# ---- languages


def test_filters_answer_like_plain_sets(spark, sf_small):
    """Shares from the bit-sliced filters, against sets of the n-grams that they were made of."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    chosen = {}
    plain = lang_id.LanguageModel.of_grams

    def spy(languages, grams, params):
        chosen.update({k: set(v.tolist()) for k, v in grams.items()})
        return plain(languages, grams, params)

    lang_id.LanguageModel.of_grams = staticmethod(spy)
    try:
        model = lang_id.train(docs)
    finally:
        lang_id.LanguageModel.of_grams = staticmethod(plain)
    assert model.languages == sorted(chosen)
    checked = 0
    for r in docs.limit(80).collect():
        gram, _ = lang_id.trigrams([(r["text"] or "").encode()])
        if not len(gram):
            continue
        share, _ = model.shares([r["text"].encode()])
        exact = np.array([np.mean([g in chosen[lang] for g in gram.tolist()]) for lang in model.languages])
        assert np.abs(share[0] - exact).max() < 0.05
        checked += 1
        if np.sort(exact)[-1] - np.sort(exact)[-2] > 0.1:
            assert model.languages[int(exact.argmax())] == model.predict([r["text"].encode()])[0][0]
    assert checked > 60
    every = plain(["a", "b"], {"a": np.array([7, 9], np.uint64), "b": np.array([9], np.uint64)}, lang_id.LanguageParams())
    slots = lang_id._probe(np.array([7, 9], np.uint64), every.params)
    assert (every.table[0, slots[0]] & every.table[0, slots[1]]).tolist() == [1, 3]  # all languages that have the n-gram


# ---- secrets


def test_planted_keys_without_keywords(spark, sf_small):
    """Keys of mixed alphabets among ordinary words: the chains find nine of ten, and nothing else."""
    rnd = random.Random(17)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").where("text is not null").collect()]
    model = secrets.train(spark.createDataFrame(docs, "doc_id long, text string"))
    planted, rows = {}, []
    for d, t in docs:
        words = t.split(" ")
        keys = ["".join(rnd.choices(rnd.choice(alphabets), k=rnd.randint(20, 48))) for _ in range(3)]
        for key in keys:
            words.insert(rnd.randrange(len(words) + 1), key)
        planted[d] = keys
        rows.append((d, " ".join(words)))
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hit = wrong = 0
    for d, t in rows:
        spans = [(s["kind"], t[s["start"] : s["end"]]) for s in found[d]]
        hit += sum(any(key in piece or piece in key and len(piece) >= 16 for _, piece in spans) for key in planted[d])
        wrong += sum(kind == "markov" and not any(piece in key or key in piece for key in planted[d]) for kind, piece in spans)
    total = 3 * len(rows)
    print(f"planted keys found: {hit} of {total}; other words taken for keys: {wrong}")
    assert hit >= 0.9 * total and wrong <= 0.02 * total


# ---- passages


def test_passages_against_shared_windows(spark, sf_small):
    """Documents that share 51 words with another have a passage, and passages are words that another document has."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    seen, owners = defaultdict(set), {}
    for r in docs:
        w = WORD.findall(r["text"] or "")
        owners[r["doc_id"]] = w
        for i in range(len(w) - 50):
            seen[tuple(w[i : i + 51])].add(r["doc_id"])
    sharing = {d for ids in seen.values() if len(ids) > 1 for d in ids}
    rows = chunks.repeated_passages(spark.read.parquet(f"{sf_small}/documents.parquet")).collect()
    caught = {r["doc_id"] for r in rows}
    assert len(sharing) > 20 and len(sharing - caught) <= 0.01 * len(sharing)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    for r in rows:
        piece = texts[r["doc_id"]][r["at"] : r["at"] + 16]
        assert any(piece in t for d, t in texts.items() if d != r["doc_id"])
    clean = set(owners) - sharing
    assert len(caught & clean) <= 0.05 * len(clean)


def test_periodic_texts_share_chunks_wherever_they_begin(spark):
    docs = [(1, "begin here then " + "word " * 300), (2, "quite another start of a text " * 2 + "word " * 200 + "and an end"), (3, "nothing of that")]
    rows = chunks.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {1, 2}


def test_a_hot_digest(spark):
    """A passage that most documents have is found in all of them."""
    rnd = random.Random(23)
    some = lambda n: " ".join("".join(rnd.choices("abcdefghijklm", k=rnd.randint(2, 8))) for _ in range(n))
    shared_text = some(80)
    docs = [(k, f"{some(20)} {shared_text if k % 4 else some(80)} {some(20)}") for k in range(200)]
    rows = chunks.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {k for k in range(200) if k % 4}


# ---- token store


def test_store_of_repeated_ids_and_digests(spark, sf_small, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(5, f"text number {k}") for k in range(40)] + [(None, f"none {k}") for k in range(20)] + [(k, "a b c") for k in range(10)] + [(5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = f"file://{tmp_path}/store"
    manifest = write_store(df, store, queries.tokenizer_path(), StoreParams(sample_docs=20, shard_bytes=64))
    got = read_store(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert sum(5 in range(0, 6) for _ in got) == len(rows) and manifest["ids"] == got[-1]["start"] + got[-1]["n_tokens"]
    want = Counter()
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["crc"]) for r in got) == want
    assert len(manifest["shards"]) > 1 and not list(tmp_path.glob("store/*.part"))
    whole = {r["doc_id"]: r for r in queries.op7_token_store(spark, sf_small).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert (whole[r["doc_id"]]["start"], whole[r["doc_id"]]["ids_crc32"]) == (start, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
