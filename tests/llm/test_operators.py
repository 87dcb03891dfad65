"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from millrace.llm import bpe, hmm, media, mixing, neighbours, pii, quality, simhash, toxicity, warc
from millrace.llm import queries as q
from millrace.llm._shared import Workspace, components, drop_ids

SF = "/root/testdata/sf0.001"
LONG = "word and other words " * 4000
ODD = [(0, "the cat sat on the mat", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, LONG, "de", "b"), (4, "the cat sat on the mat", "en", "a"), (4, "the cat sat on the mat", "en", "a"), (None, "no id here", "fr", None), (5, " \t\x0b \n", "es", "b"), (6, "Ünïcödé 日本語 🙂 the cat", None, "ü")]
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ODD, COLUMNS)
    return df.selectExpr("*", "1L size", "'x' key", "2 score", "3 chunk", "doc_id node", "doc_id a", "'r' rep", "0L n_chars").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(t):
    return (t or "").encode().lower().split()


def test_components(spark):
    ws = Workspace(spark)
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (9, 8)] + [(100 + i, 101 + i) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(None, 1)]
    got = dict(map(tuple, components(ws, spark.createDataFrame(edges, "a long, b long"), "t").collect()))
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8} | {100 + i: 100 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert got == want
    for most in (0, 20, 150):  # rounds, and one task for what they leave
        assert dict(map(tuple, components(ws, spark.createDataFrame(edges, "a long, b long"), f"t{most}", one_task=most).collect())) == want
    assert components(ws, spark.createDataFrame([], "a long, b long"), "e").count() == 0


def test_drop_ids(spark, docs):
    left = drop_ids(docs, spark.createDataFrame([(4,), (99,), (None,)], "doc_id long"))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["0", "1", "2", "3", "5", "6", "None"] and left.columns == docs.columns


# -- toxicity


def all_segments(scores):
    """Ruzzo and Tompa's definition by brute force: split again and again at the best segment."""
    if not scores or max(scores) <= 0:
        return []
    n, best = len(scores), None
    for i in range(n):
        for j in range(i + 1, n + 1):
            s = sum(scores[i:j])
            if best is None or s > best[0] + 1e-12:
                best = (s, i, j)
    s, i, j = best
    return all_segments(scores[:i]) + [(i, j, s)] + [(a + j, b + j, x) for a, b, x in all_segments(scores[j:])]


def test_segments_are_maximal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = [float(rng.uniform(1, 9)) if rng.random() < 0.3 else -1.5 for _ in range(25)]  # without ties, where the shorter segments count
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(hits, -1.5)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in all_segments(scores)]


def test_segments_in_linear_time():
    took = []
    for n in (25_000, 100_000):
        began = time.process_time()
        lonely = toxicity.maximal_segments([(40 * i, 2.0 + i % 3) for i in range(n)])
        rising = toxicity.maximal_segments([(5 * i, 1.8 + 0.01 * (i % 7)) for i in range(n)])
        took.append(time.process_time() - began)
        assert len(lonely) == n and 0 < len(rising) <= n
    assert took[1] < 12 * took[0] + 0.5


def test_toxicity(spark, docs, empty):
    rows = [(i, f"a plain text of number {i} with words {f'x{i % 37} vilestem' + 'abcdefghij'[i // 4 % 10] + ' scum' if i % 4 == 0 else ''} in between {i * 7}") for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(train, labels)
    assert "scum" in model.terms and "vilest" in model.stems
    new = spark.createDataFrame([(1, "some vilestemzzz here"), (2, "some words here of number"), (3, None), (4, ""), (5, "word " * 30000 + "scum vilestemq scum vilestemx scum")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(new, model).collect()}
    assert got[1] > 0.5 and got[5] > 0.5 and got[2] < 0.5 and got[3] == got[4] < 0.5
    spans = toxicity.passages(new, model, most_expected=10).collect()
    assert [(r.start, r.end) for r in spans if r.doc_id == 1] == [(5, 16)]
    out = toxicity.op1(docs, labels)
    assert out.count() == len(ODD) and all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in out.collect())
    assert toxicity.op1(empty, labels).count() == 0
    assert toxicity.train(empty, labels.limit(0)).score("scum")[0] < 0.5


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"  # enough labels, of which only the held-out ones are looked at
    got = q.op1_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    toxic = [r for r in got if r.toxic]
    assert len(toxic) >= 10 and sum(r.predicted for r in got if not r.toxic) <= 0.005 * len(got)
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)


def test_probability_by_the_formula():
    m = toxicity.Model({"scum": 2.0, "vile": 3.0}, {}, lam=0.7, k=0.05, slope=1.3, at=-2.0)
    for text in ("", None, "plain words", "scum", "a vile scum b c d e f g h i j k l m vile", "x " * 50 + "vile scum vile"):
        words = re.findall(r"\w+", text or "")
        scores = [m.terms[w] if w in m.terms else toxicity.LOSS for w in words]
        x = sum(max(0.0, -math.log(m.k * len(words) * math.exp(-m.lam * s))) for _, _, s in all_segments(scores))
        assert math.isclose(m.score(text)[0], 1 / (1 + math.exp(-(1.3 * x - 2.0))), rel_tol=1e-9)


# -- WARC


def test_warc_round_trip(spark):
    inner = warc.record("response", 99, "http://x", b"evil" * 40, "0" * 64, 160, None)
    rows = [(1, "http://a b\n", None), (2, None, "x" * 200), (3, "u", "x" * 200), (4, "u", "é" * 20), (5, "u", "é" * 20), (6, "u", "\r\n\r\n" + inner.decode() * 3), (None, "u", "x" * 200), (7, "u", inner.decode()), (8, "v", "z" * 3_000_000), (2, "again", "x" * 200)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").coalesce(2)
    for zipped, span in ((True, 1 << 20), (False, 1 << 20), (True, 300), (False, 700)):
        ws = Workspace(spark)
        m = warc.write(pages, ws, zipped=zipped, archive=2000 if span < 1000 else warc.ARCHIVE)
        got = warc.read(m, ws, span).collect()
        want = Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
        assert {(r.page_id, r.refers_to) for r in got if r.kind == "revisit"} == {(3, 2), (None, 2)}
        if not zipped:
            assert spark.read.parquet(ws.path("candidates")).count() > len(rows)  # the magic inside of payloads was seen
    assert warc.op2(spark, pages.limit(0)).count() == 0


def test_warc_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(warc.ORACLE).fetchall()
    got = q.op2_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# -- quality


def kn_brute(counts, vocabulary):
    """Interpolated modified Kneser-Ney from a dict of trigram counts, straight from the formulas."""

    def discount(cs):
        n = Counter(c for c in cs if c <= 4)
        if not n[1]:
            return lambda c: 0.5
        y = n[1] / (n[1] + 2 * n[2])
        d = [min(k, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1]

    bi, uni = Counter((v, w) for _, v, w in counts), None
    uni = Counter(w for _, w in bi)
    d3, d2, d1 = discount(counts.values()), discount(bi.values()), discount(uni.values())

    def p(u, v, w):
        total = sum(uni.values())
        x = max(0, uni[w] - d1(uni[w])) / total if uni[w] else 0
        x += sum(map(d1, uni.values())) / total / vocabulary
        own = {b: c for (a, b), c in bi.items() if a == v}
        if own:
            x = ((own[w] - d2(own[w]) if w in own else 0) + sum(map(d2, own.values())) * x) / sum(own.values())
        own = {c: n for (a, b, c), n in counts.items() if (a, b) == (u, v)}
        if own:
            x = ((own[w] - d3(own[w]) if w in own else 0) + sum(map(d3, own.values())) * x) / sum(own.values())
        return x

    return p


def test_kneser_ney(spark):
    rng = np.random.default_rng(5)
    counts = Counter(tuple(int(x) for x in rng.integers(0, 6, 3) ** 2 % 7) for _ in range(300))
    df = spark.createDataFrame([(*k, c) for k, c in counts.items()], "u long, v long, w long, c long")
    model = quality.KneserNey(df, Workspace(spark), 9)
    every = [(u, v, w) for u in range(9) for v in range(9) for w in range(9)]
    keys = spark.createDataFrame([((u << 2 * quality.BITS) | (v << quality.BITS) | w,) for u, v, w in every], "key long")
    got = {r.key: 10**r.logp for r in model.log10(keys).collect()}
    p = kn_brute(counts, 9)
    for u, v, w in every:
        assert math.isclose(got[(u << 2 * quality.BITS) | (v << quality.BITS) | w], p(u, v, w), rel_tol=1e-9)
    for u in range(9):
        assert math.isclose(sum(p(u, 1, w) for w in range(9)), 1, rel_tol=1e-9)


def test_quality(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(quality, "LANGUAGE_ROWS", 30)
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = q.op3_quality(spark, d).join(labels, "doc_id").collect()
    assert sum(not r.keep for r in got if r.quality) <= 0.02 * sum(r.quality for r in got)
    assert sum(r.keep for r in got if not r.quality) <= 0.1 * sum(not r.quality for r in got)
    for lang in {r.lang for r in got}:  # thresholds are quantiles of the language's held-out trusted texts, if it has enough of them
        own = [r.adjusted for r in got if r.lang == lang and r.quality and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.n_tokens > 1]
        limit = {r.threshold for r in got if r.lang == lang}
        if len(own) >= quality.LANGUAGE_ROWS:
            assert len(limit) == 1 and abs(np.quantile(np.floor(np.array(own) * 1000) / 1000, quality.FLOOR) - limit.pop()) < 2e-3
    real = spark.read.parquet(f"{d}/documents.parquet")
    mixed = real.select("doc_id", "text", "lang", "source").unionByName(docs.selectExpr("doc_id + 1000000 doc_id", "text", "lang", "source"))
    out = quality.assess(mixed, labels)
    assert out.count() == mixed.count() and all(r.keep for r in out.where("n_tokens <= 1").collect())
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.count() == len(ODD) and kept.columns == docs.columns
    assert quality.assess(empty, labels).count() == 0


def test_quality_learns_from_all_trusted_texts(spark):
    ids = spark.range(26_000).withColumnRenamed("id", "doc_id")
    own = quality.trusted_rows(ids.selectExpr("doc_id", "'en' lang", "'a text' text"), ids.selectExpr("doc_id", "1 quality"))
    assert sorted(r.doc_id for r in own.collect()) == [i for i in range(26_000) if zlib.crc32(str(i).encode()) % 5]


# -- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 16))
    near = base[:60] + 0.15 * rng.standard_normal((60, 16))
    group = base[399] + 0.05 * rng.standard_normal((150, 16))
    v = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(np.concatenate([base, near, group, np.repeat(base[5:6], 40, 0)]))]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 15 + [None]), (2003, [float("nan")] * 16), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (2006, []), (2007, [float("inf")] * 16)]
    df = spark.createDataFrame([(*x, 1) for x in v + odd], "vec_id long, embedding array<float>, node int")
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    links, label = links_of(np.array([r[1] for r in v], np.float64))
    assert [got[i].n_links for i in range(len(v))] == links
    assert [got[i].component_id for i in range(len(v))] == label
    assert [got[i].n_links for i in range(2000, 2008)] == [0, 0, 0, 0, 1, 1, 0, 0] and got[2005].component_id == 2004
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def links_of(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    return s.sum(1).tolist(), simhash.spanning(len(x), iter([np.nonzero(s)])).tolist()


def rows_of(df):
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect())
    return [n for _, n, _ in got], [c for _, _, c in got]


def groups_of_vectors(rng, sizes, dim=24, spread=0.07):
    return np.concatenate([rng.standard_normal(dim) + spread * rng.standard_normal((n, dim)) for n in sizes]).astype(np.float32).astype(np.float64)


def test_neighbours_in_groups_of_many_sizes(spark):
    x = groups_of_vectors(np.random.default_rng(21), [1] * 600 + [2, 3, 5, 9, 10, 11, 12, 25] * 12 + [150, 700])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    assert rows_of(df) == links_of(x)


def test_neighbours_behind_full_lists(spark):
    """Dense groups whose only links are those between a few border members, whose lists are full of closer ones."""
    rng, rows = np.random.default_rng(22), []
    for _ in range(12):
        a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
        for middle, border in ((0.0, 0.3), (0.95, 0.63)):  # angles: the middles are 0.95 apart, links reach 0.45
            angles = np.concatenate([middle + 0.01 * rng.standard_normal(30), border + 0.003 * rng.standard_normal(14)])
            rows += [math.cos(t) * a + math.sin(t) * b + 0.004 * rng.standard_normal(24) for t in angles]
    x = np.array(rows).astype(np.float32).astype(np.float64)
    want = links_of(x)
    assert len(set(want[1])) == 12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert rows_of(df) == want


def test_neighbours_without_descent(spark, monkeypatch):
    """If the descent finds nothing, the audit says so each turn, and all vectors are compared."""
    x = groups_of_vectors(np.random.default_rng(23), [1] * 100 + [2, 3, 11, 30] * 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "descend", lambda nodes, *a, **k: (spark.createDataFrame([], neighbours._EDGES), None))
    monkeypatch.setattr(neighbours, "AUDIT", 20)
    recalls, audit = [], neighbours.audit
    monkeypatch.setattr(neighbours, "audit", lambda *a: recalls.append(audit(*a)) or recalls[-1])
    monkeypatch.setattr(neighbours, "REST", 100)
    assert rows_of(df) == links_of(x)
    assert len(recalls) == neighbours.MOST_ROUNDS and all(r < 0.9 for r, _ in recalls)


# -- mixing


def test_mixing_sql(spark, docs, empty):
    con = duckdb.connect()
    for df in (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source"), docs.select("doc_id", "text", "source")):
        documents = df.toArrow()
        con.register("documents", documents)
        want = con.sql(mixing.ORACLE).fetchall()
        got = mixing.op5(df).collect()
        key = lambda r: tuple("~" if x is None or x != x else f"{x:.9g}" for x in r)
        assert sorted(map(key, got)) == sorted(map(key, want))
        total = sum(r["size"] for r in got)
        assert abs(sum(r.taken for r in got) - 1.5 * total) <= sum(sorted(r["size"] for r in got)[-5:])
    assert mixing.op5(empty).count() == 0


def test_curriculum_and_copies(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    mixed = mixing.mixed(docs).collect()
    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: r.copies for r in out if r.copies})
    late = Counter()
    for k, r in enumerate(mixed):
        late[r.source, k >= len(mixed) / 2] += 1
    assert late["s0", False] > late["s0", True] and late["s2", False] < late["s2", True]  # weights fall and rise
    assert [r.doc_id for r in mixed] == [r.doc_id for r in mixing.mixed(docs.repartition(7)).collect()]


def test_repeated_rows_have_their_own_copies(spark):
    rows = [(i // 2 if i < 40 else None if i < 80 else i, f"{i} " + "w " * (i % 5), f"s{i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[key(r), r["size"]] += r.copies
    got = Counter((key(r), len(words(r.text))) for r in mixing.mixed(docs).collect())
    assert got == +want and mixing.mixed(docs).columns == docs.columns


# -- SimHash


def test_fingerprint_by_brute_force():
    for text in [r[1] for r in ODD if r[1] != LONG] + ["a", "a b c d", "A a a A a a A"]:
        w = words(text)
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_bucket_counts_rule_out_no_similar_sets():
    rng = np.random.default_rng(14)
    sets = []
    for n in (1, 4, 5, 9, 60, 700, 3000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for share in (1.0, 0.97, 0.9, 0.85, 0.8, 0.7, 0.5):
            m = max(1, round(n * share))
            sets.append(np.unique(np.concatenate([x[:m], rng.integers(0, 1 << 63, int(rng.integers(0, 2 + n - m)), dtype=np.uint64)])))
    sets.append(np.arange(70_000, dtype=np.uint64) * np.uint64(simhash.BUCKETS))  # fills a bucket
    sets.append(sets[-1][:60_000])
    counts = np.stack([np.frombuffer(simhash.held(x), "<u2") for x in sets])
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j]
    near = np.array([len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 0.8 * len(set(sets[i].tolist()) | set(sets[j].tolist())) for i, j in pairs])
    assert near.tolist() == [simhash.similar(sets[i], sets[j]) for i, j in pairs]
    may = simhash.may_be_similar(counts, np.array([len(x) for x in sets]), *np.array(pairs).T)
    assert not (near & ~may).any() and may.sum() < 2 * near.sum()


def test_near_pairs_with_pruning(monkeypatch):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a[:500] ^ np.array([1 << int(x) | 1 << int(y) for x, y in rng.integers(0, 64, (500, 2))], np.uint64)
    monkeypatch.setattr(simhash, "BRANCH_PAIRS", 1000)
    got = {(int(x), int(y)) for i, j in simhash.near_pairs(a, b) for x, y in zip(i, j)}
    d = np.bitwise_count(a[:, None] ^ b[None, :])
    assert got == {tuple(map(int, x)) for x in np.argwhere(d <= 4)}


@pytest.mark.parametrize("natives,visitors", [(100_000, 30_000), (7, 5)])
def test_links_join_all_that_is_near(spark, monkeypatch, natives, visitors):
    monkeypatch.setattr(simhash, "NATIVES", natives)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres] + [c ^ np.array([1 << int(x) for x in rng.integers(0, 64, 30)], np.uint64) for c in centres[:20]] + [np.zeros(1, np.uint64)]))
    ws = Workspace(spark)
    for levels in (1, 2):
        edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), ws, levels=levels)
        got = {r.node: r.component for r in components(ws, edges, f"l{levels}").collect()}
        s = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
        label = simhash.spanning(len(fps), iter([np.nonzero(s)]))
        groups = lambda f: {frozenset(g) for g in f.values() if len(g) > 1}
        mine, want = {}, {}
        for i, x in enumerate(fps.view(np.int64).tolist()):
            mine.setdefault(got.get(x, x), set()).add(x)
            want.setdefault(label[i], set()).add(x)
        assert groups(mine) == groups(want)


def test_simhash_rows(spark, docs, empty):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op6(docs).collect()]
    assert len(got) == len(ODD)
    by = {i: (f, c) for i, f, c in got}
    assert by[0][1] == by[4][1] == 0 and by[1] == by[2] == by[5] == ("0" * 16, 1)
    kept = simhash.keep_one(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "3", "6", "None"] and kept.columns == docs.columns
    assert simhash.keep_one(empty).count() == 0
    assert simhash.op6(empty).count() == 0


def test_vantage_points_of_the_data_lose_no_pair(monkeypatch):
    rng = np.random.default_rng(8)
    random = rng.integers(0, 1 << 63, (1500, 2), dtype=np.uint64)
    copies = [random[k] ^ np.array([[1 << int(x), 1 << int(y)] for x, y in rng.integers(0, 63, (500, 2))], np.uint64) for k in range(3)]
    prints = tuple(np.concatenate([random, *copies]).T.copy())
    rank, every = rng.permutation(3000), np.arange(3000)
    monkeypatch.setattr(simhash, "BRANCH_PAIRS", 1000)
    a, b = every[::2], every[1::2]
    met = np.zeros((3000, 3000), int)
    for x, y in simhash.met(prints, a, b, rank, simhash.NEAR):
        met[np.ix_(x, y)] += 1
    near = simhash.apart(prints, a, b) <= simhash.NEAR
    met = met[np.ix_(a, b)]
    assert near.sum() > 3 * 200**2 and (met[near] == 1).all() and met.max() == 1
    assert (met == 0).sum() > 0.15 * met.size  # pairs that the bound spares: of visitors out of the groups with the groups' members


@pytest.mark.parametrize("pairs", [4_000_000, 100])
def test_keep_one_of_short_texts_with_far_fingerprints(spark, monkeypatch, pairs):
    monkeypatch.setattr(simhash, "BRANCH_PAIRS", pairs)
    rows = []
    for n in (855, 2297, 7779):  # 4 of 5 shingles in common, yet more than 40 bits of 128 differ
        w = [f"{n}x{i}" for i in range(9)]
        rows += [(2 * n, " ".join(w[:8])), (2 * n + 1, " ".join(w))]
    rows += [(-i, " ".join(f"{i}y{k}" for k in range(8))) for i in range(1, 300)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i < 0 or i % 2 == 0)


# -- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.tokenizer_path())


def test_bpe_equals_the_library(spark, docs, empty, library):
    odd = ["it's we'll  I'M 'twas ''s a'sb 'rex 've", "Σίσυφος ΣΑΣ İstanbul ﬁ Å é ½x²3", "a<|endoftext|>b <|startoftext|>", "\x1c\x1d a\x85b ​　c 日本語 ١٢٣ 🙂🙂x", "don't!'s '' 's", "'", "a" * 5000, "<|endoftext|>"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rng = np.random.default_rng(11)
    long = ["".join(rng.choice(list("abcdetheringé日'x1-"), int(n)).tolist()) for n in rng.integers(80, 4000, 20)]
    df = df.union(spark.createDataFrame([(200 + i, t) for i, t in enumerate(long)], "doc_id long, text string"))
    texts = df.collect()
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    for share in (1e-6, 0.02, 2.0):  # all words, some and none in the lexicon
        assert Counter(map(tuple, bpe.digest(df, q.tokenizer_path(), share).collect())) == want
    ids = bpe.encode(df, q.tokenizer_path())
    back = {r.doc_id: r.text for r in bpe.decode(ids, q.tokenizer_path()).collect()}
    assert back[105] == library.decode(library.encode("'").ids, skip_special_tokens=False)
    assert bpe.digest(empty, q.tokenizer_path()).count() == 0


def test_long_words_take_little_more_than_linear_time():
    vocab = bpe.Vocabulary(open(q.tokenizer_path(), encoding="utf-8").read())
    word = bytes(np.random.default_rng(13).choice(list(b"etaoinshrdlu"), 1_000_000).tolist())
    began = time.process_time()
    assert sum(len(vocab.text[i]) for i in vocab.merge(word)) == len(word) + len(bpe.END)
    assert time.process_time() - began < 60


def test_transducer_is_minimal_and_ranks(tmp_path):
    vocab = bpe.Vocabulary(open(q.tokenizer_path(), encoding="utf-8").read())
    rng = np.random.default_rng(15)
    some = {bytes(rng.choice(list(b"abcdexyz"), int(n)).tolist()) for n in rng.integers(1, 9, 4000)}
    for w in (sorted({b"tap", b"taps", b"top", b"tops", b"a", b"aps", b"stops"}), sorted(some), [b"x"], []):
        _, moves_of, final = bpe.minimal_transducer(w)
        assert len(final) - 1 == len(minimal_states(w)) or not w
        (tmp_path / "lexicon").write_bytes(bpe.Lexicon.compile(w, vocab))
        lexicon = bpe.Lexicon(str(tmp_path / "lexicon"))
        place = {x: k for k, x in enumerate(w)}
        every = [*w, *(x + b"a" for x in w), *(x[:-1] for x in w if len(x) > 1), b"\xc3\xa9", b"q"]
        got = lexicon.ranks(bpe.Words([x.decode() for x in every]))
        assert got.tolist() == [place.get(x, -1) for x in every]
        assert len(lexicon.owner) <= 1.3 * sum(len(m[0]) for m in moves_of) + 4096 + 600


def minimal_states(w):
    """Different sets of continuations of all prefixes: the states of the minimal automaton."""
    return {frozenset(x[len(p) :] for x in w if x.startswith(p)) for x in w for p in (x[:i] for i in range(len(x) + 1))}


# -- media


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_matroska_round_trip(lacing):
    rng = np.random.default_rng(lacing)
    frames = [rng.bytes(int(n)) for n in rng.integers(1, 900, 300)]
    if lacing == media.FIXED_LACING:
        frames = [f[:50].ljust(50, b"x") for f in frames]
    data = media.mux(frames, frame_ms=20, lacing=lacing, per_block=1 if not lacing else 8)
    out = media.demux(data)
    assert [data[p.start : p.end] for p in out["packets"]] == frames
    assert out["tracks"] == [[1, "A_PCM/INT/LIT"]] and len(out["cues"]) == len(out["clusters"])
    per = 1 if not lacing else 8
    assert [p.timestamp for p in out["packets"]] == [i // per * per * 20 for i in range(len(frames))]


def test_media_rows(spark, docs, empty):
    for r in media.media_digest(docs).collect():
        text = next(t for i, t, *_ in ODD if i == r.doc_id) or ""
        data = text.encode()
        padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert media.media_digest(empty).count() == 0
    stored = media.store(docs.where("doc_id in (2, 3)"))
    packets = media.packet_table(stored)
    assert packets.where("doc_id = 2").count() == 1 and packets.where("doc_id = 3").count() == -(-len(LONG) // 576)
    bad = spark.createDataFrame([(1, bytearray(b"\x1aE\xdf")), (2, None), (3, bytearray(media.media_of("x")[:-30]))], "doc_id long, media binary")
    assert all(r.track is None and r.error for r in media.packet_table(bad).collect())


# -- personal data

PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == 1:
        return all(int(x) <= 255 for x in m.split("."))
    if kind == 2:
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == 0 or 9 <= len(d) <= 15


def base(t):
    return sorted((m.start(), k, m.end()) for k in range(4) for m in PLAIN[k].finditer(t or "") if holds(k, m[0]))


def test_personal_data(spark, docs, empty):
    rng = np.random.default_rng(6)
    odd = ["a@b.c_d@e.f x@y.z.w@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111-4111-1111-1111-1111 4111111111111111", "+1 (319) 555-5132- +49-89 1234567.8 +1 2", "é🙂 a@b.co é 10.0.0.1 🙂+44 20 7946 0958", "1" * 20000, "a" * 20000 + "@" + "b." * 5000, "1-" * 6000, "1.2.3." * 2000, "x@y"]
    odd += ["".join(rng.choice(list("ab1234.@-+ ()_%é🙂5"), 250)) for _ in range(200)]
    told = [f"Meet Zorblax {w} at zorb@x.org {w} {v}" for w, v in (("alpha", "one"), ("beta", "two"), ("gamma", "three"), ("delta", "four"))]
    copies = ["Copied Quibblefuzz text with same@x.org in it"] * 6
    word = lambda x: "".join("abcdefghij"[int(c)] for c in str(x))
    long = ["n" + word(x) for x in rng.integers(0, 10**6, 200)]
    for k in range(30):  # near copies of one text
        new = list(long)
        for at in rng.integers(20, 200, 4):
            new[at] = "m" + word(k)
        copies.append(" ".join([*new[:10], "Snorkelwump", "near@x.org", *new[10:]]))
    fields = [" ".join(["Name: Petrovacz Phone: +1 319 555 0102", *("q" + word(x) for x in rng.integers(0, 10**6, 12))]) for _ in range(8)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*odd, *told, *copies, *fields, "Zorblax alone", *(f"we meet by name or phone {k}" for k in range(12))])], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.op9(df).collect():
        want = base(texts[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        said = texts[r.doc_id] or ""
        extra = [x for x in r.spans.split(",") if x.startswith("term")]
        assert [said[int(x.split(":")[1]) : int(x.split(":")[2])] for x in extra] == ["Zorblax"] * said.count("Zorblax") + ["Petrovacz"] * said.count("Petrovacz")
        assert [x for x in r.spans.split(",") if x and x not in extra] == ([x for x in text.split(",") if x])
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[1000 + len(odd)] == "Meet <TERM> alpha at <EMAIL> alpha one" and clean[1] is None and clean[3] == LONG
    assert pii.op9(empty).count() == 0


# -- hidden Markov model


def all_paths(m, s):
    total = 0.0
    for path in np.ndindex(*(len(m.pi),) * len(s)):
        p = m.pi[path[0]] * m.b[s[0], path[0]]
        for t in range(1, len(s)):
            p *= m.a[path[t - 1], path[t]] * m.b[s[t], path[t]]
        total += p
    return total


def test_forward_by_brute_force(monkeypatch):
    rng = np.random.default_rng(8)
    m = hmm.Model.from_counts(rng.random(3), rng.random((3, 3)), rng.random((5, 3)), np.full(5, 0.2))
    sequences = [rng.integers(0, 5, n) for n in (1, 2, 7, 3, 4, 8)]
    for piece in (512, 3, 2):
        monkeypatch.setattr(hmm, "PIECE", piece)
        for s, g in zip(sequences, hmm.likelihood(sequences, m)):
            assert math.isclose(g, math.log10(all_paths(m, s)), rel_tol=1e-9)


def test_expected_counts_are_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(18)
    m = hmm.Model.from_counts(rng.random(3), rng.random((3, 3)), rng.random((5, 3)), np.full(5, 0.2))
    sequences = [rng.integers(0, 5, n) for n in (7, 1, 6, 3)]
    pi, a, b = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in sequences:
        whole = all_paths(m, s)
        for path in np.ndindex(*(3,) * len(s)):
            p = m.pi[path[0]] * m.b[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.a[path[t - 1], path[t]] * m.b[s[t], path[t]]
            pi[path[0]] += p / whole
            for t in range(len(s)):
                b[s[t], path[t]] += p / whole
                if t:
                    a[path[t - 1], path[t]] += p / whole
    for piece, side in ((512, 500_000), (2, 500_000), (3, 4), (1, 2)):
        monkeypatch.setattr(hmm, "PIECE", piece)
        monkeypatch.setattr(hmm, "SIDE_BY_SIDE", side)
        got = hmm.expected(sequences, m)
        assert np.allclose(got[0], pi) and np.allclose(got[1], a) and np.allclose(got[2], b)
        assert math.isclose(got[3], sum(math.log10(all_paths(m, s)) for s in sequences))


def test_expected_counts_raise_the_likelihood():
    rng = np.random.default_rng(9)
    sequences = [np.repeat(rng.integers(0, 6, 8), 4) for _ in range(40)]
    share = np.full(6, 1 / 6)
    m, last = hmm.first_guess([], share, 3), -1e18
    for _ in range(10):
        pi, a, b, total = hmm.expected(sequences, m)
        assert math.isclose(b.sum(), 40 * 32) and math.isclose(a.sum(), 40 * 31) and math.isclose(pi.sum(), 40)
        assert total > last - 1
        m, last = hmm.Model.from_counts(pi, a, b, share * 1e-3), total


def test_score_by_all_paths(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) ** 2 % 11}" for k in range(i % 9))) for i in range(60)] + [(61, None), (None, "w1 never seen w1"), (3, "w1 W2 uniquE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(hmm, "OWN_SHARE", 0.05)
    monkeypatch.setattr(hmm, "PIECE", 3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    v, coded, _ = hmm.prepare(docs, Workspace(spark))
    m = hmm.train(coded, v, states=2)
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    of = {w: v.of(w) for w in {w for _, t in rows for w in words(t)}}
    assert 0 < len(v.own) < len(c)
    want = Counter()
    for i, t in rows:
        p = all_paths(m, [*(of[w] for w in words(t)), v.classes - 1])
        for w in words(t):
            own = [x for x in c if of[x] == of[w]]
            p *= (c[w] + 0.1) / (sum(c[x] for x in own) + 0.1 * (len(own) + 1))
        want[i, f"{math.log10(p):.7f}"] += 1
    for frequent in (hmm.FREQUENT, 3, 0):
        assert Counter((r.doc_id, f"{r.score:.7f}") for r in hmm.score(docs, states=2, frequent=frequent).collect()) == want


def test_scores(spark, docs, empty):
    got = hmm.op10(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c, ends = Counter(), 0
    for i, t, *_ in ODD:
        if not held(i):
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    texts = {i: t for i, t, *_ in ODD}
    assert len(got) == len(ODD)
    for r in got:
        w = words(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        want = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and math.isfinite(r.score) and r.score <= 0
    assert hmm.op10(empty).count() == 0


# -- pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        ws = Workspace(spark)
        out = ws.save(stage(spark, docs, SF), name)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == names
        sizes.append(out.count())
        docs = out
    assert sizes[0] >= sizes[1] == sizes[2] and sizes[3] == sizes[4] and "n_tokens" in docs.columns
    assert not set(q.oracle_sql()) - set(q.queries())


def kept_by_quality(docs, good):
    """Which documents the classifier keeps, from the formulas: counts in dicts, one document after the other."""
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 for r in docs}
    trusted = [r for r in docs if r.doc_id in good and fold[r.doc_id]]
    n = Counter(w for r in trusted for w in (r.text or "").split())
    own = {w: quality.OWN + k for k, w in enumerate(sorted(w for w, c in n.items() if c >= max(2, quality.OWN_SHARE * sum(n.values()))))}
    code = quality.Tokens(own)
    parts = lambda x: [(int(k) >> 2 * quality.BITS, int(k) >> quality.BITS & (1 << quality.BITS) - 1, int(k) & (1 << quality.BITS) - 1) for k in quality.trigrams(x)]
    tri = Counter(k for r in trusted for k in parts(code(r.text)))
    orders = [tri, Counter((v, w) for _, v, w in tri)]
    orders.append(Counter((w,) for _, w in orders[1]))

    def discounts(cs):
        m = Counter(c for c in cs if c <= 4)
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        return [0, *(min(k, max(0.05, k - (k + 1) * y * m[k + 1] / m[k])) if m[1] and m[k] else 0.5 for k in (1, 2, 3))]

    levels = []
    for counts in orders:
        d, total, left = discounts(counts.values()), Counter(), Counter()
        for k, c in counts.items():
            total[k[:-1]] += c
            left[k[:-1]] += d[min(c, 3)]
        levels.append((counts, d, total, left))

    def p(key):
        x = 1 / (quality.OWN + len(own))
        for size, (counts, d, total, left) in zip((1, 2, 3), levels[::-1]):
            k = key[3 - size :]
            if total[k[:-1]]:
                c = counts.get(k, 0)
                x = ((c - d[min(c, 3)] if c else 0) + left[k[:-1]] * x) / total[k[:-1]]
        return x

    scored = []
    for r in docs:
        keys = parts(code(r.text))
        scored.append((r, len(keys), sum(math.log10(p(k)) for k in keys)))
    held = [(m, t) for r, m, t in scored if r.doc_id in good and not fold[r.doc_id]]
    middle = np.quantile([math.floor(t / m * 1000) for m, t in held if m > 20], 0.5) / 1000
    drawn = lambda m, t: (t + middle * quality.PRIOR) / (m + quality.PRIOR)
    least = np.quantile([math.floor(drawn(m, t) * 1000) for m, t in held if m > 1], quality.FLOOR) / 1000
    return [r for r, m, t in scored if m <= 1 or drawn(m, t) >= least]


def test_pipeline_by_brute_force(spark, library):
    """Each stage's result, given what the one before kept, against plain Python, a DuckDB query and the tokenizers library."""
    stages = dict(pytest.importorskip("corpus_pipeline").STAGES)
    ws = Workspace(spark)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs, labels = given.collect(), spark.read.parquet(f"{SF}/labels.parquet").collect()
    worst = {}
    for r in labels:
        worst[r.doc_id] = min(worst.get(r.doc_id, 1), r.quality)
    assert len(worst) < quality.LANGUAGE_ROWS * 5  # so the threshold is that of all languages
    rows = lambda df: sorted(map(tuple, df.collect()))
    kept = kept_by_quality(docs, {i for i, q_ in worst.items() if q_ == 1})
    one = ws.save(stages["quality"](spark, given, SF), "one")
    assert rows(one) == sorted(map(tuple, kept)) and len(kept) < len(docs)
    sets = [{tuple(words(r.text)[i : i + 5]) for i in range(max(1, len(words(r.text)) - 4))} for r in kept]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.8 * len(a | b)]
    label = simhash.spanning(len(kept), [tuple(np.array(near).T)] if near else [])
    first = {}
    for r, k in sorted(zip(kept, label), key=lambda x: x[0].doc_id):
        first.setdefault(k, r)
    two = ws.save(stages["near_duplicates"](spark, one, SF), "two")
    assert rows(two) == sorted(map(tuple, first.values())) and len(first) < len(kept)
    three = ws.save(stages["personal_data"](spark, two, SF), "three")
    spans = {r.doc_id: r.spans for r in pii.op9(two).collect()}
    clean = {r.doc_id: r for r in three.collect()}
    assert len(clean) == len(first)
    for r in first.values():
        text, at = "", 0
        found = base(r.text)
        assert [x for x in spans[r.doc_id].split(",") if x and not x.startswith("term")] == [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found]
        if "term" not in spans[r.doc_id]:
            for a, k, b in found:
                text, at = text + r.text[at:a] + ("" if a < at else f"<{pii.KINDS[k].upper()}>"), max(at, b)
            assert clean[r.doc_id].text == text + r.text[at:] and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
    four = ws.save(stages["mixing"](spark, three, SF), "four")
    con = duckdb.connect()
    con.register("documents", three.toArrow())
    copies = {i: taken // size for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE}) WHERE size > 0").fetchall()}
    mixed = four.collect()
    assert Counter(r.doc_id for r in mixed if words(r.text)) == +Counter(copies) and all(tuple(r) == tuple(clean[r.doc_id]) for r in mixed)
    want = Counter()
    for r in mixed:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, stages["encoding"](spark, four, SF).collect())) == want


@pytest.mark.parametrize("natives,visitors", [(100_000, 30_000), (40, 30)])
def test_pipeline_keeps_one_of_similar_shingles(spark, monkeypatch, natives, visitors):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(simhash, "NATIVES", natives)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    rng = np.random.default_rng(12)
    rows = []
    for g in range(40):
        text = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(6, 160)))]
        for _ in range(6):
            new = list(text)
            for at in rng.integers(0, len(text), int(rng.integers(0, 1 + len(text) // 25))):
                new[at] = f"n{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(new)))
    text = [f"v{x}" for x in rng.integers(0, 3000, 120)]
    for _ in range(150):  # a large group of near copies, many of which aren't similar to each other
        new = list(text)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            new[at] = f"m{rng.integers(0, 99)}"
        rows.append((len(rows), " ".join(new)))
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (None, "alone"), (None, "alone"), (900, None), (901, " ")]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {""} for w in ((t or "").split() for _, t in rows)]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = simhash.spanning(len(rows), iter([np.nonzero(near)]))
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(label[k], []).append((i is None, i or 0))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(5)
    got = corpus_pipeline.stage_near_duplicates(spark, df, SF)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(min(g) for g in groups.values())
    assert got.columns == df.columns
    assert corpus_pipeline.stage_near_duplicates(spark, df.limit(0), SF).count() == 0
