"""Name variants, ranked search and robust outliers against brute force, with awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecore.llm import outliers, ranked
from tidecore.llm.gram_join import contact_histories
from tidecore.llm.outliers import robust_outliers, vertex_measures
from tidecore.llm.ranked import rank_histories
from tidecore.llm.text_measures import text_measures
from tidecore.llm.variants import name_variants, written_names


def one_edit(a, b):
    """Whether two strings differ by exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, length=5, least=3, ratio=2):
    """Brute force over all pairs."""
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    near = {w: sorted((v for v in words if one_edit(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: vs[0] for w, vs in near.items() if vs and words[vs[0]] >= ratio * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


@pytest.mark.parametrize("seed, symbols", [(1, 4), (2, 1), (3, 16)])
def test_variants_equal_brute_force(spark, seed, symbols):
    rng = random.Random(seed)
    counts = {}
    for _ in range(400):
        w = "".join(rng.choice("abcdé") for _ in range(rng.randint(4, 8)))
        counts[w] = counts.get(w, 0) + rng.choice([1, 2, 3, 5, 9, 20, 60])
    rows = [(w, n, 1, "x") for w, n in counts.items()]
    df = spark.createDataFrame(rows, "name string, n long, id long, code string")
    assert sorted(map(tuple, name_variants(df, symbols=symbols).collect())) == variants(counts)


def test_variants_awkward_rows(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    counts = {"z" * 4000: 3, "z" * 4001: 7, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, long: 9, long[:2500] + long[2501:]: 3, "": 9, "abc": 50, "\U0001f600bcde": 4, "xbcde": 8, "lonely": 2}
    rows = [*counts.items(), ("aaaaa", None), (None, 7), ("lonely", 0)]
    df = spark.createDataFrame(rows, "name string, n long")
    assert sorted(map(tuple, name_variants(df).collect())) == variants(counts)
    split = spark.createDataFrame([("aaaaaa", 1)] * 6 + [("aaaaa", 1)] * 3, "name string, n int")
    assert sorted(map(tuple, name_variants(split).collect())) == variants({"aaaaaa": 6, "aaaaa": 3})
    assert name_variants(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        name_variants(df, ratio=1)


def test_slips_in_vertex_names_of_raw_edges(spark):
    edges = spark.createDataFrame([(10_001, 20_000 + i, i) for i in range(9)] + [(10_011, 30_000 + 17 * i, i) for i in range(3)] + [(None, 10_001, 3)], "src long, dst long, ts long")
    got = {r.name: (r.n, r.form) for r in name_variants(written_names(edges)).collect()}
    assert got == {"10001": (10, None), "10011": (3, "10001")}


def test_op13_makes_the_names_that_its_contract_says(spark):
    from tidecore.llm.search_queries import runs

    docs = spark.createDataFrame([(i, "Abécd xyzzy-" + "Qwertz " * (i % 3), "t") for i in range(200)], "doc_id long, text string, name string")
    want = {}
    for i in range(200):
        for run in ["abécd", "xyzzy"] + ["qwertz"] * (i % 3):
            h = zlib.crc32(f"{i}:{run}".encode())
            w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            want[w] = want.get(w, 0) + 1
    assert {r["name"]: r.n for r in runs(docs).groupBy("name").agg(F.sum("n").alias("n")).collect()} == want
    assert runs(spark.createDataFrame([(None, "plain"), (7, None), (8, "")], "doc_id long, text string")).count() == 1


# --- ranked search -----------------------------------------------------------

HISTORY = "u long, contacts array<string>, query long, score long"
ASKED = "query long, contacts array<string>, u long"


def ranks(histories, queries, k=10):
    """Brute force: every history scored for every query."""
    docs = [(u, [w for w in ws or [] if w]) for u, ws in histories if u is not None]
    docs = [(u, ws) for u, ws in docs if ws]
    n_docs, words = len(docs), sum(len(ws) for _, ws in docs)
    asked = {}
    for q, ws in queries:
        if q is not None:
            asked.setdefault(q, []).extend(w for w in ws or [] if w)
    out = []
    for q, terms in asked.items():
        scores = []
        for u, ws in docs:
            m = 25 + 75 * len(ws) * n_docs // words
            score = 0
            for t in terms:
                df = sum(t in x for _, x in docs)
                tf = ws.count(t)
                score += int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, u))
        out += [(q, r, u, -s) for r, (s, u) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def searched(seed):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 500}"
    docs = [(i, [word() for _ in range(rng.choice([1, 3, 20, 200]))]) for i in range(150)]
    docs += [(200 + i, list(docs[9][1])) for i in range(30)]  # copies: equal scores
    queries = [(q, [word() for _ in range(rng.randint(1, 40))]) for q in range(12)] + [(50, docs[9][1])]
    return docs, queries


@pytest.mark.parametrize("block, step", [(1 << 16, 2048), (60, 7)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block, step):
    monkeypatch.setattr(ranked, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(ranked, "TERM_STEP", step)
    monkeypatch.setattr(ranked, "QUERY_TERMS", 40 * step)
    docs, queries = searched(3)
    df = spark.createDataFrame([(u, ws, 5, 5) for u, ws in docs], HISTORY).repartition(3)
    asked = spark.createDataFrame([(q, ws, 1) for q, ws in queries], ASKED)
    assert sorted(map(tuple, rank_histories(df, asked).collect())) == ranks(docs, queries)


def test_bounds_are_never_below_the_score_and_hardly_above(spark):
    docs, queries = searched(4)
    rows = ranked.signature_index(spark.createDataFrame(docs, "u long, contacts array<string>")).toArrow()
    df = spark.createDataFrame(queries, "query long, contacts array<string>")
    asked = ranked._asked(df).orderBy("query", "term").toArrow()
    known = spark.createDataFrame(docs, "u long, contacts array<string>")
    batch = ranked.QueryBatch(asked, ranked.frequencies(known, asked["term"].to_numpy()), len(docs), sum(len(w) for _, w in docs))
    exact = {(q, u): s for q, _, u, s in ranks(docs, queries, len(docs))}
    total, seen = 0, set()
    for ids, n, width, slices in ranked._blocks(rows.to_batches()):
        for lo, _hi, bound in ranked.bounds(ids, n, width, slices, batch):
            for (i, j), b in np.ndenumerate(bound):
                key = (int(batch.names[lo + i]), int(ids[j]))
                assert b >= exact.get(key, 0)
                total += b
                seen.add(key)
    assert len(seen) == len(docs) * len(queries) and total < 1.1 * sum(exact.values())


def test_ranked_search_awkward_rows(spark):
    docs = [(1, None), (2, []), (3, ["a"]), (3, ["a", "b"]), (4, ["a", "", None, "b"]), (None, ["a"]), (5, ["b"] * 30_000), (6, ["z"] + [f"x{i}" for i in range(30_000)]), (7, ["z"])]
    queries = [(1, ["a", "a", "q"]), (1, ["b"]), (2, None), (3, []), (None, ["a"]), (4, ["unseen"]), (5, ["z", ""])]
    df = spark.createDataFrame([(u, ws, None, None) for u, ws in docs], HISTORY)
    asked = spark.createDataFrame([(q, ws, None) for q, ws in queries], ASKED)
    assert sorted(map(tuple, rank_histories(df, asked).collect())) == ranks(docs, queries)
    assert rank_histories(df.limit(0), asked).collect() == [] == rank_histories(df, asked.limit(0)).collect()


def test_ranked_search_of_contact_histories(spark):
    edges = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 11, 3), (2, 10, 4), (2, 12, 5), (3, 12, 6), (4, 13, 7)], "src long, dst long, ts long")
    histories = contact_histories(edges)
    asked = histories.where("u = 3").select(F.lit(3).alias("query"), "contacts")
    assert [r.u for r in rank_histories(histories, asked).orderBy("rank").collect()] == [3, 2]


# --- robust outliers ---------------------------------------------------------


def estimates(x, p):
    """The documented estimate of one group in numpy: standardised scores, mean, inverse and unit."""
    x = np.arcsinh(np.asarray(x, float))
    n = len(x)
    bins = np.sort(np.floor(x * outliers.VALUE_BINS), axis=0)
    at = lambda s: bins[math.ceil(s * n) - 1]
    centre = (at(0.5) + 0.5) / outliers.VALUE_BINS
    spread = np.maximum((at(0.75) - at(0.25)) / (outliers.VALUE_BINS * 1.349), outliers.NOISE)
    z = (x - centre) / spread
    noise = np.diag((outliers.NOISE / spread) ** 2)
    bin_of = lambda d: np.floor(np.log2(np.maximum(d, 2.0**-20)) * outliers.DISTANCE_BINS)
    square = lambda m, s: ((z - m) @ np.linalg.inv(s) * (z - m)).sum(1)
    edge = lambda b: np.sort(b)[math.ceil(outliers.CORE_SHARE * n) - 1]

    def again(m, s, limit=None):
        b = bin_of(square(m, s))
        top = edge(b)
        if limit is not None:
            top = np.floor(top + outliers.DISTANCE_BINS * math.log2(limit / outliers.chi2_quantile(outliers.CORE_SHARE, p)))
        near = z[b <= top]
        return near.mean(0), near.T @ near / len(near) - np.outer(near.mean(0), near.mean(0)) + noise

    tanh, sign = np.tanh(z), z / np.maximum(np.sqrt((z * z).sum(1)), 1e-6)[:, None]
    fits = [(np.zeros(p), np.eye(p)), (np.zeros(p), tanh.T @ tanh / n + noise), (np.zeros(p), sign.T @ sign / n + noise)]
    for _ in range(outliers.FIRST_STEPS):
        fits = [again(*f) for f in fits]
    best = min(fits, key=lambda f: np.linalg.slogdet(f[1])[1])
    for _ in range(outliers.MORE_STEPS):
        best = again(*best)
    best = again(*best, limit=outliers.chi2_quantile(0.975, p))
    unit = max(1.0, 2.0 ** ((edge(bin_of(square(*best))) + 1) / outliers.DISTANCE_BINS) / outliers.chi2_quantile(outliers.CORE_SHARE, p))
    return np.sqrt(square(*best) / unit)


def test_chi_squared_quantiles():
    assert abs(outliers.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(outliers.chi2_quantile(0.975, 4) - 11.143287) < 1e-5


def test_outliers_equal_a_plain_version_and_resist_a_bad_fifth(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g, (name, size) in enumerate([("a", 300), ("b", 150), ("c", 60), ("d", 60), (None, 130)]):
        good = np.exp(rng.multivariate_normal([1 + g, 2, 0], [[0.3, 0.25, 0], [0.25, 0.3, 0], [0, 0, 0.1]], size))
        good[: size // 5] = [400.0, 1.0, 300.0]  # a cluster of bad rows
        good[size // 5 :, 2] = 0 if name == "b" else good[size // 5 :, 2]  # a constant measure
        rows += [("x", name, *map(float, v), 1) for v in good]
    df = spark.createDataFrame(rows, "lang string, source string, m1 double, m2 double, m3 double, bin int")
    got = robust_outliers(df, ["m1", "m2", "m3"], ["lang", "source"]).collect()
    pools = {}
    for r in got:
        pools.setdefault("c" if r.source in ("c", "d") else r.source, []).append(r)
    for rs in pools.values():
        want = estimates([(r.m1, r.m2, r.m3) for r in rs], 3)
        assert np.allclose([r.distance for r in rs], want, rtol=1e-6)
        bad = np.array([r.m1 == 400.0 for r in rs])
        marked = np.array([r.outlier for r in rs])
        assert marked[bad].all() and marked[~bad].mean() < 0.02


def test_outliers_awkward_rows(spark):
    rows = [(i, "t", float(i % 7), 1.0) for i in range(150)] + [(900, "t", None, 1.0), (901, "t", float("nan"), 2.0), (902, "t", float("inf"), 2.0), (903, "few", 1.0, 1.0), (None, None, 2.0, 1e9)]
    df = spark.createDataFrame(rows, "u long, dataset string, m double, _key double")
    got = {r.u: (r.distance, r.outlier) for r in robust_outliers(df.withColumnRenamed("_key", "k"), ["m", "k"], ["dataset"]).collect()}
    assert got[900] == got[901] == got[902] == got[903] == got[None] == (None, False)
    assert not any(o for _, o in got.values())
    assert robust_outliers(df.limit(0).select("u", "dataset", "m"), ["m"], ["dataset"]).collect() == []
    with pytest.raises(ValueError):
        robust_outliers(df.withColumn("outlier", F.lit(1)), ["m"], ["dataset"])
    same = spark.createDataFrame([(i, 5.0) for i in range(200)], "u long, m double")  # no groups, one value
    assert {(r.distance < 2, r.outlier) for r in robust_outliers(same, ["m"], []).collect()} == {(True, False)}


def test_outliers_of_vertex_activity(spark):
    rng = random.Random(2)
    edges = [("d1", u, 1000 + rng.randrange(50), rng.randrange(10_000)) for u in range(150) for _ in range(20 + rng.randrange(10))]
    edges += [("d1", 999, 1000, 5) for _ in range(4000)]  # one vertex that only ever writes to one other, at one time
    df = spark.createDataFrame(edges, "dataset string, src long, dst long, ts long")
    got = robust_outliers(vertex_measures(df, ("dataset",)), ["edges", "partners", "span"], ["dataset"])
    marked = {r.u for r in got.where("outlier").collect()}
    assert 999 in marked and len(marked) < 5


def counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(inside))


def test_text_measures_equal_plain_counts(spark, sf_dir):
    rng = random.Random(1)
    made = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "l\nl\n\n l\nl", "é#<ß> | \x0b y\x0cz"]
    made += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(40)] + ["w" * 50_000 + " q" * 3000]
    made += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(made)], "u long, text string, n_chars long")
    got = {r.u: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in text_measures(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(made)}
    with pytest.raises(ValueError):
        text_measures(df.withColumn("n_words", F.lit(1)))


def test_op12_and_op11_on_their_tables(spark, sf_dir):
    from tidecore.llm.search_queries import op11, op12

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, _, repeated, again = counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, repeated, again)
        assert r.base_failed == (n < 20 or 100 * again > 30 * n) and not (r.kept and r.base_failed)
    assert op11(spark, sf_dir).columns == ["item_id", "rank", "doc_id", "score"]
