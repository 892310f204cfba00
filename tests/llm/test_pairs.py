"""Joins, packing and vectors against brute force, with awkward rows."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecore.llm import packing
from tidecore.llm.gram_join import contact_gram_join, contact_histories
from tidecore.llm.grid_join import near_profiles
from tidecore.llm.nearest import nearest_profiles
from tidecore.llm.packing import best_fit, complete_bins, pack_lists
from tidecore.llm.tokens import token_lists, with_crc
from tidecore.operators.components import components

HISTORY = "u long, contacts array<string>, component long, gram string"
PROFILE = "u long, profile array<double>, label int, component string"


def grams(words, n=5):
    words = [w for w in words or [] if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def joined(rows, num=3, den=4):
    """Brute force: set size, smallest reachable id and links of every row."""
    sets = [grams(words) for _, words in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if both and both * den >= num * either:
            links[i] += 1
            links[j] += 1
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    out = []
    for i, (u, _) in enumerate(rows):
        names = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        out.append((u, len(sets[i]), min(names) if names else None, links[i]))
    return sorted(out, key=str)


def near_copies(seed, groups=8, size=14):
    rng = np.random.default_rng(seed)
    rows, u = [], 0
    passage = [f"c{i}" for i in range(30)]
    for _ in range(groups):
        base = [f"w{rng.integers(10_000)}" for _ in range(int(rng.integers(3, 80)))]
        if rng.random() < 0.5:
            base = passage + base[:20]
        for _ in range(int(rng.integers(1, size))):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(10_000)}"
            rows.append((u, words))
            u += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_gram_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame([(u, w, 7, "g") for u, w in rows], HISTORY)
    assert sorted(map(tuple, contact_gram_join(df).collect()), key=str) == joined(rows)


def test_gram_join_awkward_rows(spark):
    long = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, []), (3, ["a"]), (4, ["a", "", None]), (5, ["a", "b"]), (None, ["a", "b"]), (6, long), (7, long[1:]), (7, long[1:]), (8, [None]), (None, ["z"])]
    df = spark.createDataFrame([(u, w, 7, None) for u, w in rows], HISTORY)
    assert sorted(map(tuple, contact_gram_join(df).collect()), key=str) == joined(rows)
    assert contact_gram_join(df.limit(0)).collect() == []


def test_gram_join_other_threshold_and_edges(spark):
    rows = near_copies(5, groups=4)
    df = spark.createDataFrame([(u, w, 7, "g") for u, w in rows], HISTORY)
    assert sorted(map(tuple, contact_gram_join(df, similarity=(1, 2)).collect()), key=str) == joined(rows, 1, 2)
    edges = spark.createDataFrame([(1, 10 + i, i) for i in range(9)] + [(2, 10 + i, 50 + i) for i in range(9)] + [(3, 1, 5)], "src long, dst long, ts long")
    got = {r.u: r.component for r in contact_gram_join(contact_histories(edges)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (5, None), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- packing ---------------------------------------------------------------


def least_bins(items, capacity):
    """Fewest bins by trying everything."""
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= items[i]:
                place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - items[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_is_valid_and_never_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(10, 40))
    items = sorted(rng.integers(1, capacity + 1, int(rng.integers(1, 11))).tolist(), reverse=True)
    counts = np.bincount(items, minlength=capacity + 1)
    plan = complete_bins(counts, capacity)
    assert all(sum(p) <= capacity for p, _ in plan)
    assert sorted(n for p, t in plan for n in p * t) == sorted(items)
    used = sum(t for _, t in plan)
    assert least_bins(items, capacity) <= used <= sum(t for _, t in best_fit([int(c) for c in counts], capacity))


def test_bin_completion_beats_best_fit():
    items = [7, 6, 5, 5, 4, 3]  # best-fit decreasing needs four blocks of ten
    assert sum(t for _, t in complete_bins(np.bincount(items, minlength=11), 10)) == least_bins(sorted(items, reverse=True), 10) == 3


def test_pack_lists(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, 50_000, int(n)).tolist()) for i, n in enumerate(rng.integers(0, 150, 300))]
    rows += [(900, None), (901, []), (902, list(range(1000))), (902, list(range(1000))), (None, [1, 2, 3])]
    df = spark.createDataFrame([(u, x, 1) for u, x in rows], "u long, neighbours array<int>, block int").repartition(3)
    got = pack_lists(df, 100).collect()
    blocks = {}
    for r in got:
        blocks.setdefault(r.block, []).append((r.offset, r.length))
        assert len(r.entries) == 4 * r.length
    for parts in blocks.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    total = sum(len(x or []) for _, x in rows)
    assert len(blocks) <= -(-total // 100) + 1
    want = sorted((-1 if u is None else u, tuple(x)) for u, x in rows if x)
    lists, pending = [], {}
    for r in sorted(got, key=lambda r: (-1 if r.u is None else r.u, r.piece)):
        pending.setdefault((-1 if r.u is None else r.u, r.piece), []).append(np.frombuffer(r.entries, "<u4").tolist())
        assert r.start == (0 if r.piece == 0 else ((r.start - 0)))
    for (u, piece), bodies in pending.items():
        if piece == 0:
            for k, body in enumerate(bodies):
                whole, p = list(body), 1
                while (u, p) in pending:
                    whole += pending[(u, p)][k]
                    p += 1
                lists.append((u, tuple(whole)))
    assert sorted(lists) == want
    assert pack_lists(df.limit(0), 100).collect() == []


def test_fillings_without_an_exact_one_are_all_tried():
    counts = np.zeros(2049, int)
    counts[[1100, 600, 470]] = 300, 300, 600
    assert sum(t for _, t in complete_bins(counts, 2048)) == 400


def test_nearly_full_blocks_meet_small_pieces_of_other_files(spark):
    rows = [(i, [1] * 95) for i in range(40)] + [(100 + i, [2] * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "u long, neighbours array<int>").coalesce(1)
    df = df.where("u < 100").union(df.where("u >= 100"))  # two partitions
    assert pack_lists(df, 100).select("block").distinct().count() == 40


def test_blocks_that_cannot_be_filled_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ENTRIES", 500)
    df = spark.createDataFrame([(i, [i] * (55 + i % 40)) for i in range(60)], "u long, neighbours array<int>").repartition(3)
    got = pack_lists(df, 100).collect()
    assert sorted((r.u, r.length) for r in got) == [(i, 55 + i % 40) for i in range(60)]
    assert len({r.block for r in got}) == 60 and {r.offset for r in got} == {0}
    copies = spark.createDataFrame([(i, [i] * 34) for i in range(60)], "u long, neighbours array<int>").repartition(2)
    assert 30 <= pack_lists(copies, 100).select("block").distinct().count() <= 31


def test_token_ids_are_those_of_tokenizers(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(150).collect()]
    texts += ["", None, " ", "a  b\n\n c\t", "it's <|endoftext|> 12 345é 　x", "x" * 5000]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "u int, text string")
    for r in token_lists(df).collect():
        assert r.neighbours == own.encode(texts[r.u] or "", add_special_tokens=False).ids + [0]
    one = with_crc(pack_lists(token_lists(df.where("u = 0")), 2048)).first()
    ids = own.encode(texts[0], add_special_tokens=False).ids + [0]
    assert one.ids_crc32 == zlib.crc32(np.array(ids[: one.length], "<u4").tobytes())


# --- vectors ---------------------------------------------------------------


def clusters(seed, n=400, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, width))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.3, 1.0], (n, 1))
    return [(i, v.tolist()) for i, v in enumerate(x)]


ODD = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [float("inf")] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0])]


def test_near_profiles_equals_brute_force(spark, monkeypatch):
    rows = clusters(3)
    rows += [(500, rows[0][1]), (501, rows[0][1]), (501, rows[0][1]), (502, [3 * v for v in rows[1][1]])]
    df = spark.createDataFrame([(u, p, 1, "c") for u, p in rows + ODD], PROFILE).repartition(4)
    got = sorted(map(tuple, near_profiles(df, 0.9).collect()))
    x = np.array([p for _, p in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    names = [u for u, _ in rows]
    want = []
    for i, (u, _) in enumerate(rows):
        low = min(names[k] for k in range(len(rows)) if label[k] == label[i])
        want.append((u, int(near[i].sum()), low, u == low))
    want += [(u, 0, u, True) for u, _ in ODD]
    assert got == sorted(want)
    assert near_profiles(df.limit(0)).collect() == []


def test_nearest_profiles(spark):
    rows = clusters(4, 600)
    rows += [(700, rows[5][1]), (701, rows[5][1])]
    df = spark.createDataFrame([(u, p, 1, "c") for u, p in rows + ODD + [(None, [1.0] * 16)]], PROFILE)
    got = nearest_profiles(df, F.col("u") % 20 == 0, k=5).collect()
    ids, x = np.array([u for u, _ in rows]), np.array([p for _, p in rows])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        dist = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        dist[ids == q] = np.inf
        want = ids[np.lexsort((ids, dist))[:5]]
        own = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [r.distance for r in own] == sorted(r.distance for r in own)
        for r in own:
            assert r.distance == pytest.approx(dist[ids == r.u][0], rel=1e-12)
        hits += len(set(want) & {r.u for r in own})
        total += 5
    assert hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [1.0, 1.0], 1, ""), (2, [1.0, 1.0], 1, "")], PROFILE)
    assert [(r["query"], r["rank"], r.u) for r in nearest_profiles(few, F.col("u") == 0, k=10).collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nearest_profiles(df.limit(0), F.lit(True)).collect() == []

