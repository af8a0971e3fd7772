"""Spelling variants, hard negatives and near-duplicate vectors, held against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlake.llm import blocks, negatives, spelling, tiles

CLASHING = ("id", "word", "n", "key", "vec", "place", "block", "label2", "node", "part", "own", "window", "anchor", "curve")


def _one_edit(u: str, v: str) -> bool:
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    p = 0
    while p < min(len(u), len(v)) and u[p] == v[p]:
        p += 1
    return u[p + (len(u) >= len(v)) :] == v[p + (len(v) >= len(u)) :]


# Spelling


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.text("abé", max_size=7)), max_size=40))
def test_scan_of_a_sorted_list(listed):
    listed = sorted(set(listed))
    group, rests = np.array([g for g, _ in listed], "i8"), [w for _, w in listed]
    got = list(zip(*(x.tolist() for x in spelling.near_in_sorted(group, rests)), strict=True))
    want = {(i, j) for i, (g, u) in enumerate(listed) for j, (h, v) in enumerate(listed) if g == h and _one_edit(u, v)}
    assert set(got) == want and len(got) == len(want)


def _variants(rows):
    """By the words of the contract, and all pairs."""
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if _one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = [n, len(near), form, words[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = (*out[w], root)
    return out


def _texts(seed, docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeéÀÿ") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["ABCDEFG", "abcdefghi", "zzzzzz"]
    rows = []
    for k in range(docs):
        words = [rng.choice(stems[: rng.randint(1, len(stems))]) for _ in range(150)]
        words = [w[:-1] + rng.choice("abe") if rng.random() < 0.05 else w for w in words]
        rows.append((k, rng.choice([" ", ", ", "1"]).join(words)))
    return [*rows, (None, "abcdefghi " * 7), (3, None), (4, ""), (5, "x" * 300_000 + " "), (6, "chains " * 6 + "chainst " * 40 + "chainist " * 300), rows[0], rows[0]]


@pytest.mark.parametrize("most", [20_000, 6])
def test_variants_equal_brute_force(spark, monkeypatch, most):
    """Also when groups are split until little is left to halve."""
    monkeypatch.setattr(spelling, "near_words", lambda words, f=spelling.near_words: f(words, most, 50))
    rows = _texts(most)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in CLASHING})
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(df).collect()}
    want = _variants(rows)
    assert got == want
    assert sum(w[2] is not None for w in want.values()) > 10 and any(w[4] != w[2] for w in want.values() if w[2])


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0


# Blocks


def test_hilbert_curve_visits_every_cell_by_single_steps():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = blocks.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def _vectors(seed, n=300, d=9):
    """Random vectors, chains and groups of near copies, and copies of one vector."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(0, n - 20, 20):
        x[k + 1 : k + 9] = x[k] + rng.normal(size=(8, d)) * np.linspace(0.02, 0.3, 8)[:, None]
    x[-30:] = x[7]
    x[-5:] = 3 * x[8]
    return [(int(i), [float(v) for v in row], int(rng.integers(0, 3))) for i, row in enumerate(x)]


ODD = [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan"), 1.0], 1), (1003, [float("inf"), 1.0], 2), (1004, [0.0] * 9, 0), (1005, [], 1), (1006, [2.0], 1), (1007, [2.0, 0.0], None), (1100, [0.5] * 9, 0)]
VECTORS = "vec_id long, embedding array<double>, label int"


def _good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def _padded(v, d=9):
    return np.array([*v, *[0.0] * (d - len(v))])


# Near-duplicate vectors


def _near(rows, least):
    able = [k for k, r in enumerate(rows) if _good(r[1]) and any(r[1])]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in able:
        for b in able:
            x, y = _padded(rows[a][1]), _padded(rows[b][1])
            if a != b and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links[a] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        ids[root(k)].append(r[0])
    return sorted((r[0], links[k], min(ids[root(k)]), r[0] == min(ids[root(k)])) for k, r in enumerate(rows))


@pytest.mark.parametrize(("block", "tile"), [(4096, 512), (32, 8)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(tiles, "BLOCK", block)
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "HEAD", 3)
    rows = [*_vectors(block), *ODD, ODD[0], ODD[6]]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit("clash") for c in CLASHING})
    got = tiles.near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = _near(rows, 0.95)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(n > 20 for _, n, _, _ in want) and sum(not k for *_, k in want) > 50


def test_boxes_keep_far_blocks_apart(spark, monkeypatch):
    """Two bunches of directions: no block of one meets a block of the other."""
    monkeypatch.setattr(tiles, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(64, 6)) * 0.05 + np.eye(6)[k] for k in (0, 3)])
    rows = [(k, [float(v) for v in row], 0) for k, row in enumerate(x)]
    seen = []
    monkeypatch.setattr(tiles, "_near_blocks", lambda packs, least, f=tiles._near_blocks: seen.append(f(packs, least).count()) or f(packs, least))
    assert sorted(tuple(r) for r in tiles.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()) == _near(rows, 0.95)
    assert seen == [2 * (4 * 5 // 2)]


def test_vectors_of_no_use(spark):
    assert tiles.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(5, None, 1), (None, [0.0, 0.0], 1), (6, [], None)]
    assert sorted(map(tuple, tiles.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=str) == sorted([(5, 0, 5, True), (None, 0, None, True), (6, 0, 6, True)], key=str)


# Hard negatives


def _mined(rows, every):
    q = {}
    for i, v, label in rows:
        if i is not None and label is not None and _good(v):
            q.setdefault(i, (label, np.floor(256 * _padded(v)).astype(int)))
    out = []
    for a, (label, x) in q.items():
        if a % every:
            continue
        score = lambda b: int(x @ q[b][1])  # noqa: B023, E731
        order = sorted((b for b in q if b != a), key=lambda b: (-score(b), b))
        for p in [b for b in order if q[b][0] == label][:5]:
            fits = [b for b in order if q[b][0] != label and 80 * score(p) <= 100 * score(b) <= 100 * score(p)][:5]
            out += [(a, p, k, b, score(p), score(b)) for k, b in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "group", "atlas"), [(4096, 256, 1024), (32, 4, 2)])
def test_mined_equal_brute_force(spark, monkeypatch, block, group, atlas):
    for name, value in (("BLOCK", block), ("GROUP", group), ("ATLAS", atlas)):
        monkeypatch.setattr(negatives, name, value)
    rows = [*_vectors(3), *ODD, (None, [1.0] * 9, 1), ODD[-1]]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit("clash") for c in CLASHING})
    got = negatives.mine(df, F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows, 10)
    assert len(_mined(rows, 10)) > 300


def test_zone_maps_choose_blocks(spark, monkeypatch):
    """Bunches that lie far apart: an anchor does not read the blocks of the others."""
    for name, value in (("BLOCK", 16), ("GROUP", 4), ("ATLAS", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(64, 6)) * 0.05 + np.eye(6)[k] for k in range(6)])
    rows = [(k, [float(v) for v in row], k % 2) for k, row in enumerate(x)]
    seen = []
    monkeypatch.setattr(negatives, "_needed", lambda *a, f=negatives._needed: seen.append(f(*a).agg(F.sum(F.size("who"))).first()[0]) or f(*a))
    got = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("id") % 8 == 0)
    assert sorted(tuple(r) for r in got.collect()) == _mined([(i, [*v, 0, 0, 0], k) for i, v, k in rows], 8)
    assert len(seen) == 2 and max(seen) < 48 * 24 / 2, seen


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_hold_all_scores(seed):
    rng = np.random.default_rng(seed)
    b = rng.integers(-300, 300, (20, 5)).astype(float)
    a = rng.integers(-300, 300, (6, 5)).astype(float)
    least, most = negatives.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    s = negatives.scores(a, b)
    assert (least <= s).all() and (s <= most).all()
    large = np.full((1, 4), float(negatives.LARGEST))
    assert negatives.scores(large + 1, large)[0, 0] == 4 * (negatives.LARGEST + 1) * negatives.LARGEST


def test_no_anchors(spark):
    for rows in ([], [(1, [1.0], 1)], [(10, None, 1)], [(10, [1.0], 1)]):
        assert negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("id") % 10 == 0).count() == 0
