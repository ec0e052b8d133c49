"""Vector codes against a plain Lloyd iteration."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import queries, vector_codes
from tests.conftest import SF_DIR


def plain(rows, parts=4, entries=256, rounds=4):
    """{vec_id: (code, error, label_error, digest)} by comparing everything with everything, in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(books[p], c[p])[1] for c in cut]
            for k, n in Counter(of).items():
                books[p][k] = [sum(c[p][j] for c, o in zip(cut, of) if o == k) // n for j in range(width)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    last = [[nearest(books[p], c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in m) for m in last]
    by_label = Counter()
    for (_, _, l), e in zip(kept, errors):
        by_label[l] += e
    return {i: ("".join(f"{k:02x}" for _, k in m), e, by_label[l], digest) for (i, _, l), m, e in zip(kept, last, errors)}


def compressed(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + extra)
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect()}


def exact(x):
    return float(np.float32(x))


def clusters(n, seed, size=8, spread=0.05):
    pick = random.Random(seed)
    middles = [[pick.uniform(-1, 1) for _ in range(size)] for _ in range(7)]
    return [(i * 3 - 5, [exact(m + pick.gauss(0, spread)) for m in pick.choice(middles)], pick.choice([1, 2, None])) for i in range(n)]


def test_equal_to_plain_lloyd(spark):
    rows = clusters(700, 1)
    # copies, ties of parts, and rows that are left out
    rows += [(5000 + i, rows[3][1], 1) for i in range(300)]
    rows += [(9000, None, 1), (9001, [None] + [0.0] * 7, 1), (9002, [float("nan")] * 8, 2), (9003, [float("-inf")] + [0.0] * 7, None)]
    random.Random(2).shuffle(rows)
    assert compressed(spark, rows) == plain(rows)


def test_few_vectors_equal_entries_and_other_columns(spark):
    rows = [(i, [0.5, 0.25, -0.5, 0.0] if i % 2 else [0.5, 0.25, -0.5, -0.001], None) for i in range(20)]
    assert compressed(spark, rows) == plain(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, codes string, of int")
    assert vector_codes.compress(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert {r.vec_id: r.code for r in vector_codes.compress(df).collect()} == {i: c[0] for i, c in plain(rows).items()}


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 2.0, 3.0, 4.0], 1), (7, [1.0, 0.0, 0.0, 0.0], 1), (7, [0.0, 1.0, 0.0, 0.0], 1), (8, [0.0] * 5, 1), (9, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in vector_codes.compress(df).collect())
    assert found == [(False, 7, "00000000", 0), (False, 7, "01010000", 0), (True, 0, "02020202", 0)] or len(found) == 3
    assert all(f[3] == 0 for f in found)


def test_empty_table(spark):
    assert compressed(spark, []) == {}
    assert compressed(spark, [(1, None, 1), (2, [float("nan")] * 4, 1)]) == {}


def test_very_large_components_stay_exact(spark):
    rows = [(i, [exact(x * 1e5 * (1 + i / 7)) if i < 3 else exact(x + i) for x in (0.5, -0.25, 0.125, 1.0)], 1) for i in range(12)]
    assert compressed(spark, rows) == plain(rows)
    huge = spark.createDataFrame([(1, [1e300, 0.0, 0.0, -1e300], 1)], "vec_id long, embedding array<double>, label int")
    assert [r.error for r in vector_codes.compress(huge).collect()] == [0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_cover_and_assign_like_brute_force(seed):
    points = np.random.default_rng(seed).integers(-50, 50, (300, 4)) // (1 if seed == 1 else 20)
    order, nodes = vector_codes.tree(points)
    assert sorted(order.tolist()) == list(range(300))
    inside = points[order]
    for n in nodes:
        far = vector_codes.squares(inside[n["begin"]][None], inside[n["begin"] : n["end"]])
        assert np.sqrt(far.max()) <= n["radius"] + 1e-9
        children = nodes[n["child"] : n["child"] + n["children"]]
        if len(children):
            assert children["begin"].tolist() == [n["begin"], *children["end"][:-1].tolist()] and children["end"][-1] == n["end"]
    book = points[:40]
    begin, end, entry, alone = vector_codes.assign(inside, nodes, book)
    for b, e, k in zip(begin, end, entry):
        assert (alone[b:e] == -1).all()
        alone[b:e] = k
    assert alone.tolist() == vector_codes.squares(inside, book).argmin(1).tolist()


def test_whole_subtrees_are_assigned():
    middles = np.random.default_rng(4).integers(-4000, 4000, (12, 16))
    points = np.repeat(middles, 80, 0) + np.random.default_rng(5).integers(-20, 20, (960, 16))
    order, nodes = vector_codes.tree(points)
    begin, end, _, alone = vector_codes.assign(points[order], nodes, middles)
    assert (alone == -1).all() and len(begin) < 100


def test_query_over_the_whole_table(spark):
    found = queries.op13_vector_codes(spark, SF_DIR)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    x = np.floor(np.array([r[1] for r in sorted(rows)], np.float64) * 1024).astype(np.int64)
    books = [x[:256, p * 16 : p * 16 + 16].copy() for p in range(4)]
    for turn in range(5):
        codes = [((x[:, p * 16 : p * 16 + 16][:, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(4)]
        if turn < 4:
            for p in range(4):
                for k in np.unique(codes[p]):
                    books[p][k] = x[codes[p] == k, p * 16 : p * 16 + 16].sum(0) // (codes[p] == k).sum()
    expected = ["".join(f"{codes[p][i]:02x}" for p in range(4)) for i in range(len(x))]
    assert [r.code for r in found.orderBy("vec_id").collect()] == expected
