"""The Jaccard join against all pairs on small tables."""

import random
import re

import numpy as np
import pytest

from millrace.llm import jaccard_join as J


def sets_of(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    s = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, x in enumerate(s):
        for g in x:
            by.setdefault(g, []).append(i)
    for i, x in enumerate(s):
        for j in {j for g in x for j in by[g] if j > i}:
            n = len(x & s[j])
            if 100 * n >= 80 * len(x | s[j]):
                root[find(j)] = find(i)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None] if s[i] else [d]
        out.append((d, len(s[i]), min(ids) if ids and ids[0] is not None or len(ids) > 0 and min((x is None, x) for x in ids)[1] is not None else None))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, label string")
    assert sorted((tuple(r)[:3] for r in J.join(df).collect()), key=str) == brute(rows)
    return df


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_edges(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a), (2, a.upper()), (2, a), (7, None), (8, ""), (9, " \t\n"), (3, "one two"), (4, "One  two"), (5, "one two three"), (None, a), (None, "alone text of null id here"), (10, "x " * 500), (11, "x " * 90), (12, "a b c d e"), (13, "é é é é é é"), (3, "one two three")]
    df = check(spark, rows)
    kept = J.keep(df)
    assert kept.columns == ["doc_id", "text", "key", "label"]
    got = sorted(str(r.doc_id) for r in kept.collect())
    assert got == sorted(["1", "7", "8", "9", "3", "3", "None", "10", "12", "13"])


def test_empty(spark):
    check(spark, [])


@pytest.mark.parametrize(("seed", "leaf"), [(1, 4), (2, 256)])
def test_chains_and_hubs(spark, seed, leaf, monkeypatch):
    """Chains of edits, a large group of near copies, and texts that are mostly one common passage."""
    monkeypatch.setattr(J, "LEAF", leaf)
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        w = words(rng, rng.randint(8, 120))
        for _ in range(rng.randint(1, 14)):
            w = list(w)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
            rows.append(w)
    hub = words(rng, 80)
    for _ in range(60):
        w = list(hub)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"h{rng.randrange(99)}"
        rows.append(w)
    passage = words(rng, 60)
    for _ in range(60):
        rows.append(passage + words(rng, rng.randint(1, 20)))
    rows += [words(rng, rng.randint(1, 50)) for _ in range(60)]
    rng.shuffle(rows)
    check(spark, [(i * 3, " ".join(w)) for i, w in enumerate(rows)])


def test_words_of_two_letters_in_thue_morse_order(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    check(spark, [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)])


def test_one_passage_in_many_unlinked_texts(spark, monkeypatch):
    """Texts that share a passage and nothing else cost far fewer distances than all pairs."""
    rng = random.Random(8)
    passage = words(rng, 45)
    rows = [(i, " ".join(passage + words(rng, 14, 10**9))) for i in range(400)]
    edited = []
    for i in range(300):
        w = list(passage) + words(random.Random(1), 55)
        for _ in range(rng.choice([1, 1, 4, 5])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
        edited.append((1000 + i, " ".join(w)))
    paths, scratch = [], J.common.scratch
    monkeypatch.setattr(J.common, "scratch", lambda s, name: paths.append(scratch(s, name)) or paths[-1])
    check(spark, rows + edited)
    (distances,) = [p for p in paths if "/distances-" in p]
    made = spark.read.parquet(distances)
    assert made.agg({"turn": "max"}).first()[0] < 16
    made = made.count()
    assert made < 20 * len(rows + edited)


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(2)
    long = words(rng, 60_000, 10**6)
    near = [w if i % 400 else "new" for i, w in enumerate(long)]
    rows = [(1, " ".join(long), 1, 2), (2, " ".join(near), 1, 2), (3, "w " * 9000, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shared int, row_doc_id_text int").withColumnRenamed("row_doc_id_text", "text_hash")
    assert sorted(tuple(r)[:3] for r in J.join(df).collect()) == brute([r[:2] for r in rows])
    assert sorted(r.doc_id for r in J.keep(df).collect()) == [1, 3] and J.keep(df).columns == df.columns


def test_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    got = {r.node: r.label for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == {k: v for k, v in root.items() if k in got}
    assert {k for k, v in root.items() if k != v} <= set(got)


def test_rows_of_slices_are_spread(spark):
    """Each slice's rows have a key of their own in the exchange, whatever partition they come from."""
    docs = spark.range(64).selectExpr("id as doc_id", "concat('a b c d e f ', id) as text", "id as text_hash").repartition(32)
    keys = J.asked(docs, 5, 10).filter("part < 0").select("slice", "part").collect()
    slices = {r.slice for r in keys}
    assert len(slices) >= 30
    assert len({r.part for r in keys}) == len(keys) == 2 * len(slices)


def test_no_pair_of_a_small_region_is_a_row(spark, tmp_path):
    """Members of a leaf meet in their group: no join makes pairs of them, and only links that connect them come out."""
    rng = random.Random(4)
    base = words(rng, 100)
    sets = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**9)}"
        sets.append(sorted({hash(tuple(w[a : a + 5])) for a in range(96)}))
    rows = [(i % 2, b"%03d" % i, len(s), s) for i, s in enumerate(sets)]
    leaves = spark.createDataFrame(rows, "region long, x binary, n long, shared array<long>")
    found = J.inside(leaves, 80, 100)
    got = [(bytes(r.x), bytes(r.p)) for r in found.collect()]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

    def roots(edges):
        of = {r[1]: r[1] for r in rows}
        for a, b in edges:
            old, new = max(of[a], of[b]), min(of[a], of[b])
            of = {k: new if v == old else v for k, v in of.items()}
        return of

    wanted = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and 100 * len(set(a[3]) & set(b[3])) >= 80 * len(set(a[3]) | set(b[3]))]
    assert len(wanted) > 200 and set(got) <= set(wanted) | {(b, a) for a, b in wanted}
    assert roots(got) == roots(wanted) and len(got) < 90
    assert J.shared_counts(np.array([1, 2, 3, 2, 3, 9, 3]), np.array([3, 3, 1, 0])).tolist() == [[2, 2, 1, 0], [2, 2, 1, 0], [1, 1, 1, 0], [0, 0, 0, 0]]


def test_edits_of_one_text_are_one_cell(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(J, "LEAF", 16)
    base = words(rng, 150)
    some = words(rng, 12)
    texts = [" ".join(rng.choice(some) if rng.random() < rate else w for w in base) for rate in (0.01, 0.02, 0.04) for _ in range(130)]
    rows = list(enumerate([" ".join(base), *texts]))
    seen, compared = [], J.compared

    def counted(pairs, *more):
        seen.append(pairs.count())
        assert sum(seen) < 4 * len(rows)
        return compared(pairs, *more)

    monkeypatch.setattr(J, "compared", counted)
    check(spark, rows)


def test_one_of_equal_texts_asks(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(words(rng, 80)) for _ in range(6)]
    rows = [(20 * i + k, t) for k in range(20) for i, t in enumerate(texts)] + [(None, texts[0]), (500, texts[1].upper())]
    held, gathered = [], J.gathered
    monkeypatch.setattr(J, "gathered", lambda *a: held.append(gathered(*a)) or held[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(10)
    assert sorted((tuple(r)[:3] for r in J.join(df).collect()), key=str) == brute(rows)
    # only a text that another one equals in all but its capitals still has partners
    assert held[0].filter("shared is not null").count() <= 3
