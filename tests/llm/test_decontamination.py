"""Decontamination against brute force, with edge cases."""

import hashlib

import pytest

from millrace.llm import common, decontamination

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def brute(docs, items, size=13):
    windows = {}
    for i, t in items:
        w = [x.decode() for x in decontamination.words_of(t.encode() if t else None)]
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add(i)
    out = []
    for d, t in docs:
        w = [x.decode() for x in decontamination.words_of(t.encode() if t else None)]
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                ids = windows.get(tuple(w[a : a + n]))
                if ids:
                    hit |= set(range(a, a + n))
                    found |= ids
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, item_id string, window int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    got = decontamination.score(d, b)
    return sorted((tuple(r)[:6] for r in got.collect()), key=str), decontamination.keep(d, b)


DOCS = [
    (1, "intro " + ITEM.upper() + " outro"), (2, "nothing here"), (3, None), (4, ""), (None, ITEM), (5, ITEM.replace("beta", "bets")),
    (6, "short item!"), (6, "a short\titem, and more " + "w " * 5), (7, ITEM + " , " + ITEM), (7, ITEM + " , " + ITEM), (8, "é１ x-y 12" + " z" * 300 + " " + ITEM),
    (9, "rep rep rep rep rep"), (10, "w " * 30 + "rep rep rep"), (11, "short"), (12, ITEM[:60]), (13, "\x00" + ITEM.replace(" ", "--")), (14, "a" * 100000 + " " + ITEM),
]
ITEMS = [(1, ITEM), (10, "Short item"), (2, ITEM), (2, ITEM), (3, None), (4, "!!"), (None, "rep rep rep"), (11, "x y"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu")]


def test_edges(spark):
    got, kept = run(spark, DOCS, ITEMS)
    assert got == brute(DOCS, ITEMS)
    assert kept.columns == ["doc_id", "text", "item_id", "window"]
    clean = sorted(str(r[0]) for r in brute(DOCS, ITEMS) if not r[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean


def test_empty(spark):
    assert run(spark, [], ITEMS)[0] == []
    assert run(spark, DOCS, [])[0] == brute(DOCS, [])


def test_salted_join_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert run(spark, DOCS, ITEMS)[0] == brute(DOCS, ITEMS)


@pytest.mark.parametrize("repeat", [1])
def test_tables(spark, sf_dir, repeat):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got, _ = run(spark, docs, items)
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


def test_bitmap_has_every_hash(spark):
    df = spark.range(3000).selectExpr("xxhash64(id) as h")
    bits = common.bitmap(df, "h", 14)
    import numpy as np

    assert common.in_bitmap(bits, np.array([r.h for r in df.collect()]).view(np.uint64)).all()


def test_long_texts_of_one_word(spark, monkeypatch):
    """Each place of a text is the prefix of a window: places go out in bounded batches, and results are whole."""
    rows = [(1, "la " * 40_000), (2, "x " * 200 + "la la " * 3 + "y " * 500), (3, "la lo " * 9000 + "end"), (4, "lo la " * 10)]
    items = [(1, "la " * 15), (2, "la la la"), (3, "la lo " * 7), (4, "lo la lo la lo")]
    monkeypatch.setattr(decontamination, "PLACES", 5000)
    assert run(spark, rows, items)[0] == brute(rows, items)


def test_memory_of_a_very_long_text():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    text = "la " * 1_400_000
    h = common.shingle_hashes(decontamination.hashes_of(text[:60].encode()), 5)[:1]
    bits = np.zeros(1 << 18, np.uint64)
    slot = int(h[0] & np.uint64((1 << 24) - 1))
    bits[slot >> 6] |= np.uint64(1 << (slot & 63))
    part = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["doc_id", "text_hash", "text"])
    tracemalloc.start()
    places = sum(len(x) for batch in decontamination.scan(part, 0, [5], bits, 13) for x in batch.column("places").to_pylist() if x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert places == 1_400_000 - 4 and peak < 400e6
