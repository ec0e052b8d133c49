"""Benchmark decontamination as a prefix-filtered set join.

A window is 13 consecutive words of an item (an item of fewer words is one window). As a set it
holds its shingles of five words (all its words, if fewer). A document can hold a window only if it
holds each of them, so for exact containment the necessary prefix is one shingle: the rarest.

1. All documents are counted for the shingles of all windows (shingles that occur nowhere rule their
   windows out), and each window's shingles are ordered by that count.
2. Documents give the places of prefix shingles with the words around them, places with the same words as one row of at most
   PLACES of them; these join the windows on the shingle's hash. The window's start follows from the shingle's place in it, and has to lie
   inside the document with all its length (positional and length bounds).
3. The words there are compared with the window's words, so that hashes decide nothing.

Only a bitmap of fixed size goes to the tasks that read texts. The joins have no cap; windows are
broadcast when their measured size is small and are otherwise joined by salted hash.

Words are lower-cased (A-Z) runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Null and empty texts have no
words and are never contaminated. Every row of documents gives one row, with equal or null ids too.
An item without words has no window; an item whose id is null hits words, but is not counted or
listed among items. Repeated items count once for each id. Texts of any length are read whole in one task, which holds at most
PLACES places and PLACES_BYTES of words about them (a text of one word a million times has one place in every word). Without documents there
are no rows; without items nothing is contaminated. Only id and text of either table are read by score(), so other columns may have any
name; keep() returns all of them.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

WINDOW, SHINGLE = 13, 5
#: Windows of up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 16
#: What a task holds of places before it sends them on.
PLACES, PLACES_BYTES = 1 << 18, 16 << 20
SCANNED = "row long, doc_id long, text_hash long, n_words long, some boolean, h long, gap int, around string, places array<int>"
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


NAMES = [c.split()[0] for c in SCANNED.split(", ")]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def hashes_of(text: bytes | None) -> np.ndarray:
    """Hashes of words_of(text)."""
    return common.text_hashes(text.translate(_TABLE) if text else None)


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """item_id, window (its words, space-joined), n and the hashes of its shingles, all distinct."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, sizes, hashes = [], [], [], []
        for i, t in zip(batch.column("item_id").to_pylist(), common.utf8(batch.column("text"))):
            words = words_of(t)
            for a in range(max(1, len(words) - size + 1) if words else 0):
                w = words[a : a + size]
                ids.append(i)
                texts.append(b" ".join(w).decode())
                sizes.append(len(w))
                hashes.append(common.shingle_hashes(common.text_hashes(b" ".join(w)), min(SHINGLE, len(w))).view(np.int64).tolist())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["item_id", "window", "n", "hashes"])

    picked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return common.map_batches(picked, work, "item_id long, window string, n int, hashes array<long>").distinct()


def _places(h: np.ndarray, sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and length of the shingles that the bitmap lets through, from the words' hashes."""
    found = []
    for k in sizes:
        s = common.shingle_hashes(h, k)
        at = np.flatnonzero(common.in_bitmap(bits, s))
        found.append((s[at].view(np.int64), at, np.full(len(at), k)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def shingle_counts(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """How often each of the shingles (column h) occurs in all documents; 0 is left out."""
    bits = common.bitmap(shingles, "h")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_places(hashes_of(t), sizes, bits)[0] for t in common.utf8(batch.column("text"))]
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

    counts = common.map_batches(docs.select("text"), work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counts.join(shingles, "h", "left_semi")


def scan(part: pa.RecordBatch, number: int, sizes: list[int], bits: np.ndarray, size: int):
    """A row for each text of a slice, and rows for the places of prefix shingles in it with the words about them."""
    counts, some = [], []
    held: dict[tuple, array] = {}
    n = room = 0

    def emit() -> pa.RecordBatch:
        keys = list(held)
        columns = [pa.array([k[0] for k in keys], pa.int64()), *(pa.nulls(len(keys), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
        columns += [pa.array([k[i] for k in keys], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.string()))]
        columns.append(pa.array([np.frombuffer(x, np.int32) for x in held.values()], pa.list_(pa.int32())))
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    for i, t in enumerate(common.utf8(part.column("text"))):
        hashes = hashes_of(t)
        places = _places(hashes, sizes, bits)
        counts.append(len(hashes))
        some.append(len(places[0]) > 0)
        words = words_of(t) if some[-1] else []
        for h, at, k in zip(*places):
            low = max(0, int(at) + int(k) - size)
            key = (number + i, int(h), int(at) - low, b" ".join(words[low : at + size]).decode())
            if key not in held:
                held[key] = array("i")
                room += len(key[3])
            held[key].append(at)
            n += 1
            if n >= PLACES or room >= PLACES_BYTES:
                yield emit()
                n = room = 0
    if held:
        yield emit()
    m = part.num_rows
    columns = [pa.array(np.arange(number, number + m)), part.column("doc_id"), part.column("text_hash"), pa.array(counts, pa.int64()), pa.array(some, pa.bool_())]
    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(m, t) for t in (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())))], names=NAMES)


def matches(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row a document, verified windows by document row and start, windows by item)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    by_item = common.stored(item_windows(items, item_id, item_text, size), "windows")
    windows = by_item.groupBy("window").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    sizes = sorted(r.k for r in by_item.select(F.least(F.col("n"), F.lit(SHINGLE)).alias("k")).distinct().collect())
    each = windows.select("window", "n", F.posexplode("hashes").alias("offset", "h"))
    counts = shingle_counts(docs, each.select("h").distinct(), sizes)
    counted = each.withColumnRenamed("n", "size").join(counts, "h", "left").withColumn("times", F.coalesce("n", F.lit(0).cast("long")))
    rarest = counted.groupBy("window").agg(F.min(F.struct("times", "h", "offset")).alias("p"), F.first("size").alias("size"))
    prefix = common.stored(rarest.filter("p.times > 0").select("window", "size", "p.h", "p.offset"), "prefixes")
    bits = common.bitmap(prefix, "h")

    def work(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in common.slices(batch, "text"):
                for rows in scan(part, number, sizes, bits, size):
                    yield rows
                number += part.num_rows

    common.ship(spark)
    rows = common.stored(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(work, SCANNED), "scanned")
    places = rows.filter("h is not null").select("row", "h", "gap", "around", "places")
    # the hash of a prefix may be that of a very common passage: broadcast the windows, or salt both sides
    width = prefix.agg(F.sum(F.octet_length("window") + 64).alias("b")).first().b or 0
    if width <= BROADCAST_BYTES:
        joined = places.join(F.broadcast(prefix), "h")
    else:
        salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = places.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    # around has gap words before the shingle, and ends where the text ends
    same = F.array_join(F.slice(F.split("around", " "), F.col("gap") - F.col("offset") + 1, F.col("size")), " ") == F.col("window")
    met = joined.filter(F.col("gap") >= F.col("offset")).filter(same).select("row", F.explode("places").alias("at"), "offset", "size", "window")
    hits = met.select("row", (F.col("at") - F.col("offset")).alias("start"), "size", "window").distinct()
    return rows.filter("h is null").drop("h", "gap", "around", "places"), common.stored(hits, "hits"), by_item


def score(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row for each document: words, words hit, items found, and whether it is contaminated.

    text_hash is xxhash64 of the text, by which callers find the rows again.
    """
    rows, hits, by_item = matches(docs, items, doc_id, text, item_id, item_text, size)
    end = F.col("start") + F.col("size")
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    spans = hits.select("row", "start", "size").distinct().withColumn("new", new).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    ids = by_item.filter("item_id is not null").select("window", "item_id")
    found = hits.select("row", "window").distinct().join(ids, "window").select("row", F.col("item_id").cast("string").alias("i")).distinct()
    lists = found.groupBy("row").agg(F.count("i").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("i"))).alias("items"))
    some = rows.filter("some").join(spans, "row", "left").join(lists, "row", "left")
    none = rows.filter("not some").select("*", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return some.unionByName(none).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), "text_hash",
    )


def keep(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """The rows of docs whose text is not contaminated, with all their columns; rows are found again by id and text hash."""
    bad = score(docs, items, doc_id, text, **columns).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, (F.xxhash64(docs[text]) == bad["__hash"]) & docs[doc_id].cast("long").eqNullSafe(bad["__id"]), "left_anti")
