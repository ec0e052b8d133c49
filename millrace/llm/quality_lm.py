"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters as they are written (UTF-16 units, so every script has its own; a character beyond the
first 65536 is two units), of order ORDER. Four units are one 64-bit integer: there is no alphabet and no class to set.

* Counts: slices of trusted text count their n-grams, and a shuffle adds them up. Of trusted documents, one in HELD (by a hash of the
  id) is left out of the counts.
* Model: continuation counts of the lower orders, the counts of counts for the discounts and the totals of contexts are
  aggregations of that table, and all of them stay tables, sharded by n-gram.
* Probabilities: the distinct n-grams of all documents are joined with these tables, order by order.
* Documents: each slice of texts asks once for each of its distinct n-grams, however many of its documents have it; tasks answer a
  part of the range of n-grams each, and a join by slice (its texts, compressed, lie in a table bucketed by it and are not moved) adds them up for each document.
  What is gathered and sent grows with the input; nothing of it goes to the driver, and no n-gram is hot, as a slice asks once.
* Perplexity is per unit of the text. The threshold of a language is the QUANTILE of the perplexities of its trusted
  documents that were held out from the counts. Documents of a language without such, or of none, use the quantile over
  all that were held out; if none was, trusted documents that were counted stand in.

Null, empty and blank texts have no perplexity and are not kept. With nothing to count there is no model: nothing has
a perplexity and nothing is kept; an empty table gives no rows. Repeated rows and null ids each give their own row, and a document
is trusted if any label of its id says so; null ids are never trusted. Texts of any length are taken whole, in one task.
Ties with a threshold are kept. Of the table only the three columns named are read, so others may have any name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

ORDER, QUANTILE = 4, 0.995
UNIT = 16
#: Stands for the characters before a text's first; no character is this one.
START = "￿"
#: One trusted document in so many serves for thresholds.
HELD = 4
#: At least so many parts of the range of hashes, each answered by itself.
PARTS_BITS = 8
#: Texts of a slice, and its compression on the way.
SLICE_BYTES, LEVEL = 8 << 20, 3
#: Ids and thresholds up to so many rows (of 8 and some 30 bytes) may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
META = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("held", pa.bool_())])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each unit of all texts, one after the other, and how many each text has."""
    texts = [t or "" for t in texts]
    sizes = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 if not t.isascii() else len(t) for t in texts], np.int64)
    pad = START * (ORDER - 1)
    units = np.frombuffer((pad + pad.join(texts)).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    n = len(units) - ORDER + 1
    out = units[:n].copy()
    for i in range(1, ORDER):
        out <<= np.uint64(UNIT)
        out |= units[i : i + n]
    # the pads between texts end no n-gram
    ends = np.cumsum(sizes)[:-1] + (ORDER - 1) * np.arange(len(sizes) - 1)
    own = np.ones(n, bool)
    own[(ends[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return out[own], sizes


def distinct(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, and which of them each one is."""
    if not len(gram):
        return gram, np.zeros(0, np.int64)
    found = pa.array(gram).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram and n over all texts of docs."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, which = distinct(grams(batch.column("text").to_pylist())[0])
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(which, minlength=len(names)).astype(np.int64))], names=["gram", "n"])

    return common.map_batches(docs.select("text"), work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def tail(gram: str, order: int):
    """The last `order` units of an n-gram."""
    return F.col(gram) if order >= ORDER else F.col(gram).bitwiseAND(F.lit((1 << UNIT * order) - 1))


def context(gram: str):
    """All but the last unit of an n-gram."""
    return F.shiftrightunsigned(gram, UNIT)


def order_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, own): the discounted probability of each seen gram, and (context, weight) for backing off.

    counts has gram and n: occurrences at the highest order, continuation counts below.
    """
    c = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    y = c[0] / max(1, c[0] + 2 * c[1])
    # with too few counts of counts, a discount stays between 0 and its own count
    d1, d2, d3 = (min(i, max(0.1 * i, i - (i + 1) * y * c[i] / c[i - 1])) if c[i - 1] else 0.5 * i for i in (1, 2, 3))
    held = counts.withColumn("context", context("gram")).withColumn("d", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
    contexts = held.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
    own = held.join(contexts, "context").select("gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"))
    return own, contexts.select("context", (F.col("freed") / F.col("total")).alias("weight"))


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]] | None:
    """The tables of each order, the lowest first, or None without any character."""
    counts = common.stored(gram_counts(trusted), "grams")
    if counts.isEmpty():
        return None
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        # continuation count: in how many longer grams it is the end
        longer = levels[0]
        levels.insert(0, common.stored(longer.groupBy(tail("gram", order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams"))
    return [order_tables(c) for c in levels]


def probabilities(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """gram and log (its natural logarithm of probability after its context) for the distinct n-grams asked for."""
    lower = None
    for order, (own, weights) in enumerate(model, 1):
        here = asked.select(tail("gram", order).alias("gram")).distinct() if order < ORDER else asked.select("gram")
        here = here.join(own, "gram", "left")
        if lower is None:
            # one empty context, and below it all units alike
            below = F.lit(weights.first()["weight"] / (1 << UNIT))
            here = here.select("gram", (F.coalesce("own", F.lit(0.0)) + below).alias("p"))
        else:
            here = here.select("gram", "own", context("gram").alias("context"), tail("gram", order - 1).alias("lower"))
            here = here.join(weights, "context", "left").join(lower.withColumnRenamed("gram", "lower"), "lower")
            here = here.select("gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
        lower = common.stored(here, "probabilities")
    return lower.select("gram", F.log("p").alias("log"))


def slices(batch: pa.RecordBatch):
    return common.slices(batch, "text", SLICE_BYTES)


def part_of(gram: np.ndarray, bits: int) -> np.ndarray:
    return (common.mixed(gram) >> np.uint64(64 - bits)).astype(np.int32)


def asked(docs: DataFrame, bits: int) -> DataFrame:
    """For each slice of texts: its distinct n-grams by part of the range of their hashes (part >= 0), and its rows with their texts (part < 0)."""

    def work(batches):
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in slices(batch):
                names, _ = distinct(grams(part.column("text").to_pylist())[0])
                own = part_of(names, bits)
                order = np.argsort(own, kind="stable")
                names, own = names[order], own[order]
                cut = common.heads(own)
                rows = part.cast(pa.schema([*META, ("text", pa.string())])).serialize().to_pybytes()
                data = pa.concat_arrays([common.pack(names, np.append(cut, len(names))), pa.array([press.compress(rows)], pa.binary())])
                spread = int(common.mixed(np.array([number], np.uint64))[0] >> np.uint64(34))
                parts = np.append(own[cut], np.int32(-1 - spread)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), number)), pa.array(parts), data], names=["slice", "part", "data"])
                number += 1

    return docs.select(*META.names, "text").mapInArrow(work, "slice long, part int, data binary")


def by_part(logs: DataFrame, bits: int) -> DataFrame:
    """The table of probabilities as rows of packed (gram, log), one for each part and batch; their slice is null."""

    def work(batches):
        for batch in batches:
            gram = batch.column("gram").to_numpy().view(np.uint64)
            own = part_of(gram, bits)
            order = np.argsort(own, kind="stable")
            pairs = np.stack([gram, batch.column("log").to_numpy().view(np.uint64)], 1)[order]
            cut = common.heads(own[order])
            if len(cut):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cut), pa.int64()), pa.array(own[order][cut]), common.pack(pairs.ravel(), 2 * np.append(cut, len(pairs)))], names=["slice", "part", "data"])

    return logs.mapInArrow(work, "slice long, part int, data binary")


def answered(rows: DataFrame) -> DataFrame:
    """The slices' questions with the logarithms in place of the n-grams, in the same order."""

    def work(batches):
        for table in common.runs(batches, "part"):
            known = table.filter(table.column("slice").is_null())
            pairs = common.packed(known.column("data"))[0].reshape(-1, 2)
            pairs = pairs[np.argsort(pairs[:, 0])]
            ask = table.filter(table.column("slice").is_valid())
            names, sizes = common.packed(ask.column("data"))
            logs = pairs[np.searchsorted(pairs[:, 0], names), 1].view(np.float64).astype("<f4")
            if len(sizes):
                yield pa.RecordBatch.from_arrays([ask.column("slice").combine_chunks(), ask.column("part").combine_chunks(), common.pack(logs, np.concatenate([[0], np.cumsum(sizes)]))], names=["slice", "part", "data"])

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(work, "slice long, part int, data binary")


def summed(texts: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """doc_id, lang, trusted, held, n_chars and perplexity of each document."""

    def work(batches):
        import zstandard

        for batch in batches:
            for data, parts in zip(batch.column("data"), batch.column("answers")):
                rows = zstandard.ZstdDecompressor().decompress(data.as_py())
                rows = pa.ipc.read_record_batch(pa.py_buffer(rows), pa.schema([*META, ("text", pa.string())]))
                texts = rows.column("text").to_pylist()
                gram, sizes = grams(texts)
                names, which = distinct(gram)
                place = np.argsort(part_of(names, bits), kind="stable")
                got = sorted((x["part"], x["data"]) for x in parts.as_py() or ())
                logs = np.zeros(len(names), np.float64)
                logs[place] = np.frombuffer(b"".join(x for _, x in got), "<f4")
                sums = np.concatenate([[0.0], np.cumsum(logs[which])])[np.concatenate([[0], np.cumsum(sizes)])]
                per = np.exp(-np.diff(sums) / np.maximum(1, sizes))
                found = [float(p) if t and t.strip() else None for p, t in zip(per, texts)]
                columns = [*(rows.column(c) for c in META.names), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(found, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*META.names, "n_chars", "perplexity"])

    # one row for each part and slice, so a slice's answers are as many as its n-grams
    all_of = answers.groupBy("slice").agg(F.collect_list(F.struct("part", "data")).alias("answers"))
    out = "doc_id long, lang string, trusted boolean, held boolean, n_chars long, perplexity double"
    return texts.join(all_of, "slice", "left").select("data", "answers").mapInArrow(work, out)


def asked_for(docs: DataFrame) -> DataFrame:
    """The distinct n-grams of all documents."""

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(distinct(grams(part.column("text").to_pylist())[0])[0].view(np.int64))], names=["gram"])

    return docs.select("text").mapInArrow(work, "gram long").distinct()


def perplexities(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, trusted, held, text) with n_chars and perplexity for text."""
    model = train(docs.filter("trusted and not held"))
    if model is None:
        return docs.select("doc_id", "lang", "trusted", "held", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.lit(None).cast("double").alias("perplexity"))
    spark = docs.sparkSession
    bits = max(PARTS_BITS, (4 * common.partitions(spark) - 1).bit_length())
    logs = probabilities(common.stored(asked_for(docs), "asked"), model)
    # bucketed by slice, so that texts stay where they are when the answers come
    name = f"slices_{uuid.uuid4().hex}"
    try:
        asked(docs, bits).write.bucketBy(common.partitions(spark), "slice").option("path", common.scratch(spark, name)).saveAsTable(name)
        rows = spark.table(name)
        answers = answered(rows.filter("part >= 0").unionByName(by_part(logs, bits)))
        return common.stored(summed(rows.filter("part < 0").select("slice", "data"), answers, bits), "perplexities")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def few(df: DataFrame) -> DataFrame:
    """df to broadcast if it has no more rows than BROADCAST_IDS."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold and kept for each document.

    trusted_ids has one column of ids of trusted documents.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    ids = trusted_ids.toDF("doc_id").filter("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    marked = docs.join(few(ids), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    held = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0, F.lit(False)) & F.col("trusted")
    scored = perplexities(marked.withColumn("held", held))
    trusted = scored.filter("trusted and perplexity is not null")
    apart = trusted.filter("held")
    good = trusted if apart.isEmpty() else apart
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    everywhere = good.agg(cut.alias("any")).first()["any"]
    by_lang = common.stored(good.filter("lang is not null").groupBy("lang").agg(cut.alias("own")), "thresholds")
    # one row a language; a join on the language would put all of a common one into a task
    out = scored.join(few(by_lang), "lang", "left")
    threshold = F.coalesce("own", F.lit(everywhere).cast("double"))
    return out.select("doc_id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
