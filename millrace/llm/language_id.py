"""Language identification by rank-order n-gram profiles.

A profile is the list of the PROFILE most frequent 1-, 2- and 3-grams of letters, over words between
boundary marks, most frequent first (ties: the lesser code points first). A language's profile counts all its training
texts; a document's distance to it is the sum, over the document's own profile, of how far each n-gram
is out of place, PROFILE for those that the language's profile lacks. The nearest language wins (ties: the
first by name). The score is 1 less the distance over its greatest possible value.

Only text and a label that is not null are learned from. A text that is null or has no letter is `und` with
score 0, and so is every text when nothing was learned. Rows keep their number and id; whole texts of
any length count, and an empty table gives none. Of the table only id, text and label are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

PROFILE = 400
EDGE = 1
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """All 1-, 2- and 3-grams as integers of three 21-bit code points; EDGE stands for what parts words."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(letters()[points], points, EDGE)
    points = np.concatenate([[EDGE], points, [EDGE]])
    points = points[np.r_[True, (points[1:] != EDGE) | (points[:-1] != EDGE)]]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    two = points[:-1] << 21 | points[1:]
    three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[points[1:-1] != EDGE]
    return np.concatenate([points[points != EDGE], two, three])


def top(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return values[np.lexsort((values, -counts))[:size]]


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram and rank (from 0) of each language's profile; docs has text and lang."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang):
            g, n = (np.concatenate(x) for x in zip(*held[lang]))
            values, where = np.unique(g, return_inverse=True)
            return values, np.bincount(where, n, len(values)).astype(np.int64)

        for batch in batches:
            for part in common.slices(batch, "text"):
                by: dict[str, list[np.ndarray]] = {}
                for t, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    by.setdefault(lang, []).append(grams(t))
                for lang, found in by.items():
                    held.setdefault(lang, []).append(np.unique(np.concatenate(found), return_counts=True))
                    if len(held[lang]) >= 16:
                        held[lang] = [merged(lang)]
        for lang in held:
            values, n = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n)], names=["lang", "gram", "n"])

    labelled = docs.filter("lang is not null and text is not null").select("text", "lang")
    counts = labelled.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    # a limit on the row number itself lets each task cut its own part of a language first
    return counts.withColumn("row", rank).filter(F.col("row") <= size).select("lang", "gram", (F.col("row") - 1).alias("rank"))


class Profiles:
    """All profiles as one table of ranks, n-grams by languages."""

    def __init__(self, langs: list[str], grams: np.ndarray, ranks: np.ndarray, size: int):
        self.langs, self.size = langs, size
        self.grams, self.ranks = grams, ranks

    @classmethod
    def collected(cls, found: DataFrame, size: int) -> Profiles:
        """At most `size` rows a language come to the driver."""
        rows = found.toArrow()
        names = rows.column("lang").to_pylist()
        langs = sorted(set(names))
        known, where = np.unique(rows.column("gram").to_numpy(), return_inverse=True)
        ranks = np.full((len(langs), len(known)), -1, np.int32)
        ranks[[langs.index(x) for x in names], where] = rows.column("rank").to_numpy()
        return cls(langs, known, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if not len(found) or not self.langs:
            return "und", 0.0
        mine = top(*np.unique(found, return_counts=True), self.size)
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == mine, self.ranks[:, at], -1)
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        best = int(out.argmin())
        return self.langs[best], 1.0 - float(out[best]) / (self.size * len(mine))


def predict(docs: DataFrame, model: Profiles, text: str = "text") -> DataFrame:
    """docs (all columns) with lang_pred and score."""
    columns = docs.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", lang_pred string, score double"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = zip(*map(model.predict, batch.column(text).to_pylist()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(langs), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    return common.map_batches(docs, work, schema, by=text)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The documents that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def identify(docs: DataFrame, size: int = PROFILE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the labelled documents that are not held out, and predict all.

    A null id is in neither part: it is not learned from, and held_out is false.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    model = Profiles.collected(profiles(docs.filter(~held_out()), size), size)
    asked = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(asked, model).drop("text")
