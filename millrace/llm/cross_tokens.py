"""Alignment of two tokenizers over the same texts: groups of tokens between common ends, and counts of linked id pairs.

A is a byte-level BPE vocabulary, which gets a space before each text; B is a piece vocabulary, which adds one itself. Byte offsets where
tokens of both end cut them into groups; two tokens are linked where their bytes overlap.

1. Identity map. An array gives for each A id the B id of the same bytes, if there is one. A group of one A token and that B
   token is exact; it is counted in a vector as long as A's vocabulary, one for each task, and never enters a shuffle by pair.
2. Irregular groups. Each byte range between two neighbouring ends, of either tokenizer, is one link (overlapping tokens share
   exactly one such range), so a group of m and n tokens has m + n - 1 of them. Links are summed up by document and by
   slice of texts; a slice sends each of its pairs once, with its count.
3. Counts are summed by pair over the corpus, and the highest of each B id is found. Those of the identity map's pairs come back as a vector;
   each slice asks for those of its other pairs once, and sums up its documents with the answers.

What the texts give is stored once, packed by slice, in the shared folder. What the driver and broadcasts hold is bounded by A's
vocabulary. Null and empty texts, and texts whose tokens' bytes are not those of the text with a space before it (it holds the space mark
U+2581), have no tokens: zeros and the empty string. Special tokens' strings are plain text. Rows keep their number and id, so repeated
rows and null ids are rows of their own, and each counts; an empty table gives no rows. Texts of any length are taken whole. Only id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common, sentencepiece_bpe, token_files

SLICE_BYTES = 1 << 20
#: Pre-tokens and words whose ids a worker keeps, of either tokenizer; it holds both.
KEPT = 100_000
#: Tokens whose bytes are compared at once.
AT_ONCE = 1 << 16
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
STORED = (
    "slice long, doc_ids array<long>, stats binary, groups array<string>, fast binary, "
    "odd binary, pairs array<long>, totals array<long>"
)
#: How often a document has an exact group (of is its A id) or an irregular link (of is the pair's place in its slice).
ENTRY = np.dtype([("doc", "<u4"), ("of", "<u4"), ("n", "<u4")])


class Plain(token_files.Encoder):
    """The encoder of byte-level BPE with special tokens' strings as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.special = []


class Aligner:
    """Both encoders, their tokens' bytes and the identity map."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Plain(a), sentencepiece_bpe.Encoder(b)
        of_letter = {ord(c): x for x, c in token_files.byte_letters().items()}
        names = [self.a.library.id_to_token(i) for i in range(self.a.library.get_vocab_size())]
        self.a_bytes = [bytes(map(of_letter.__getitem__, map(ord, t))) if all(ord(c) in of_letter for c in t) else t.encode() for t in names]
        library = self.b.library
        self.b_bytes = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(sentencepiece_bpe.SPACE, " ").encode() for i, p in enumerate(map(library.id_to_piece, range(library.get_piece_size())))]
        # of pieces with equal bytes the text's own goes before a byte piece
        same: dict[bytes, int] = {}
        for i, data in enumerate(self.b_bytes):
            if not library.is_control(i) and not library.is_unknown(i) and (data not in same or library.is_byte(same[data])):
                same[data] = i
        self.identity = np.array([same.get(data, -1) for data in self.a_bytes], np.int64)
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        #: The bytes of all tokens one after the other, where each token's begin and how many there are.
        self.a_pool, self.b_pool = ((np.frombuffer(b"".join(x), np.uint8), np.cumsum(n) - n, n) for x, n in ((self.a_bytes, self.a_size), (self.b_bytes, self.b_size)))
        #: An id with what follows it in the list of groups: "," or, at the end of a group's side, "|" or ";".
        self.names = [b"%d%s" % (i, end) for end, n in ((b",", len(names)), (b"|", len(names)), (b",", len(self.b_bytes)), (b";", len(self.b_bytes))) for i in range(n)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and B's ids of all texts, one after the other, and how many each text has."""
        kind = f"<u{self.a.width}"
        for known in (self.a.pieces, self.b.known):
            token_files.trim(known, KEPT)
        data = [b" " + t.encode() if t else b"" for t in texts]
        all_a = [np.frombuffer(self.a(" " + t), kind) if t else np.zeros(0, kind) for t in texts]
        all_b = self.b.encode([t or "" for t in texts])
        if not self.spelt(all_a, self.a_pool, data) or not self.spelt(all_b, self.b_pool, data):
            # some text of the slice is to have no tokens, so each is looked at
            for i, own in enumerate(data):
                if b"".join(map(self.b_bytes.__getitem__, all_b[i].tolist())) != own or b"".join(map(self.a_bytes.__getitem__, all_a[i].tolist())) != own:
                    all_a[i], all_b[i] = all_a[i][:0], all_b[i][:0]
        flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (all_a, all_b)]
        return *flat, np.array([*map(len, all_a)], np.int64), np.array([*map(len, all_b)], np.int64)

    @staticmethod
    def spelt(ids: list[np.ndarray], pool: tuple[np.ndarray, np.ndarray, np.ndarray], data: list[bytes]) -> bool:
        """Whether the bytes of the ids of all texts are those of data, text by text."""
        values, begin, size = pool
        flat, whole = np.concatenate([np.zeros(0, np.uint8), *ids]), np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(np.append(0, size[flat]))
        if ends[np.cumsum([*map(len, ids)], dtype=np.int64)].tolist() != np.cumsum([*map(len, data)]).tolist():
            return False
        for i in range(0, len(flat), AT_ONCE):
            some, first = flat[i : i + AT_ONCE], ends[i]
            sizes, last = size[some], ends[i + len(some)]
            at = np.repeat(begin[some] - ends[i : i + len(some)], sizes) + np.arange(first, last)
            if not np.array_equal(values[at], whole[first:last]):
                return False
        return True

    def align(self, texts: list[str | None]) -> dict:
        """The groups and links of a slice of texts: counts, digests, and the entries of exact and irregular links."""
        a, b, n_a, n_b = self.encode(texts)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        there = np.searchsorted(b_end, a_end)
        both = np.flatnonzero(np.append(b_end, -1)[there] == a_end)
        last_a, last_b = both + 1, there[both] + 1
        m, n = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        exact = (m == 1) & (n == 1)
        exact[exact] = self.identity[a[both[exact]]] == b[last_b[exact] - 1]
        doc_of_a, doc_of_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        n_groups = np.bincount(doc_of_a[both], minlength=len(texts))

        odd_a, odd_b = np.repeat(~exact, m), np.repeat(~exact, n)
        ends = np.sort(np.concatenate([a_end[odd_a], b_end[odd_b]]), kind="stable")
        ends = ends[common.heads(ends)]
        at_a, at_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        pairs, of = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True)
        fast = self.entries(doc_of_a[both[exact]], a[both[exact]])
        odd = self.entries(doc_of_a[at_a], of)
        totals = np.bincount(of, minlength=len(pairs))

        # ids in the order of the list: a group's A tokens, then its B tokens
        names = np.empty(len(a) + len(b), np.int32)
        mine, theirs = np.arange(len(a)) + np.repeat(last_b - n, m), np.arange(len(b)) + np.repeat(last_a, n)
        names[mine], names[theirs] = a, b + 2 * len(self.a_bytes)
        names[mine[both]] += len(self.a_bytes)
        names[theirs[last_b - 1]] += len(self.b_bytes)
        cut = np.cumsum(np.concatenate([[0], n_a + n_b])).tolist()
        name = self.names.__getitem__
        groups = [hashlib.sha256(b"".join(map(name, names[x:y].tolist()))[:-1]).hexdigest() if y > x else "" for x, y in zip(cut, cut[1:])]
        return {"stats": np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups], 1), "groups": groups, "fast": fast, "odd": odd, "pairs": pairs, "totals": totals}

    @staticmethod
    def entries(doc: np.ndarray, of: np.ndarray) -> np.ndarray:
        keys, n = np.unique(doc << 32 | of, return_counts=True)
        out = np.empty(len(keys), ENTRY)
        out["doc"], out["of"], out["n"] = keys >> 32, keys & 0xFFFFFFFF, n
        return out


@cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The stored slices: what their texts give, packed."""

    def work(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                made = aligner(a, b).align(part.column("text").to_pylist())
                values = [number, part.column("doc_id").to_pylist(), made["stats"].astype("<i8").tobytes(), made["groups"], made["fast"].tobytes(), made["odd"].tobytes(), made["pairs"], made["totals"]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in STORED.split(", ")])

    return common.stored(docs.mapInArrow(work, STORED), "slices")


def pair_counts(slices: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n (links corpus-wide) and best (whether n is the highest of b) of each linked pair."""

    def exact(batches):
        vector = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("fast"):
                e = np.frombuffer(data.as_py(), ENTRY)
                if len(e):
                    vector = vector if len(vector) else np.zeros(len(aligner(a, b).identity), np.int64)
                    vector += np.bincount(e["of"], e["n"], len(vector)).astype(np.int64)
        ids = np.flatnonzero(vector)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids << 32 | aligner(a, b).identity[ids]), pa.array(vector[ids])], names=["pair", "n"])

    fast = slices.select("fast").mapInArrow(exact, "pair long, n long")
    odd = slices.select(F.explode(F.arrays_zip("pairs", "totals")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.totals").alias("n"))
    counts = fast.unionByName(odd).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    # one B id has no more pairs than A has ids
    return common.stored(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b"))).select("pair", "n", "best"), "pairs")


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts, sums and digest of each document; a is the file of a byte-level BPE tokenizer, b of a piece model."""
    common.ship(docs.sparkSession)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    slices = aligned(picked, a, b)
    counts = pair_counts(slices, a, b)
    identity = aligner(a, b).identity
    # one row for each A id at most
    exact = docs.sparkSession.createDataFrame(pa.table({"pair": np.flatnonzero(identity >= 0) << 32 | identity[identity >= 0]}))
    own = counts.join(F.broadcast(exact), "pair").toArrow()
    at = own.column("pair").to_numpy() >> 32
    vector, best = np.zeros(len(identity), np.int64), np.zeros(len(identity), bool)
    vector[at], best[at] = own.column("n").to_numpy(), own.column("best").to_numpy(zero_copy_only=False)

    asked = slices.select("slice", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
    answers = asked.groupBy("slice").agg(F.collect_list(F.struct("place", "n", "best")).alias("answers"))

    def add(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("stats", "fast", "odd")}
                stats = np.frombuffer(row["stats"].as_py(), "<i8").reshape(-1, 4)
                answer = batch.column("answers").slice(i, 1).flatten()
                place, n, top = (answer.field(c).to_numpy(zero_copy_only=False) for c in ("place", "n", "best"))
                count, high = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
                count[place], high[place] = n, top
                n_best, total = np.zeros((2, len(stats)), np.int64)
                for e, numbers, tops in ((np.frombuffer(row["fast"].as_py(), ENTRY), vector, best), (np.frombuffer(row["odd"].as_py(), ENTRY), count, high)):
                    np.add.at(n_best, e["doc"], e["n"] * tops[e["of"]])
                    np.add.at(total, e["doc"], e["n"] * numbers[e["of"]])
                ids, groups = (batch.column(c).slice(i, 1).flatten() for c in ("doc_ids", "groups"))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, stats.T), pa.array(n_best), pa.array(total), groups], names=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = slices.select("slice", "doc_ids", "stats", "groups", "fast", "odd").join(answers, "slice", "left")
    return rows.mapInArrow(add, SCHEMA)
