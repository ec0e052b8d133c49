"""Byte-level BPE encoding and decoding by a rank file, with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the public pattern. A pre-token that the rank file has is its id; any other is merged from its bytes:
of all neighbouring parts whose bytes together have a rank, those of least rank (leftmost first) become one, until none is left.

The queue has a bucket of places for each rank. Which buckets have any is kept in a bitmap of 64-bit words, with a bitmap of
its words that are not zero above it, and so on up to one word; find-first-set from the top gives the next rank in as many steps as
there are levels (three for 50,000 ranks). Places are those of a linked list of parts: a merge takes one part out and enters the two
new pairs about it. Entries are never removed; one whose pair has another rank by then is stale and is skipped. A pre-token
of n bytes takes some n log n steps and 100 n bytes of memory at most, whatever it holds, so runs of a million letters
are encoded like words.

The pre-tokens of a slice are merged by one queue, and those of up to KEPT_CHARS characters stay in a worker's table; when it
has KEPT of them, those that were not met since it last had go. Null and empty texts have no
ids and decode to the empty text. Bytes that are not UTF-8 count as U+FFFD. Rows keep their number and id, so repeated rows and null
ids are harmless; an empty table gives no rows. Only id and text are read, so other columns may have any name. Texts of any length are
encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.token_files import PLAIN, SPLIT

KEPT, KEPT_CHARS = 250_000, 64
#: Text that is encoded at once; bytes of pre-tokens that one queue merges at once, a longer pre-token alone.
SLICE_BYTES, BATCH_BYTES = 4 << 20, 1 << 20
#: The pattern that the rank files go with; SPLIT is the same for texts of PLAIN characters.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Places by rank; the least rank that has any comes first."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, array | list[int]] = {}
        self.levels: list[list[int]] = []
        while not self.levels or ranks > 1:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * ranks)

    def enter(self, rank: int, places: array | list[int]) -> None:
        """A new bucket."""
        self.buckets[rank] = places
        for level in self.levels:
            word = level[rank >> 6]
            level[rank >> 6] = word | 1 << (rank & 63)
            if word:
                return
            rank >>= 6

    def least(self) -> int:
        """The least rank of all entries, or -1."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def take(self, rank: int) -> list[int]:
        """All places of a rank in ascending order; its bucket goes."""
        places = sorted(self.buckets.pop(rank))
        for level in self.levels:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                break
            rank >>= 6
        return places


class Encoder:
    """One rank file, and the packed ids (little-endian 32-bit integers) of pre-tokens met before."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = np.full(1 << 16, -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.queue = RankQueue(len(self.tokens))
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def start(self, data: bytes, edges: np.ndarray) -> array:
        """Enter the pairs of single bytes inside each pre-token; the rank of the pair at each place, -1 if it has none."""
        values = np.frombuffer(data, np.uint8).astype(np.int32)
        of = np.append(self.pairs[values[:-1] << 8 | values[1:]], np.int32(-1))
        of[edges[1:] - 1] = -1
        at = np.flatnonzero(of >= 0).astype(np.int32)
        order = at[np.argsort(of[at], kind="stable")]
        cut = common.heads(of[order])
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist()):
            self.queue.enter(int(of[order[a]]), array("i", order[a:b].tobytes()))
        return array("i", of.tobytes())

    def merge(self, pre_tokens: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens, all merged by one queue; their merges do not touch one another."""
        queue = self.queue
        ranks, buckets, enter = self.ranks.get, queue.buckets.get, queue.enter
        data = b"".join(pre_tokens)
        n = len(data)
        edges = np.cumsum([0, *map(len, pre_tokens)])
        of = self.start(data, edges)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        made, alive, head = array("i", self.single[np.frombuffer(data, np.uint8)].tobytes()), bytearray(b"\1") * n, bytearray(n + 1)
        for edge in edges.tolist():
            head[edge] = 1
        while (rank := queue.least()) >= 0:
            places = queue.take(rank)
            for at in places:
                if of[at] != rank:
                    continue
                gone = after[at]
                after[at] = end = after[gone]
                of[at] = of[gone] = -1
                made[at] = least = rank
                alive[gone] = 0
                if not head[end]:
                    before[end] = at
                    new = ranks(data[at : after[end]])
                    if new is not None:
                        of[at] = least = new
                        if (bucket := buckets(new)) is None:
                            enter(new, [at])
                        else:
                            bucket.append(at)
                if not head[at]:
                    near = before[at]
                    new = ranks(data[near:end])
                    if new is None:
                        of[near] = -1
                    else:
                        of[near] = new
                        if (bucket := buckets(new)) is None:
                            enter(new, [near])
                        else:
                            bucket.append(near)
                        if new < least:
                            least = new
                if least < rank:
                    # a pair of a better rank is open: the rest of this rank waits for it
                    if rest := places[bisect(places, at) :]:
                        enter(rank, rest)
                    break
        starts = np.flatnonzero(np.frombuffer(alive, np.uint8))
        ids = np.frombuffer(made, np.int32)[starts].astype("<u4").tobytes()
        cut = (4 * np.searchsorted(starts, edges)).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def learn(self, new: list[str]) -> None:
        """Put the ids of pre-tokens into the table."""
        waiting: list[tuple[str, bytes]] = []
        size = 0

        def flush() -> None:
            if waiting:
                self.known.update(zip([w for w, _ in waiting], self.merge([d for _, d in waiting])))
                waiting.clear()

        for part in new:
            data = part.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[part] = array("I", (whole,)).tobytes()
                continue
            waiting.append((part, data))
            size += len(data)
            if size >= BATCH_BYTES:
                flush()
                size = 0
        flush()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text."""
        parts = [(SPLIT if PLAIN.fullmatch(t) else self.pattern).findall(t) if t else () for t in texts]
        new = set().union(*parts).difference(self.known)
        if self.older:
            again = new.intersection(self.older)
            self.known.update(zip(again, map(self.older.__getitem__, again)))
            new -= again
        self.learn(list(new))
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for long in [w for w in new if len(w) > KEPT_CHARS]:
            del self.known[long]
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def texts(column: pa.Array) -> list[str | None]:
    return [t if t is None else t.decode("utf-8", "replace") for t in common.utf8(column)]


def tokens(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and the decoded bytes of each row; ranks is the rank file's path."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(ranks)
        ids = enc.encode(texts(batch.column("text")))
        lists = [np.frombuffer(x, "<i4") for x in ids]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.map_batches(picked, work, "doc_id long, ids array<int>, decoded binary", most=SLICE_BYTES)


def digests(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the packed ids and of the bytes they decode to, made where the ids are."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(ranks)
        counts, of_ids, of_bytes = [], [], []
        for ids in enc.encode(texts(batch.column("text"))):
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.map_batches(picked, work, SCHEMA, most=SLICE_BYTES)
