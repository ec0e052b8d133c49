"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A piece never holds the space mark after another character, so merges never cross from one
space-led word into the next, and each distinct word is encoded once for each Arrow slice (and kept
by the worker while its table has room). All words of a slice lie in one flat numpy array of symbols.
A round looks up every neighbouring pair, takes the least rank within each word (a segmented
minimum), merges its leftmost occurrences at once in all words, and drops the words that have no pair
left. Where a merge could open a better pair than itself, only the leftmost one is taken in that
round, so the order is the library's own. Characters without a piece become byte pieces.

Null and empty texts give no ids and decode to the empty text. Rows keep their order, number and id,
so repeated rows and null ids are harmless; an empty table gives no rows. Only id and text are read, so other columns may have any
name. Texts of any length are encoded whole. Words longer than LONG symbols (with runs of one kind,
such as thousands of spaces) are merged with a heap, since a round for each merge would take the
square of their length; the merges are the same.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

SPACE = "▁"
LONG = 1000
KEPT_WORDS = 300_000
#: Text that is encoded at once.
SLICE_BYTES = 2 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")


class Encoder:
    """The merge table of one model as numpy arrays."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = type(proto.pieces[0])
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        norm = proto.normalizer_spec
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        other = any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces)
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback or inner or other:
            raise ValueError(f"{path}: only BPE models with byte pieces and plain normalisation are supported")
        size = len(proto.pieces)
        self.text = [str(i) for i in range(size)]
        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        scores = np.array([p.score for p in proto.pieces])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        left, right, made = [], [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        self.pairs = dict(zip(zip(left.tolist(), right.tolist()), made.tolist()))
        best = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(best, left, self.rank[made])
        np.minimum.at(best, right, self.rank[made])
        shared = np.bincount(self.rank, minlength=self.rank.max() + 1)[self.rank] > 1
        #: A merge into such a piece opens no pair of its own rank or better.
        self.calm = (best > self.rank) & ~shared
        self.bits = 19
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, -1, np.int32)
        for key, m in zip((left << 32 | right).tolist(), made.tolist()):
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.made[at] = key, m
        self.known: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (common.mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = a.astype(np.int64) << 32 | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.made[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            same = found == keys[todo]
            out[todo[same]] = self.made[at[todo[same]]]
            todo = todo[~same & (found >= 0)]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 16-bit integers."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in set(range(len(words))) - set(short):
            out[i] = self._pack(self._by_heap(words[i]), words[i])
        if not short:
            return out
        sizes = np.array([len(words[i]) for i in short])
        points = np.frombuffer("".join([words[i] for i in short]).encode("utf-32-le"), np.uint32)
        sym = self.of_char[points]
        word = np.repeat(np.arange(len(short)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        code = np.where(sym < 0, -1 - points.astype(np.int64), sym)  # a character without a piece keeps its code point
        while len(code):
            made = self.merged(code[:-1], code[1:])
            made[word[1:] != word[:-1]] = -1
            at = np.flatnonzero(made >= 0)
            active = np.zeros(len(short), bool)
            active[word[at]] = True
            rest = active[word]
            if not rest.all():
                done.append((word[~rest], code[~rest]))
            if not len(at):
                break
            of, rank = word[at], self.rank[made[at]]
            first = np.r_[True, of[1:] != of[:-1]]
            least = np.minimum.reduceat(rank, np.flatnonzero(first))[np.cumsum(first) - 1]
            at = at[rank == least]
            of = word[at]
            at = at[np.r_[True, of[1:] != of[:-1]] | self.calm[made[at]]]
            order = np.arange(len(at))
            begins = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], order, 0))
            at = at[(order - begins) % 2 == 0]
            code[at] = made[at]
            rest[at + 1] = False
            code, word = code[rest], word[rest]
        word, code = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        word, code = word[order], code[order]
        edges = np.searchsorted(word, np.arange(len(short) + 1)).tolist()
        packed = np.maximum(code, 0).astype("<u2").tobytes()
        strange = set(word[code < 0].tolist())
        for k, (i, a, b) in enumerate(zip(short, edges, edges[1:])):
            out[i] = self._pack(code[a:b].tolist(), words[i]) if k in strange else packed[2 * a : 2 * b]
        return out

    def _pack(self, code: list[int], word: str) -> bytes:
        ids: list[int] = []
        for c in code:
            ids += [c] if c >= 0 else self.bytes[list(chr(-1 - c).encode())].tolist()
        return np.array(ids, "<u2").tobytes()

    def _by_heap(self, word: str) -> list[int]:
        """The same merges for one long word, in order of rank and place."""
        sym = [int(s) if (s := self.of_char[ord(c)]) >= 0 else -1 - ord(c) for c in word]
        n = len(sym)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (m := self.pairs.get((sym[i], sym[j]))) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, j, m, sym[i] << 32 | sym[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, j, m, pair = heapq.heappop(heap)
            if not alive[i] or not alive[j] or after[i] != j or sym[i] << 32 | sym[j] != pair:
                continue
            sym[i], alive[j], after[i] = m, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return [s for s, a in zip(sym, alive) if a]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        parts = []
        for t in texts:
            if not t:
                parts.append([])
            elif t[0] == " " or "  " in t or SPACE in t:
                parts.append(WORDS.findall(SPACE + t.replace(" ", SPACE)))
            else:
                parts.append((SPACE + t.replace(" ", " " + SPACE)).split(" "))
        new = list(set().union(*parts).difference(self.known))
        for i in range(0, len(new), 100_000):
            some = new[i : i + 100_000]
            self.known.update(zip(some, self.encode_words(some)))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), "<u2") for p in parts]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text for each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(model)
        ids = [x.tolist() for x in enc.encode(batch.column("text").to_pylist())]
        back = [enc.library.decode(x) if x else "" for x in ids]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.map_batches(picked, work, "doc_id long, ids array<int>, decoded string", most=SLICE_BYTES)


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text, made where the ids are."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(model)
        name = enc.text.__getitem__
        counts, of_ids, of_text = [], [], []
        for x in enc.encode(batch.column("text").to_pylist()):
            ids = x.tolist()
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256((enc.library.decode(ids) if ids else "").encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.map_batches(picked, work, SCHEMA, most=SLICE_BYTES)
