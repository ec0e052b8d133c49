"""Token counts under a unigram model, with one forward pass for each shared prefix.

The distinct pre-tokens (space-led words) of a slice go into a trie, in sorted order. A node holds the best
log-probability of any way to cut the string from the root to it into pieces, and the number of
tokens of that way; a new node looks back over at most the longest piece with its last two characters, so a prefix that many
words share is scored once. The value at a word's last node is its count, and a document's count is
the sum over its words.

The vocabulary is that of a public piece file. Its pieces are ordered by frequency, and a piece of
rank r has log-probability -ln(r) less the harmonic constant (Zipf's law); equally good cuts count as
the one with fewest tokens. A character without a piece costs one byte token for each UTF-8 byte, each
10 below the least piece. Null and empty texts have 0 pre-tokens and 0 tokens. Rows keep their
number and id; an empty table gives none, texts of any length count whole, and only id and text are read, so other columns may have
any name. Words longer than LONG characters are scored by the same recurrence without nodes.
"""

from __future__ import annotations

import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

SPACE = "▁"
LONG = 200
KEPT_NODES = 800_000
KEPT_WORDS = 400_000
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, log_prob double"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")


def unigram(path: str) -> dict[str, float]:
    """Piece to log-probability, from the order of the file's pieces."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    pieces = sorted((p for p in proto.pieces if p.type == type(p).NORMAL), key=lambda p: -p.score)
    whole = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p.piece: -math.log(r) - whole for r, p in enumerate(pieces, 1)}


class Trie:
    """Forward scores of prefixes; children are found by (node, character)."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: The longest piece by its last two characters.
        self.reach: dict[str, int] = {}
        for p in scores:
            self.reach[p[-2:]] = max(len(p), self.reach.get(p[-2:], 1))
        self.byte = min(scores.values()) - 10
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def step(self, word: str, d: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Best score and count for word[:d], given those of all shorter prefixes."""
        n = len(word[d - 1].encode())
        top, least = (-math.inf, 0) if word[d - 1] in self.scores else (best[d - 1] + n * self.byte, count[d - 1] + n)
        find = self.scores.get
        for j in (d - 1, *range(max(0, d - self.reach.get(word[d - 2 : d], 0)), d - 1)) if d > 1 else (0,):
            s = find(word[j:d])
            if s is not None:
                v = best[j] + s
                if v > top or v == top and count[j] + 1 < least:
                    top, least = v, count[j] + 1
        return top, least

    def score(self, word: str) -> tuple[float, int]:
        """Log-probability and number of tokens of one word."""
        best, count, node = [0.0], [0], 0
        keep = len(word) <= LONG
        for d in range(1, len(word) + 1):
            to = self.child.get((node, word[d - 1])) if keep else None
            if to is None:
                top, least = self.step(word, d, best, count)
                if keep:
                    to = self.child[node, word[d - 1]] = len(self.best)
                    self.best.append(top)
                    self.count.append(least)
            else:
                top, least = self.best[to], self.count[to]
            best.append(top)
            count.append(least)
            node = to or 0
        return best[-1], count[-1]


class Counter:
    def __init__(self, path: str):
        self.trie = Trie(unigram(path))
        self.known: dict[str, tuple[float, int]] = {}

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        if len(self.trie.best) > KEPT_NODES:
            self.trie.clear()
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        parts = [pretokens(t) for t in texts]
        for w in sorted(set().union(*parts).difference(self.known)):
            self.known[w] = self.trie.score(w)
        out = []
        for p in parts:
            found = list(map(self.known.__getitem__, p))
            out.append((len(p), sum(c for _, c in found), math.fsum(s for s, _ in found)))
        return out


def pretokens(text: str | None) -> list[str]:
    """Space-led words: each run of spaces belongs to the word after it."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return WORDS.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", " " + SPACE)).split(" ")


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens and log_prob of the best segmentation of each whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, tokens, prob = zip(*counter(model)(batch.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(prob, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.map_batches(picked, work, SCHEMA)
