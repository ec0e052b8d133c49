"""Token ids as binary files with a shared zstandard dictionary.

A token folder holds three Parquet tables, so that any store Spark writes to will do:

* blocks: shard, block, first_doc, last_doc, first_token, dict_hash, doc_ids, n_tokens, offsets and
  payload. A document is a frame of its own: payload[offsets[i] : offsets[i + 1]] is the zstandard
  frame of document i's ids (little-endian, 16 bits where the vocabulary allows it, else 32), pressed
  with the shared dictionary. One short document is read by its block's row and one frame.
* dictionary: dict_hash (SHA-256), data and width. A reader checks the hash before it uses the data.
* shards: shard and base, the number of ids in all shards before it.

Shards are ranges of doc_id and blocks follow it inside a shard, so files are in ascending doc_id order (null
ids first; rows with equal ids follow their text's order). Null and empty texts hold the end id alone.

The dictionary is trained on a sample of about SAMPLE_DOCS documents of at most SAMPLE_CHARS
characters, picked by a hash of the id: a dictionary helps short documents only and its size is fixed
(DICT_BYTES). With too little to train on (under 8 KB of ids), the dictionary is empty and frames stand alone.

Texts of any length are one frame each, made in one task. An empty table gives tables without blocks. Only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 2000, 16_384, 65_536
BLOCK_BYTES = 1 << 20
LEVEL = 3
#: Pre-tokens whose ids a task keeps at hand, some 40 MB.
KEPT_PIECES = 250_000
BLOCK_SCHEMA = (
    "shard int, block int, first_doc long, last_doc long, first_token long, block_tokens long, dict_hash string, "
    "doc_ids array<long>, n_tokens array<int>, offsets array<int>, payload binary"
)
#: Characters whose classes are certain here: up to U+024F, and the dashes, quotes and dots from U+2010 to U+2027.
PLAIN = re.compile("[\x00-ɏ‐-‧]*")
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = "\t-\r \x85\xa0"
#: The public pattern of byte-level BPE over the characters of PLAIN.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: A space inside a run of white space, where cutting at spaces could part a pre-token.
INSIDE = re.compile(r"\s (?:\s|$)")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Packed ids of pre-tokens; the library's BPE model is asked for those not met before."""

    def __init__(self, model, letters: dict[int, str], kind: str):
        self.tokenize, self.letters, self.kind, self.space = model.tokenize, letters, kind, letters[32]

    def __missing__(self, part: str) -> bytes:
        if part.isascii():
            body = part[1:] if part[0] == " " else part
            letters = (self.space + body if body is not part else part) if body.isalnum() else part.translate(self.letters)
        else:
            letters = part.encode().decode("latin-1").translate(self.letters)
        found = self[part] = array(self.kind, [t.id for t in self.tokenize(letters)]).tobytes()
        return found


def trim(known: dict, most: int) -> None:
    """Of more than most entries, leave the half that came first: what is common comes early, so hardly any of it is made again."""
    if len(known) > most:
        first = list(islice(known.items(), most // 2))
        known.clear()
        known.update(first)


class Encoder:
    """Ids of whole texts by the tokenizers library; distinct pre-tokens go to its BPE model once.

    A text of PLAIN characters is cut into pre-tokens by SPLIT. Of other texts, cut before each space (which never parts a
    pre-token), the words of PLAIN characters are, and the rest go to the library as they are. Texts with a special token's string, and
    those of the latter kind with a space inside a run of white space, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.pieces = Pieces(self.library.model, byte_letters(), self.kind)

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def split(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text)))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        trim(self.pieces, KEPT_PIECES)
        if any(s in text for s in self.special):
            return self.whole(text)
        if PLAIN.fullmatch(text):
            return self.split(text)
        if INSIDE.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return b"".join([self.split(w) if PLAIN.fullmatch(w) else self.whole(w) for w in [first, *[" " + w for w in rest]] if w])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str) -> tuple[bytes, int]:
    """Dictionary and id width, from a sample of bounded size that one task encodes."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    picked = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.filter(picked & (F.length("text") <= SAMPLE_CHARS)).repartition(1)

    def run(batches):
        import zstandard

        enc, texts = encoder(tokenizer), []
        for batch in batches:
            texts += [enc(t) for t in batch.column("text").to_pylist()]
        try:
            size = min(DICT_BYTES, sum(map(len, texts)) // 8)
            if size < 1024:
                raise zstandard.ZstdError("too little to train on")
            data = zstandard.train_dictionary(size, [t for t in texts if t]).as_bytes()
        except zstandard.ZstdError:
            data = b""
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([enc.width], pa.int32())], names=["data", "width"])

    row = sample.mapInArrow(run, "data binary, width int").first()
    if row is None:
        return b"", encoder(tokenizer).width
    return bytes(row.data), row.width


def codec(data: bytes):
    """Compress and decompress one frame with the dictionary."""
    import zstandard

    if not data:
        return zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
    shared = zstandard.ZstdCompressionDict(data)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress, zstandard.ZstdDecompressor(dict_data=shared).decompress


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append end_id, and write the token folder at path."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    data, width = train_dictionary(docs, tokenizer)
    name = hashlib.sha256(data).hexdigest()
    kind = f"<u{width}"

    def run(batches):
        from pyspark import TaskContext

        enc, press = encoder(tokenizer), codec(data)[0]
        end = np.array([end_id], kind).tobytes()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, sizes, offsets, frames = [], [], [0], []

        def emit():
            row = [[shard], [block], [next((i for i in ids if i is not None), None)], [ids[-1]], [first], [sum(sizes)], [name], [ids], [sizes], [offsets], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for part in common.slices(batch, "text"):
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    raw = enc(t) + end
                    frames.append(press(raw))
                    ids.append(i)
                    sizes.append(len(raw) // width)
                    offsets.append(offsets[-1] + len(frames[-1]))
                    if offsets[-1] >= BLOCK_BYTES:
                        yield emit()
                        block, first = block + 1, first + sum(sizes)
                        ids, sizes, offsets, frames = [], [], [0], []
        if ids:
            yield emit()

    ordered = docs.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    totals = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("block_tokens").alias("n"))
    # one row a shard, so one task can add them up
    base = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("shard", base.alias("base")).write.parquet(f"{path}/shards")
    spark.createDataFrame([(name, bytearray(data), width)], "dict_hash string, data binary, width int").write.parquet(f"{path}/dictionary")


def read(spark: SparkSession, path: str, blocks: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (packed, little-endian unsigned 32-bit) for each document."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    data, width, name = bytes(row.data), row.width, row.dict_hash
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError(f"{path}: the dictionary does not have the hash it was stored under")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks") if blocks is None else blocks
    shards = spark.read.schema("shard int, base long").parquet(f"{path}/shards")
    joined = blocks.join(F.broadcast(shards), "shard").select((F.col("base") + F.col("first_token")).alias("at"), "dict_hash", "doc_ids", "n_tokens", "offsets", "payload")

    def run(batches):
        expand = codec(data)[1]
        for batch in batches:
            for at, used, ids, sizes, offsets, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if used != name:
                    raise ValueError(f"a block was written with dictionary {used}, not {name}")
                starts = at + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                texts = [np.frombuffer(expand(payload[a:b]), f"<u{width}").astype("<u4").tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The rows of one document, from the blocks whose range holds it."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return read(spark, path, blocks).filter(F.col("doc_id") == doc_id)


def checksum(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids."""

    def run(batches):
        for b in batches:
            crc = [zlib.crc32(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
