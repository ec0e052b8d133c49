"""Helpers that every corpus operator uses: shared storage, Arrow batches, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage

#: Rows are handled in slices of about so many bytes of text, whatever Spark's batch size.
SLICE_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the application's shared folder. What makes one is about to run a job, so the executors get the package."""
    ship(spark)
    return storage.scratch(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, lost executors lose nothing. Its shuffles' files go."""
    path = scratch(df.sparkSession, name)
    with storage.swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Remove what is written to scratch folders inside; nothing made of it may be read later.
temporary = storage.temporary

#: Writes inside leave no shuffle files behind.
swept = storage.swept


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts as bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def release() -> None:
    """Give unused memory back: a worker lives on after its task, with what its allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds much more than `most` bytes of the column (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    release()


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, by: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded size; work keeps no state between calls that changes results."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by, most):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


#: Which bytes part words, masks of the low bytes of a 64-bit word, and multipliers.
_BLANK = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Longer words are hashed one by one.
_LONG = 128


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    edge = np.flatnonzero(np.diff(_BLANK[np.frombuffer(text, np.uint8)], prepend=True, append=True))
    begins, ends = edge[::2], edge[1::2]
    size = ends - begins
    at = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,))
    h = mixed((at[begins] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest) and done < _LONG:
        chunk = at[begins[rest] + done] & _LOW[np.minimum(size[rest] - done, 8)]
        h[rest] = mixed(h[rest] * _ODD + chunk)
        done += 8
        rest = rest[size[rest] > done]
    if len(rest):
        import xxhash

        h[rest] = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begins[rest].tolist(), ends[rest].tolist())]
    return h, begins


def text_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text (runs of anything but ASCII white space), in order.

    Words are read eight bytes at a time, for all words at once: no word is cut out. Each step is a bijection
    of what it reads, so words of the same length up to eight bytes never share a hash.
    """
    return _words(text)[0] if text else np.zeros(0, np.uint64)


def slice_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one after the other, and where each text's begin (one more for the end).

    The same hashes as text_hashes gives, for a whole slice at once.
    """
    whole = b"\n".join([t or b"" for t in texts])
    h, begins = _words(whole.lower() if lower else whole) if whole else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
    return h, np.concatenate([[0], np.searchsorted(begins, ends)])


def slice_shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place (in words) of all runs of k words that lie in one text of a slice."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(h) - k + 1)
    at = np.flatnonzero(text[:n] == text[k - 1 :][:n])
    return shingle_hashes(h, k)[at], text[at], at - first[text[at]]


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each run of equal keys of a sorted stream of batches; one run at a time is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    release()


def packed(column: pa.ChunkedArray | pa.Array, kind: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    width = np.dtype(kind).itemsize
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    values, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for c in chunks:
        if len(c):
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            if at[-1] > at[0]:
                values.append(np.frombuffer(c.buffers()[2], kind, (at[-1] - at[0]) // width, at[0]))
            sizes.append(np.diff(at) // width)
    return np.concatenate(values), np.concatenate(sizes)


def pack(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A column of packed arrays: values[edges[i] : edges[i + 1]] for each i."""
    offsets = (np.asarray(edges, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def heads(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes; empty if there are fewer than k."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _ODD + h[i : i + n]
    return mixed(out + np.uint64(k))


def distinct_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"))


def bitmap(hashes: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A bit for the low `bits` bits of each hash, as 64-bit words.

    Its size is fixed by `bits` alone, so it may go to every task whatever the number of hashes. It
    only rules rows out; whoever uses it joins on the whole hash afterwards.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftrightunsigned(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
