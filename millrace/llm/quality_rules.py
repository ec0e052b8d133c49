"""Quality rules from compression: zstandard ratios of the whole text and of fixed chunks, inside
bands that depend on the text's length. Too small a ratio is repetition, too large a one noise.

Every byte lies in a tested chunk: chunks have 4096 bytes, in shorter texts 1024 or 256, and the last
one ends where the text ends (and overlaps the one before it). A text under 256 bytes is one chunk.

Words are runs of anything but ASCII white space. Null and empty texts have no words and fail the
base rule. Rows come out as they came in: repeated rows and null ids each keep their own result.
Everything is computed from one text alone, so no row waits for another; texts of any length are tested whole. A ratio at a limit of
its band is inside. An empty table gives no rows. score() reads id and text only, and keep() returns all columns whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: (bytes below which it holds, least ratio, greatest ratio) for whole texts.
#: Upper limits of short texts are above the 99.9th percentile of as long pieces of good prose (0.86 under 200 bytes, 0.82 under 256).
BANDS = ((160, 0.15, 0.95), (200, 0.15, 0.90), (256, 0.15, 0.85), (1024, 0.25, 0.85), (4096, 0.25, 0.72), (16384, 0.22, 0.70), (float("inf"), 0.15, 0.70))
#: Chunks of so many bytes, their band, and the share of chunks that may lie outside it. Smaller chunks
#: have the band of a whole text of their length.
CHUNK, CHUNK_LEAST, CHUNK_MOST, CHUNK_SHARE = 4096, 0.20, 0.72, 0.3
#: Chunks of texts under CHUNK bytes: the first of these that the text fills.
SMALLER = (1024, 256)
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    codes = pairs[:-1] * len(seen) + ids[2:]
    _, where, times = np.unique(codes, return_inverse=True, return_counts=True)
    hit = times[where] > 1
    cover = np.zeros(n, bool)
    for i in range(3):
        cover[i : n - 2 + i] |= hit
    return int(cover.sum())


def chunks_of(text: bytes) -> list[bytes]:
    """Chunks of one size that cover the text; the last one ends with it."""
    size = next((n for n in (CHUNK, *SMALLER) if len(text) >= n), len(text))
    out = [text[i : i + size] for i in range(0, len(text) - size + 1, size)]
    return out if len(text) % size == 0 else [*out, text[-size:]]


def band(size: int, bands) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in bands if size < below)


def measure(text: bytes | None, compress, bands=BANDS) -> tuple:
    """All columns but doc_id for one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = sum(text.count(c) for c in (bytes([x]) for x in SYMBOLS))
    lines: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in lines:
            dup += 1
        elif line and not line.isspace():
            lines.add(line)
    repeat = repeated_words(words)
    failed = n < 50 or 100 * repeat > 50 * n
    if not text:
        return n, chars, symbols, dup, repeat, failed, False, None, 0, 0
    ratio = len(compress(text)) / len(text)
    least, most = band(len(text), bands)
    chunks = chunks_of(text)
    size = len(chunks[0])
    low, high = (CHUNK_LEAST, CHUNK_MOST) if size == CHUNK else band(size, bands)
    bad = sum(not low <= len(compress(c)) / size <= high for c in chunks)
    kept = not failed and least <= ratio <= most and bad <= CHUNK_SHARE * len(chunks)
    return n, chars, symbols, dup, repeat, failed, kept, ratio, len(chunks), bad


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands=BANDS) -> DataFrame:
    """One row for each row of docs, with counts, ratios and the verdict `kept`."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = [measure(t, compress, bands) for t in common.utf8(batch.column("text"))]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=NAMES)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.map_batches(picked, work, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def keep(docs: DataFrame, text: str = "text", bands=BANDS) -> DataFrame:
    """The rows of docs that pass, with all their columns; rows are judged one by one, no join."""
    columns = docs.columns

    def run(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for part in common.slices(batch, text):
                good = [measure(t, compress, bands)[6] for t in common.utf8(part.column(text))]
                yield part.filter(pa.array(good, pa.bool_()))

    common.ship(docs.sparkSession)
    return docs.select(columns).mapInArrow(run, docs.schema)
