"""What the operators of this package share: Arrow text access, word hashing and intermediate tables."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import checkpoint_folder

#: ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Texts are handled in runs of whole documents of about so many bytes, which bounds the arrays made from them.
CHUNK_BYTES = 1 << 20
#: Longer spans are hashed by a digest, shorter ones eight bytes at a time.
LONG_SPAN = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """What every operator needs: a checkpoint folder (see ``checkpoint_folder``), and Arrow batches bounded by bytes, as ten thousand
    long texts are too many for one. Spark reads that limit when a plan runs, so it is set for the session, unless the session has its own.
    """
    checkpoint_folder(spark)
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, str(8 << 20))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: later reads survive lost executors and repeat no work."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Ask the driver to forget DataFrames that nothing refers to, upon which Spark deletes their shuffle files and checkpoints; results
    don't depend on it."""
    gc.collect()
    spark._jvm.System.gc()


def utf8(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and the n + 1 offsets; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of whole documents of about ``size`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (and from the end) as little-endian integers; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of ``data``; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time are mixed in by a bijection that isn't linear, so that no regular family of texts collides, as it does in a
    polynomial hash. Spans of more than LONG_SPAN bytes take a digest of their bytes.
    """
    size, view = end - start, eights(data)
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        live, at = np.flatnonzero(size <= LONG_SPAN), 0
        while len(live):
            left = size[live] - at
            kept = (np.uint64(1) << (np.clip(left, 0, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            out[live] = mix(out[live] ^ np.where(left < 8, view[start[live] + at] & kept, view[start[live] + at]))
            live, at = live[left > 8], at + 8
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        for i, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist(), strict=True):
            out[i] = int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little")
    return out


def windows_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbours of ``hashes``, in order; none where there are fewer."""
    many = max(len(hashes) - size + 1, 0)
    out = np.full(many, np.uint64(size))
    for i in range(size if many else 0):
        out = mix(out ^ hashes[i : i + many])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each document (n + 1 entries)."""
    solid = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (~before[:-1] | edge[:-1]))
    after = np.ones(len(data) + 1, bool)
    after[:-1] = ~solid
    end = np.flatnonzero(solid & (after[1:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def pack_bytes(raw: bytes) -> bytes:
    """Compressed bytes with their length before them."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack_bytes(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], n, asbytes=True) if n else b""


def held_out(modulus: int, remainder: int):
    """True where crc32 of the decimal doc_id has that remainder (null: as of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def bounded_sample(rows: DataFrame, key: str, sample: int) -> DataFrame:
    """The ``sample`` rows with the least hash of ``key``. Where there are many more, all but about one and a half times as many are
    filtered out by their hash first, so that tasks don't send ``sample`` rows each to the place where they are ordered.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 1)
    want, n = int(1.5 * sample + 10 * sample**0.5 + 10), rows.count()
    if n > want:
        rows = rows.where(place <= int((2**63 - 1) * (want / n)))
    return rows.orderBy(place, *rows.columns).limit(sample)
