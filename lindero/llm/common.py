"""What the operators share: reading tables, writing intermediate tables to the shared folder,
and vectorised work on UTF-8 text columns.

Texts are handled as the byte buffer of an Arrow string column with its offsets, so that a whole
batch is cut into words and hashed by a few numpy calls. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one, but only without a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written(), which nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter of among(): eight for an id, within these bounds (8 kB to 128 MB in bitmaps of 4 kB).
FILTER_BITS = 1 << 16, 1 << 30


def among(docs: DataFrame, ids: DataFrame, about: int) -> DataFrame:
    """docs (doc_id, ...) whose doc_id, null included, is among ids (one column, distinct). about: how many ids there are at most.

    Before the join, rows are tested by likely(), so that texts that are not wanted do not travel.
    """
    hit, wanted_id = fresh(docs.columns, "hit_"), fresh(docs.columns, "wanted_id_")
    wanted = ids.select(F.col(ids.columns[0]).alias(wanted_id))
    # An inner join on distinct ids: a semi-join would be moved before the test.
    return likely(docs, "doc_id", wanted, about, hit).where(hit).join(wanted, F.col("doc_id").eqNullSafe(F.col(wanted_id))).select(*docs.columns)


def likely(rows: DataFrame, key: str, values: DataFrame, about: int, name: str) -> DataFrame:
    """rows with a column name: false only where key is not among values (one column). about: how many values there are at most.

    It is a bitmap of the values' hashes, which has a bounded size and is broadcast. It is true for a
    few other rows too, and beyond a thousand million values for most.
    """
    bits = min(max(1 << (8 * max(about, 1) - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    h, bucket, found = (fresh(rows.columns, x) for x in ("hash_", "bucket_", "bits_"))
    maps = values.select(hashed(values.columns[0]).alias("h")).groupBy(F.bitmap_bucket_number("h").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias(found))
    bit = f"shiftright(cast(conv(hex(substring({found}, cast(bitmap_bit_position({h}) div 8 + 1 as int), 1)), 16, 10) as int), cast(bitmap_bit_position({h}) % 8 as int)) & 1"
    joined = rows.withColumn(h, hashed(key)).join(F.broadcast(maps), F.bitmap_bucket_number(h) == F.col(bucket), "left")
    return joined.select(*rows.columns, F.expr(f"coalesce(({bit}) = 1, false)").alias(name))


def trimmed() -> None:
    """Gives back to the system what earlier tasks of this Python worker have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores behind it until none of columns is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def repeats(docs: DataFrame, nulls: bool) -> bool:
    """Whether some doc_id occurs more than once or, with nulls, is null. Only ids travel."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.lit(nulls) | F.col("doc_id").isNotNull())
    return not ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if column.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes each, or one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def padded(buf: np.ndarray) -> np.ndarray:
    return np.concatenate([buf, np.zeros(8, np.uint8)])


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in buf, and the number of words before each row (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_IS_SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offs[1:-1]
    cut = inner[(inner > 0) & (inner < len(buf))]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs, "left")


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _S33)
    h = h * _M2
    h ^= h >> _S29
    h *= _M3
    h ^= h >> _S33
    return h


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time. Equal bytes, equal values."""
    data = padded(buf)
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    size = ends - starts
    h = mixed(size.astype(np.uint64) * _M1 + _M1)
    at, rows = 0, None
    while True:
        if rows is None:
            left, begin, old = size, starts, h
        else:
            left, begin, old = size[rows] - at, starts[rows] + at, h[rows]
        new = mixed((old ^ (eight[begin] & _KEEP[np.clip(left, 0, 8)])) * _M1)
        if rows is None:
            h = new
        else:
            h[rows] = new
        at += 8
        rows = np.flatnonzero(size > at) if rows is None else rows[size[rows] > at]
        if not len(rows):
            return h
