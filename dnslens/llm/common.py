"""Helpers shared by the training-data operators: word hashing in numpy, text slices, shared tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() uses the same six bytes.
SPACE = b" \t\n\x0b\f\r"
SLICE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may leave it unset; it gets a temporary one."""
    if not (d := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="dnslens-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def parts_for(docs: DataFrame, bytes_each: int = 128 << 20) -> int:
    """How many partitions keep about `bytes_each` of text in a task: the session's number at least."""
    n = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // bytes_each))


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/dnslens-{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return fs.makeQualified(p).toString()


def store(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{new_folder(spark, tag)}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that extra or clashing columns never matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in numpy."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_GRAM_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept between calls up to a few MB."""
    got = _POWERS.get(int(base))
    if got is None or len(got) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        got = np.multiply.accumulate(x)
        if len(got) <= 2 * SLICE_BYTES:
            _POWERS[int(base)] = got
    return got[:n]


def text_buffer(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty), in lower case if asked, and its n + 1 offsets."""
    if lower:
        column = pc.utf8_lower(column.cast(pa.large_string()))
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the number of its first word (n + 1 numbers). A word never spans documents."""
    word = ~_IS_SPACE[data]
    n = len(word)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    edge = offsets[1:-1]
    before[edge[edge < n]] = False
    edge = edge[edge > 0] - 1
    after[edge] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def without_marks(data: np.ndarray) -> np.ndarray:
    """ASCII punctuation turned to spaces."""
    return np.where(_MARK[data], np.uint8(32), data)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over bytes: no Python step per word."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INV, len(data) + 1)[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; entry i covers words i .. i + k - 1, whatever documents they are of."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_GRAM, len(words)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_GRAM_INV, len(words))[: len(words) - k + 1])


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, the same in every later read, and the name of that column.

    Rows that come straight from files are numbered as they are read (only such tables know their row's place in a file);
    others could change when a lost task runs again, so they are written to the shared folder first.
    """
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return store(rows, "rows"), name
    return rows, name


def without_rows(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """Numbered rows without those in gone (row_id), and without their numbers."""
    return rows.join(gone.select(F.col("row_id").alias(row)), row, "left_anti").select(*(rows[c] for c in rows.columns if c != row))
