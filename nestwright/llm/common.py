"""What the training-data operators share: bounded Arrow slices, hashed words, written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch that goes to a Python worker.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base % 2**64, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and len+1 offsets into them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Splits record batches so that a slice holds at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that aren't ASCII white space), and each text's first word."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z taken as a-z."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; set here only where the session has none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Has the session send BATCH_ROWS rows at once to Python workers instead of Spark's 10,000, which with texts are tens
    of MB in the JVM's direct memory and in the worker, for each task and for good. Another number that is set stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def beside_group(rows: DataFrame, key: list[str], part: str, sums: dict[str, tuple[Column, Column]], where: str) -> DataFrame:
    """rows with what `sums` tells of all rows of the same key, of the keys that `where` keeps.

    One key may hold much of the input: its rows are dealt by `part` too, each part sums up its own, and the sums of
    these go back to the parts that there are. sums: by name, the aggregate over rows and the one over the parts'. Rows
    with a null key or part are left out."""
    # The join asks for this; said here, rows that are made by a shuffle are made once for both uses.
    rows = rows.where(" and ".join(f"{c} is not null" for c in (*key, part)))
    parts = rows.groupBy(*key, part).agg(*(own.alias(name) for name, (own, _) in sums.items()))
    whole = parts.groupBy(*key).agg(*(total.alias(name) for name, (_, total) in sums.items()), F.collect_list(part).alias(part)).where(where)
    return rows.join(whole.withColumn(part, F.explode(part)), [*key, part])


def crc_mod(column, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")) % n


FILTER_BITS = 1 << 24


def bits_of(df: DataFrame, column) -> DataFrame:
    """A bitmap of FILTER_BITS bits (2 MB, whatever the input) as rows (word, bits), with the bit of every value set.

    It only spares work: what passes by chance is dropped by a later join; a full bitmap lets all pass."""
    at = df.select(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("at"))
    return stash(at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")), "bits")


def may_have(df: DataFrame, column, bits: DataFrame, flag: str = "may") -> DataFrame:
    """df with a boolean column more: whether the value's bit is set. The bitmap is broadcast: its size is fixed."""
    at = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    marked = df.withColumn("_word", F.expr("0L") + F.floor(at / 64)).join(F.broadcast(bits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), "_word", "left")
    return marked.withColumn(flag, F.coalesce(F.getbit("_bits", (at % 64).cast("int")) == 1, F.lit(False))).drop("_word", "_bits")
