"""Quality by importance resampling.

Two generative models of hashed n-grams are counted: of target text (documents labelled good) and of raw text (every
document). A document's weight is the logarithm of the ratio of its likelihoods, less what its length alone brings. As many documents are drawn, without
replacement and in proportion to their importance, as have a weight that speaks for the target: Gumbel top-k, that is
the k greatest sums of a weight and Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.common import mix, slices, stash, text_bytes, word_hashes, word_spans

#: Buckets of the n-grams (3 bytes, and where a word repeats one of the words before it).
BUCKETS, BACK = 1 << 15, 4
#: Labelled documents that the target model is counted on at most, those with the least hashed doc_id.
FIT_DOCUMENTS = 20_000
#: A count added to every bucket, as a share of the mean count.
ADDED = 0.01
#: The weight that a document must reach to count as one that is wanted.
THRESHOLD = 0.0


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, bucket) of each n-gram of the texts."""
    wide = data.astype(np.uint64)
    if len(data) >= 3:
        value = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
        at = np.arange(len(value))
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        bucket = (mix(value[inside] + np.uint64(1)) % np.uint64(BUCKETS - 2 * (BACK + 1))).astype(np.int64)
        text = text[inside]
    else:
        text, bucket = np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    owner = np.searchsorted(first, np.arange(len(words)), "right") - 1
    # How far back a word stood last, BACK at most; twice in a row, this and the word before it, make a bucket.
    back = np.zeros(len(words), np.int64)
    for k in range(BACK, 0, -1):
        same = np.flatnonzero((words[k:] == words[:-k]) & (owner[k:] == owner[:-k])) + k
        back[same] = k
    long = (ends - starts > 12).astype(np.int64)
    return np.concatenate([text, owner]), np.concatenate([bucket, BUCKETS - 1 - back - (BACK + 1) * long])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        total += np.bincount(grams(*text_bytes(batch.column(0)))[1], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket stands in all the texts; a task sends one row for each bucket at most."""
    table = texts.mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p, q = (x + ADDED * max(1.0, x.sum()) / BUCKETS for x in (target, raw))
    return np.log(p / p.sum()) - np.log(q / q.sum())


@dataclass(frozen=True)
class Model:
    """The buckets' log ratios, and what an n-gram must bring on average for a document to count as wanted."""

    ratios: np.ndarray
    bar: float = 0.0


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> Model:
    """Learns from docs(doc_id, text) and labels(doc_id, quality); good is quality 1, an id with several labels has the
    least. The raw model counts every document, the target model `documents` good ones at most. The bar is the mean
    log ratio that parts as many good and other labelled documents (`documents` each at most) as right as it can; without
    others it is the least of the good ones. Without a good document every weight is 0."""
    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("good").orderBy(*by_hash).limit(documents).union(known.where("not good").orderBy(*by_hash).limit(documents))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "doc_id").select("text", "good")
    target = counts(sample.where("good").select("text"))
    raw = counts(text)
    if not target.sum():
        return Model(np.zeros(BUCKETS))
    ratios = log_ratio(target, raw)
    table = sample.mapInArrow(_weighed(ratios, 0.0, True), "good boolean, weight double").toArrow()
    mean, good = table["weight"].to_numpy(), np.asarray(table["good"].to_pylist())
    order = np.argsort(mean)
    mean, good = mean[order], good[order]
    if good.all():
        return Model(ratios, float(mean[0]))
    right = np.concatenate([[0], np.cumsum(np.where(good, -1, 1))])
    right[1:-1][mean[1:] == mean[:-1]] = right.min() - 1
    at = int(right.argmax())
    # Halfway between the last document below the bar and the first above it.
    return Model(ratios, float((mean[max(0, at - 1)] + mean[min(at, len(mean) - 1)]) / 2))


def _weighed(ratios: np.ndarray, bar: float, mean: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, bucket = grams(*text_bytes(batch.column(0)))
            weight = np.bincount(text, ratios[bucket] - bar, minlength=batch.num_rows).astype(float)
            if mean:
                weight /= np.maximum(np.bincount(text, minlength=batch.num_rows), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(weight, pa.float64())], [*batch.schema.names[1:], "weight"])

    return run


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column weight more; a null, empty or very short text weighs 0."""
    held = [c for c in docs.columns if c != "weight"]
    own = docs.select(F.col("text").cast("string").alias("_text"), *held)
    return own.mapInArrow(_weighed(model.ratios, model.bar), docs.select(held).schema.add("weight", "double"))


def gumbel(*columns):
    """Noise that depends on the columns only, so that a task that runs twice draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(*columns), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_greatest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th greatest of a column of longs, or None for k < 1; all of fewer rows. Sixteen bits at a time: four
    passes, each with at most 65,536 counts."""
    if k < 1:
        return None
    kept, high = df.select(F.col(column).alias("x")), 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("x", shift).bitwiseAND(0xFFFF) if shift < 48 else F.shiftright("x", 48) + 32768
        table = kept.groupBy(digit.cast("int").alias("d")).agg(F.count("*").alias("n")).toArrow()
        rows = sorted(zip(table["d"].to_pylist(), table["n"].to_pylist(), strict=True), reverse=True)
        if not rows:
            return None
        for d, n in rows:
            if n >= k:
                break
            k -= n
        else:  # fewer rows than k
            d, k = rows[-1][0], rows[-1][1]
        value = d - 32768 if shift == 48 else d
        high = high << 16 | value if shift < 48 else value
        kept = kept.where(digit == d)
    return high


def _sortable(column):
    """A long that sorts as the double does: a fixed-point value of 2**-20, from -2**43 to 2**43."""
    return F.floor(F.greatest(F.lit(-8e12), F.least(F.lit(8e12), column)) * (1 << 20)).cast("long")


def resample(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, weight, drawn, selected) of each row of docs(doc_id, text, ...); drawn is the weight with its noise.

    k is the number of rows that weigh `threshold` or more; the k greatest are selected, and with the k-th all that tie
    with it (rows that repeat an id and a text do). Null and empty texts weigh 0. Other columns are ignored."""
    model = fit(docs, labels)
    weighed = stash(weigh(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h")), model).drop("text"), "weights")
    drawn = weighed.withColumn("drawn", _sortable(F.col("weight") + gumbel("doc_id", "h")))
    k = weighed.where(F.col("weight") >= threshold).count()
    least = kth_greatest(drawn, "drawn", k)
    selected = F.col("drawn") >= least if least is not None else F.lit(False)
    return drawn.select("doc_id", "weight", (F.col("drawn") / (1 << 20)).alias("drawn"), selected.alias("selected"))


def selected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that resample() selects, with the columns of docs."""
    model = fit(docs, labels)
    text = F.col("text").cast("string")
    weighed = docs.select(text.alias("_text"), *docs.columns).mapInArrow(_weighed_as(model), docs.select(docs.columns).schema.add("_weight", "double"))
    drawn = _sortable(F.col("_weight") + gumbel(F.col("doc_id").cast("long"), F.xxhash64(text)))
    small = stash(weighed.select(F.col("_weight").alias("weight"), drawn.alias("drawn")), "weights")
    least = kth_greatest(small, "drawn", small.where(F.col("weight") >= threshold).count())
    return weighed.where(drawn >= least if least is not None else F.lit(False)).select(docs.columns)


def _weighed_as(model: Model):
    run = _weighed(model.ratios, model.bar)
    return lambda batches: (pa.RecordBatch.from_arrays(b.columns, [*b.schema.names[:-1], "_weight"]) for b in run(batches))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
