"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows of labelled text: one on ordinary documents, and one on what toxic
documents say that ordinary ones don't, that is their words that stand far more often in toxic documents. Trained on all
of their words the trainer spends the dictionary on syllables that both kinds share. A text is cut into windows of
words; each is compressed with the ordinary dictionary's content, and with that of the toxic one before it. What the
second saves is close to nothing on ordinary windows and several bytes where a window has toxic words. A text's
largest savings, how many windows save, and its length are calibrated to a score by a logistic curve fitted on the
labelled documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.common import crc_mod, slices

#: Labelled documents of each class that the model is fitted on at most, those with the least hashed doc_id.
FIT_DOCUMENTS = 3000
#: Words in a window; compression level.
WINDOW, LEVEL = 8, 12
#: Windows that a dictionary is trained on at most, those with the least hash, and bytes of one; longer words and windows
#: are left out of training, though not of scoring.
TRAIN_WINDOWS, WINDOW_BYTES, WORD_BYTES = 40_000, 1024, 64
#: Words that count as toxic; bytes of the dictionaries; length of a trained segment and of what it is judged by.
TOXIC_WORDS, TOXIC_BYTES, ORDINARY_BYTES, TOXIC_SEGMENT, ORDINARY_SEGMENT = 600, 1024, 32768, (24, 8), (64, 6)
#: A dictionary is trained on so many times its bytes at least.
LEAST_SHARE = 12
#: A toxic word stands in at least this share of the toxic documents, and this many times more often than in ordinary ones.
SHARE, TIMES = 0.015, 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float] = field(default_factory=list)
    share: float = 0.0

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        held.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        if self._pair is None:
            self._pair = self._compressor(self.ordinary).compress, self._compressor(self.toxic + self.ordinary).compress
        plain, toxic = self._pair
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows_of(words_of(text))], float)

    def features(self, text: str | None) -> list[float]:
        saved = self.savings(text)
        top = np.sort(saved)[::-1][:4]
        n = len(saved)
        return [1.0, top[0] if n else 0.0, float(top[1:].sum()) / 3, float((saved >= 3).sum()) / math.sqrt(n or 1), float((saved >= 5).sum()) / math.sqrt(n or 1), float(saved.clip(0).sum()) / (n or 1), math.log1p(n)]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.share
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, self.features(text))))))))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method on the weighted log likelihood; the first column is the constant and isn't shrunk."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(shrink), z.T @ (weight * (y - p)) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    w[0] -= float((w[1:] * mean[1:]).sum())
    return w


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, toxic = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {w for w in words_of(text) if len(w) <= WORD_BYTES}
            words.extend(own)
            toxic.extend([label] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(toxic, pa.int32())], ["word", "toxic"])


def _windows(texts: DataFrame, kept: set[bytes] | None) -> list[bytes]:
    """The TRAIN_WINDOWS windows with the least hash, of `kept` words only if these are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [w for t in batch.column(0).to_pylist() for w in windows_of([x for x in words_of(t) if kept is None or x in kept])]
            yield pa.RecordBatch.from_arrays([pa.array([w for w in own if len(w) <= WINDOW_BYTES], pa.binary())], ["window"])

    return texts.select("text").mapInArrow(run, "window binary").orderBy(F.xxhash64("window"), "window").limit(TRAIN_WINDOWS).toArrow()["window"].to_pylist()


def trained(windows: list[bytes], size: int, segment: tuple[int, int]) -> bytes:
    """The dictionary that zstandard trains on the windows. Text of less than LEAST_SHARE times its size is too little to
    train on: the end of it is the dictionary then."""
    try:
        if sum(map(len, windows)) < LEAST_SHARE * size:
            raise ValueError
        return zstandard.train_dictionary(size, windows, k=segment[0], d=segment[1]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(windows)[-size:] or b" "


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from docs(doc_id, text) and labels(doc_id, toxic); rows without an id or a label of 0 or 1 don't count,
    an id with both labels counts as toxic, and so does a text that stands with both. Without both classes the score is
    the share of toxic labels.

    What reaches the driver is bounded: a list of words, TRAIN_WINDOWS windows of each class, and the features of
    2 * FIT_DOCUMENTS documents."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    seen = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = seen.get(1, 0) / max(1, sum(seen.values()))
    if len(seen) < 2:
        return Model(b" ", b" ", share=share)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 0").orderBy(*by_hash).limit(FIT_DOCUMENTS).union(known.where("toxic = 1").orderBy(*by_hash).limit(FIT_DOCUMENTS))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = sample.persist()
    try:
        sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        plain, bad = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
        counts = sample.mapInArrow(_counted, "word binary, toxic int").groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"))
        in_toxic, in_plain = F.col("n1") / bad, (F.col("n0") + 0.5) / plain
        gain = in_toxic * F.log(in_toxic / in_plain)
        worst = counts.where((F.col("n1") >= max(2, SHARE * bad)) & (in_toxic > TIMES * in_plain)).orderBy(gain.desc(), "word").limit(TOXIC_WORDS).select("word").toArrow()["word"].to_pylist()
        ordinary = trained(_windows(sample.where("toxic = 0"), None), ORDINARY_BYTES, ORDINARY_SEGMENT)
        model = Model(ordinary, trained(_windows(sample.where("toxic = 1"), set(worst)), TOXIC_BYTES, TOXIC_SEGMENT), share=share)

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = [model.features(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

        table = sample.mapInArrow(featured, "x array<double>, toxic int").toArrow()
    finally:
        sample.unpersist()
    x, y = np.array(table["x"].to_pylist()), table["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Model(model.ordinary, model.toxic, share=share)
    # Between how often the classes stand among all labelled rows and evenly, so that a miss costs more than a false alarm.
    prior = math.sqrt(share / 2)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    order = np.lexsort((*x.T[::-1], y))
    model.weights = fit_logistic(x[order], y[order], weight[order]).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs(doc_id, text, ...); a null or empty text gets what the curve gives for no
    windows. A text of any length is scored whole; rows with equal texts score alike. Only the text is looked at. Other
    columns are ignored. No rows: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(crc_mod("doc_id", 5) != 0).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
