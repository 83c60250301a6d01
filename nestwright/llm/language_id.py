"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training speaks by the logarithm of its frequency in each language. A word that wasn't seen is walked
through; at each of its characters the longest known n-gram that ends there speaks instead, by its own frequency.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.common import crc_mod, slices

#: Labelled documents that the model is fitted on, about; words and n-grams of each length that it keeps at most.
FIT_DOCUMENTS, WORDS, GRAMS, LONGEST = 20_000, 60_000, 20_000, 4
#: A count added to every frequency; how far one word or n-gram can speak against a language; the weight of an n-gram.
ADDED, FLOOR, GRAM_WEIGHT = 0.5, -5.0, 0.4
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return [w for w in _RUN.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams_of(word: str, longest: int = LONGEST) -> Iterator[tuple[int, str]]:
    """(length, n-gram) of the word between marks of its ends."""
    marked = f"<{word}>"
    for n in range(1, longest + 1):
        for i in range(len(marked) - n + 1):
            yield n, marked[i : i + n]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    speaks: np.ndarray  # a row for each word and n-gram, a column for each language

    def evidence(self, text: str | None) -> np.ndarray:
        rows, times = [], []
        known, grams = self.words, self.grams
        for word, n in Counter(words_of(text)).items():
            at = known.get(word)
            if at is not None:
                rows.append(at)
                times.append(n)
                continue
            marked = f"<{word}>"
            for end in range(2, len(marked) + 1):
                for size in range(min(LONGEST, end), 0, -1):
                    at = grams.get(marked[end - size : end])
                    if at is not None:
                        rows.append(at)
                        times.append(n * GRAM_WEIGHT)
                        break
        if not rows:
            return np.zeros(len(self.langs))
        return np.array(times) @ self.speaks[rows]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.langs:
            return UNKNOWN, 0.0
        heard = self.evidence(text)
        share = np.exp(heard - heard.max())
        best = int(heard.argmax())
        return self.langs[best], float(share[best] / share.sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 22):
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
        rows: list[list] = [[], [], [], []]
        for lang, own in words.items():
            grams: Counter = Counter()
            for word, n in own.items():
                if len(word) <= 64:
                    for gram in grams_of(word):
                        grams[gram] += n
            for kind, unit, n in [*((0, w, n) for w, n in own.items() if len(w) <= 64), *((k, g, n) for (k, g), n in grams.items())]:
                for column, value in zip(rows, (lang, kind, unit, n), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], ["lang", "kind", "unit", "n"])


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> Model:
    """Learns from the text and lang of docs; rows without either don't count. About `documents` rows are used: those
    whose hashed doc_id and text are least, all where there are fewer. Kept are the WORDS most frequent words seen twice
    or more, and the GRAMS most frequent n-grams of each length, so that the model is bounded."""
    known = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    total = docs.where("text is not null and lang is not null").count()
    if total > documents:
        known = known.where(F.col("h") < int(-(2**63) + 2**64 * (documents / total)))
    counts = known.select("text", "lang").mapInArrow(_counted, "lang string, kind int, unit string, n long").groupBy("kind", "unit", "lang").agg(F.sum("n").alias("n"))
    units = counts.groupBy("kind", "unit").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("by"))
    units = units.persist()
    try:
        sums = counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
        tables = [units.where((F.col("kind") == kind) & (F.col("n") >= (2 if kind == 0 else 1))).orderBy(F.desc("n"), "unit").limit(WORDS if kind == 0 else GRAMS).select("unit", "by").toArrow() for kind in range(LONGEST + 1)]
    finally:
        units.unpersist()
    langs = sorted({r.lang for r in sums})
    column = {lang: i for i, lang in enumerate(langs)}
    words: dict[str, int] = {}
    grams: dict[str, int] = {}
    speaks = []
    for kind, table in enumerate(tables):
        totals = np.array([next((r.n for r in sums if r.kind == kind and r.lang == lang), 0) for lang in langs], float)
        into = words if kind == 0 else grams
        for unit, by in zip(table["unit"].to_pylist(), table["by"].to_pylist(), strict=True):
            own = np.full(len(langs), ADDED)
            for entry in by:
                own[column[entry["lang"]]] += entry["n"]
            said = np.log(own / (totals + ADDED * max(1, len(table))))
            # Only the languages' difference counts; the likeliest speaks for itself with 0.
            into[unit] = len(speaks)
            speaks.append(np.maximum(said - said.max(), FLOOR))
    return Model(langs, words, grams, np.array(speaks) if speaks else np.zeros((0, len(langs))))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs(doc_id, text, ...). `und` with score 0 if the text is null or has
    no letter, or nothing was learned; of languages that are as likely the first by name. Only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches):
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(True))).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
