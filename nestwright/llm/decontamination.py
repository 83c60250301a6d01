"""Benchmark decontamination by spaced seeds.

A seed hashes the tokens that a fixed mask selects from a few that follow one another and ignores the rest, so that a
passage with words replaced still shares seeds with its source. Seeds of the benchmark and of the documents are joined;
each hit puts an item beside a document at one offset, and the aligned tokens are compared for the longest stretch
that agrees but for a few substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.common import FILTER_BITS, _BYTE, bits_of, may_have, mix, powers, slices, stash, text_bytes

#: Which of the tokens that follow one another a seed looks at.
MASKS = ("11101011", "110010111", "1101100101", "111111")
#: Tokens of an agreement at least (all of a shorter item), and what a token that differs takes from one that agrees.
TOKENS, MISMATCH, SCORE = 13, 2, 10
#: An item of fewer tokens than this is found only where it is the whole text: inside of others it tells nothing.
SHORTEST = 6
#: Parts into which the documents' hits of one seed are dealt.
PARTS = 16

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens (runs of letters, digits and other characters beyond ASCII, in lower case), and each
    text's first token."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.string())))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


_PLACES = np.random.Generator(np.random.PCG64(9)).integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(tokens: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask: (hash, text's number, place of its first token in the text) of the seeds inside a text; and of each
    text of fewer than SHORTEST tokens a hash of all of them."""
    sizes = np.diff(first)
    for n in range(1, SHORTEST):
        text = np.flatnonzero(sizes == n)
        value = np.full(len(text), len(MASKS) + n, np.uint64)
        for k in range(n):
            value += tokens[first[text] + k] * _PLACES[k]
        yield mix(value), text, np.zeros(len(text), np.int64)
    for number, mask in enumerate(MASKS):
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            continue
        value = np.full(n, number + 1, np.uint64)
        for k, used in enumerate(mask):
            if used == "1":
                value += tokens[k : k + n] * _PLACES[k]
        text = np.searchsorted(first, np.arange(n), "right") - 1
        own = np.arange(n) + len(mask) <= first[text + 1]
        yield mix(value)[own], text[own], (np.arange(n) - first[text])[own]


def _seeded(words: np.ndarray | None):
    """(seed, place, id columns...) of the rows' seeds; with a bitmap only of those that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, first = token_hashes(batch.column(0))
            for value, text, place in seeds(tokens, first):
                if words is not None:
                    keep = np.ones(len(value), bool)
                    for at in ((value >> np.uint64(8)) % np.uint64(FILTER_BITS), (value >> np.uint64(36)) % np.uint64(FILTER_BITS)):
                        at = at.astype(np.int64)
                        keep &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                    value, text, place = value[keep], text[keep], place[keep]
                if len(value):
                    rows = pa.array(text)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(place.astype(np.int32)), *(c.take(rows) for c in batch.columns[1:])], ["seed", "place", *batch.schema.names[1:]])

    return run


def _bitmap(seeded: DataFrame) -> np.ndarray:
    """2 MB with two bits set for each seed, whatever the size of the benchmark; a full one lets all pass."""
    at = seeded.select(F.explode(F.array(F.expr(f"pmod(shiftrightunsigned(seed, 8), {FILTER_BITS}L)"), F.expr(f"pmod(shiftrightunsigned(seed, 36), {FILTER_BITS}L)"))).alias("at"))
    table = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[table["word"].to_numpy()] = table["bits"].to_numpy()
    return words.view(np.uint64)


def agreement(document: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int, int]:
    """(score, tokens, first token in the document) of the best stretch with the item at this offset of the document."""
    a, b = max(0, offset), min(len(document), offset + len(item))
    if b <= a:
        return 0, 0, a
    gain = np.where(document[a:b] == item[a - offset : b - offset], 1, -MISMATCH)
    sums = np.concatenate([[0], np.cumsum(gain)])
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    start = int(sums[: end + 1].argmin())
    return int(sums[end] - sums[start]), end - start, a + start


def agrees(score: int, tokens: int, item: int) -> bool:
    """TOKENS tokens or more of which few differ; of a shorter item all but one, of one below SHORTEST all."""
    if item < SHORTEST:
        return score == item
    return tokens >= min(TOKENS, item - 1) and score >= min(SCORE, item - 1 - MISMATCH)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, tn, item_id, tokens, score, start) of the hits that hold."""
    for batch in slices(batches):
        names = batch.schema.names
        tokens, first = token_hashes(batch.column(names.index("text")))
        rows = []
        for i, (th, tn, hits) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in ("th", "tn", "hits")), strict=True)):
            own = tokens[first[i] : first[i + 1]]
            best: dict[int, tuple] = {}
            for hit in hits:
                item = np.frombuffer(hit["tokens"], np.uint64)
                if len(item) < SHORTEST and len(own) != len(item):
                    continue
                for offset in hit["offsets"]:
                    found = agreement(own, item, offset)
                    if agrees(found[0], found[1], len(item)) and found > best.get(hit["item_id"], (0,)):
                        best[hit["item_id"]] = found
            rows += [(th, tn, item_id, n, score, start) for item_id, (score, n, start) in sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["th", "tn", "item_id", "tokens", "score", "start"])


def _itemised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        tokens, first = token_hashes(batch.column(0))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([tokens[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["item", "tokens"])


def _known(df: DataFrame) -> DataFrame:
    return df.withColumn("th", F.xxhash64("text")).withColumn("tn", F.octet_length("text"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(th, tn, item_id, tokens, score, start): for each distinct text, known by hash and length, the items that it
    overlaps, with the stretch's tokens, score and first token."""
    items = benchmark.where("text is not null").select(F.col("text").cast("string").alias("text"), F.col("item_id").cast("long").alias("item_id")).distinct()
    items = items.withColumn("item", F.xxhash64("text", "item_id"))
    bodies = items.select("text", "item").mapInArrow(_itemised, "item long, tokens binary").where(F.octet_length("tokens") > 0)
    bodies = stash(bodies.join(items.select("item", "item_id"), "item"), "items")
    seeded = stash(items.select("text", "item").mapInArrow(_seeded(None), "seed long, place int, item long").join(bodies.select("item"), "item", "left_semi"), "seeds")
    known = _known(docs.where("text is not null").select(F.col("text").cast("string").alias("text")))
    hits = known.mapInArrow(_seeded(_bitmap(seeded)), "seed long, place int, th long, tn int")
    # A phrase may stand in much of the corpus: its hits are dealt to parts, to each of which the items' seeds go.
    sought = seeded.select("seed", F.col("place").alias("item_place"), "item", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    hits = hits.withColumn("part", F.pmod(F.xxhash64("th", "tn", "place"), F.lit(PARTS)).cast("int")).join(sought, ["seed", "part"])
    hits = hits.select("th", "tn", "item", (F.col("place") - F.col("item_place")).alias("offset")).distinct()
    # An item's tokens go along once for each text, not for each place.
    hits = hits.groupBy("th", "tn", "item").agg(F.collect_list("offset").alias("offsets")).join(bodies, "item")
    hits = stash(hits.groupBy("th", "tn").agg(F.collect_list(F.struct("item_id", "tokens", "offsets")).alias("hits")), "hits")
    texts = may_have(known, F.xxhash64("th", "tn"), bits_of(hits, F.xxhash64("th", "tn"))).where("may").select("text", "th", "tn").groupBy("th", "tn").agg(F.first("text").alias("text"))
    return texts.join(hits, ["th", "tn"]).mapInArrow(_verified, "th long, tn int, item_id long, tokens int, score int, start int")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, tokens) of each row of docs(doc_id, text, ...): whether its text
    overlaps an item of benchmark(item_id, text), which ones in order (a null id is not listed but counts), and the
    tokens of the longest overlap. Null and empty texts overlap nothing, nor do items without tokens; an item of fewer
    than SHORTEST tokens is found where it is the whole text; items that repeat count by id; rows that repeat a text get
    the same; of stretches that score alike the longest counts, then the last. A text of any length is gone through whole. An
    empty benchmark finds nothing; no rows: no rows. Other columns are ignored."""
    by = overlaps(docs, benchmark).groupBy("th", "tn").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_items"), F.max("tokens").alias("tokens"))
    by = stash(by, "overlaps")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(-1)).alias("tn"))
    marked = may_have(rows, F.xxhash64("th", "tn"), bits_of(by, F.xxhash64("th", "tn")))
    # Only rows that may overlap are shuffled.
    found = marked.where("may").join(by, ["th", "tn"], "left").select("doc_id", "n_items", "item_ids", "tokens")
    none = marked.where("not may").select("doc_id", *(F.lit(None).cast(by.schema[c].dataType).alias(c) for c in ("n_items", "item_ids", "tokens")))
    return found.union(none).select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("tokens", F.lit(0)).cast("int").alias("tokens")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose text overlaps no item; null texts stay. Columns are those of docs."""
    found = stash(overlaps(docs, benchmark).select("th", "tn").distinct(), "overlaps")
    own = docs.withColumn("_th", F.xxhash64(F.col("text").cast("string"))).withColumn("_tn", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(-1)))
    marked = may_have(own, F.xxhash64("_th", "_tn"), bits_of(found, F.xxhash64("th", "tn")), "_may")
    clean = marked.where("_may").join(found, (F.col("_th") == found["th"]) & (F.col("_tn") == found["tn"]), "left_anti")
    return marked.where("not _may").select(docs.columns).unionByName(clean.select(docs.columns))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
