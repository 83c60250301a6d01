"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a text is cut, so that an insertion moves no cut but those beside it.
Cuts are normalised: below a chunk's normal size a stricter mask applies, above it a looser one. A fingerprint is the
set of the chunks' digests, each with the bytes that its chunks have; likeness is the weight that two have in common
over the weight of the lighter. In a text of about a kilobyte or less such chunks are too few to tell much, so it has
finer ones as well, by a hash of the last 8 bytes; two texts that both have them are compared by these.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.common import slices

#: Bytes of a chunk: least (the window of the hash), normal, most; bits of the masks below and above normal.
LEAST, NORMAL, MOST, STRICT, LOOSE = 32, 64, 256, 7, 5
#: The same of the finer chunks, which texts of fewer bytes than FINE_BELOW have too.
FINE, FINE_BELOW = (8, 16, 64, 5, 3), 1024
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 256, dtype=np.uint32)


def rolled(data: np.ndarray, window: int = LEAST) -> np.ndarray:
    """At each byte the gear hash of it and those before in the window, a power of two: the sum of their values, each
    shifted left by its distance."""
    out = _GEAR[data]
    k = 1
    while k < window:
        if len(out) > k:
            out[k:] += out[:-k] << np.uint32(k)
        k *= 2
    return out


def cuts(hashes: np.ndarray, sizes: tuple[int, int, int, int, int] | None = None) -> list[int]:
    """Ends of the chunks of one text, from the hashes at its bytes."""
    least, normal, most, strict, loose = sizes or (LEAST, NORMAL, MOST, STRICT, LOOSE)
    n, out, start = len(hashes), [], 0
    maybe = np.flatnonzero(hashes >> np.uint32(32 - loose) == 0)
    strictly = (hashes[maybe] >> np.uint32(32 - strict) == 0).tolist()
    for at, hard in zip((maybe + 1).tolist(), strictly, strict=True):
        while at - start > most:
            start += most
            out.append(start)
        if at - start >= (least if hard else normal):
            out.append(at)
            start = at
    while n - start > most:
        start += most
        out.append(start)
    if n > start:
        out.append(n)
    return out


def chunks(text: str) -> dict[int, int]:
    """Bytes by chunk digest (48 bits, of which the last is 1 for the finer chunks)."""
    body = text.encode()
    data = np.frombuffer(body, np.uint8)
    out: dict[int, int] = {}
    for fine in (0, 1)[: 1 + (len(body) < FINE_BELOW)]:
        start = 0
        for end in cuts(rolled(data, FINE[0]), FINE) if fine else cuts(rolled(data)):
            digest = xxhash.xxh3_64_intdigest(body[start:end]) >> 16 & ~1 | fine
            out[digest] = out.get(digest, 0) + end - start
            start = end
    return out


def fingerprint(own: dict[int, int]) -> str:
    """Base64 of the digests in order, each with its weight (4 bytes)."""
    return base64.b64encode(b"".join(d.to_bytes(6, "big") + w.to_bytes(4, "big") for d, w in sorted(own.items()))).decode()


def parsed(text: str) -> dict[int, int]:
    body = base64.b64decode(text)
    return {int.from_bytes(body[i : i + 6], "big"): int.from_bytes(body[i + 6 : i + 10], "big") for i in range(0, len(body), 10)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """0 to 1, by the finer chunks where both have them; 1 for two empty texts, 0 if only one is."""
    if not a or not b:
        return float(not a and not b)
    fine = int(any(d & 1 for d in a) and any(d & 1 for d in b))
    a, b = ({d: w for d, w in x.items() if d & 1 == fine} for x in (a, b))
    return sum(min(w, b[d]) for d, w in a.items() if d in b) / min(sum(a.values()), sum(b.values()))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `fingerprint` more, which replaces one of that name; a null text is empty."""
    kept = [c for c in docs.columns if c != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            own = [fingerprint(chunks(t or "")) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], [*kept, "fingerprint"])

    return docs.select(kept).mapInArrow(run, docs.select(kept).schema.add("fingerprint", "string"))


def _placed(firsts: np.ndarray):
    """Rows (bucket, edge, doc_id, text): every row in its bucket, and a bucket's first rows once more for the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = max(0, len(firsts) - 1)
        for batch in batches:
            ids = batch.column(0)
            missing = np.asarray(ids.is_null())
            values = ids.fill_null(0).to_numpy()
            bucket = np.clip(np.searchsorted(-firsts, -values, "right") - 1, 0, None) if len(firsts) else np.zeros(len(values), np.int64)
            bucket[missing] = last
            edge = np.flatnonzero(~missing & np.isin(values, firsts))
            again = pa.RecordBatch.from_arrays([pa.array((bucket[edge] - 1) % (last + 1), pa.int32()), pa.array(np.ones(len(edge), np.int32)), *batch.take(pa.array(edge)).columns], ["bucket", "edge", "doc_id", "text"])
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.zeros(len(bucket), np.int32)), *batch.columns], ["bucket", "edge", "doc_id", "text"])
            if len(edge):
                yield again

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket; in a bucket the documents in order, then the first of the next bucket."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    rows: list[tuple] = []

    def told(doc_id, text: str, own: dict, following: str, other: dict) -> None:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = chunks(edited)
        rows.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, other)))

    before = first = None
    for batch in slices(batches):
        for bucket, edge, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if before is not None and before[0] != bucket:  # the bucket before had no next one: it was the only one
                told(*before[1:], *first[2:])
                before = None
            if edge and before is None:
                continue
            row = (bucket, doc_id, text or "", chunks(text or ""))
            if before is not None:
                told(*before[1:], *row[2:])
            else:
                first = row
            before = None if edge else row
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
    if before is not None:
        told(*before[1:], *first[2:])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of
    docs(doc_id, text, ...).

    The edited text has the next document's first characters in place of its own second half. Next is the row that
    follows in descending order of doc_id, then of text, nulls last; after the last comes the first. Rows that repeat
    both are alike, so their order doesn't matter. A null text is empty; a text of any length is cut whole; no rows: no
    rows. Other columns are ignored. One shuffle of the texts, by ranges of doc_id; no task sees more than its range and the row after it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, min(5000, 3 * parts))
    found = docs.select(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", [i / count for i in range(1, count)] or [0.5], 20 * count).alias("at")).first()
    # Each bucket begins at a doc_id that there is.
    firsts = np.array(sorted({found.top, *(found.at or [])}, reverse=True) if found.top is not None else [], np.int64)
    placed = docs.mapInArrow(_placed(firsts), "bucket int, edge int, doc_id long, text string")
    ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "edge", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    return ordered.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
