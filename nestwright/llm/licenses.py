"""Licence notices by the Dice coefficient of word bigrams.

Every line of a text, and the text as a whole, is normalised (lower case, runs of other than letters, digits and full
stops between digits as one space) and compared with licence templates. With a words in a line and b in a template
their Dice coefficient is at most 2 min(a-1, b-1) / (a + b - 2), so most lines are out of reach of every template by
their length alone and none of their bigrams is made.

A notice inside a longer line, or wrapped over lines, is found by windows of as many words as a template has, at every
place of the whole text. Few texts have any that can match: of any template's bigrams all but some must be there, so
that one of the longest of them is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.llm.common import slices

#: Notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
}
#: A notice is found at this coefficient, in hundredths.
PERCENT = 80

_WORD = re.compile("[a-z0-9]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def plain_words(text: str) -> list[str]:
    """The words of a template, as normalised() makes those of a line."""
    out, word = [], ""
    for c in text:
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "a" <= c <= "z" or "0" <= c <= "9":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def normalised(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def reach(size: int, percent: int = PERCENT) -> tuple[int, int]:
    """The least and the most distinct bigrams of a line that a template of `size` can match."""
    fits = [n for n in range(1, size * 200 // percent + 2) if 200 * min(n, size) >= percent * (n + size)]
    return min(fits), max(fits)


def needed(size: int, percent: int = PERCENT) -> int:
    """How many of a template's `size` bigrams a window must have at least, whatever its own number."""
    return max(1, -(-percent * size // (200 - percent)))


def sought(known: dict[str, list[str]], percent: int = PERCENT) -> str:
    """A pattern of which every text that has a matching window has a match: a window lacks at most size - needed of a
    template's bigrams, so it has one of any more than these."""
    some = {g for own in known.values() for g in sorted(own, key=lambda g: (-len(g), g))[: len(own) - needed(len(own), percent) + 1]}
    return "|".join(g.replace(" ", "[^a-z0-9]+") for g in sorted(some))


def best_windows(text: str, templates: dict[str, tuple[int, frozenset[str]]], percent: int = PERCENT) -> dict[str, float]:
    """The best coefficient of each licence, given as words and bigrams, that a window of the text is like. A window
    doesn't count if one that overlaps it is more like a template, its own or another."""
    words = _WORD.findall(text.translate(_LOW))
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    held: list[tuple[int, int, str, float]] = []
    for name, (size, own) in templates.items():
        if len(words) < size:
            continue
        sums = np.concatenate([[0], np.cumsum(np.fromiter((g in own for g in grams), np.int64, len(grams)))])
        for at in np.flatnonzero(sums[size - 1 :] - sums[: len(sums) - size + 1] >= needed(len(own), percent)).tolist():
            window = set(grams[at : at + size - 1])
            shared, total = len(window & own), len(window) + len(own)
            if 200 * shared >= percent * total:
                held.append((at, at + size, name, 2.0 * shared / total))
    held.sort()
    widest = max((size for size, _ in templates.values()), default=0)
    best: dict[str, float] = {}
    first = 0
    for at, end, name, dice in held:
        while held[first][0] <= at - widest:
            first += 1
        beaten = False
        for other in range(first, len(held)):
            if held[other][0] >= end:
                break
            if held[other][1] > at and held[other][3] > dice:
                beaten = True
                break
        if not beaten:
            best[name] = max(dice, best.get(name, 0.0))
    return best


def _windows(templates: dict[str, tuple[int, frozenset[str]]], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(doc_id, row, name, dice) for text, doc_id, row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for name, dice in best_windows(text, templates, percent).items()]
            columns = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True))
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "row", "license", "dice"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """(doc_id, license, dice, n_lines) for each row of docs(doc_id, text, ...) and each licence found in it: the best
    coefficient (of distinct bigrams) of a line, the text or a window of words, and the lines that reach `percent`
    hundredths, the whole text counting as one: 0 if the notice stands only inside of a line or over several.

    Rows are told apart by doc_id and text; rows that repeat both give one. Null and empty texts, and templates of
    fewer than two words, give none. A line counts for the template that it is most like; of
    windows that overlap the one that is most like its template counts, all of several that are so as much. A text of any
    length is gone through whole. Other columns are ignored."""
    known = {name: own for name, text in sorted((TEMPLATES if templates is None else templates).items()) if (own := bigrams(plain_words(text)))}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if not known:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_lines")).where("false")
    spans = [reach(len(own), percent) for own in known.values()]
    # A line has a bigram at most for each pair of neighbours, and of n distinct ones repeats may be many: the lower bound holds for words.
    least = min(a for a, _ in spans) + 1
    row = F.xxhash64("doc_id", "text").alias("row")
    lines = docs.select("doc_id", row, F.explode(F.concat(F.split("text", "\n"), F.when(F.instr("text", "\n") > 0, F.array("text")).otherwise(F.array().cast("array<string>")))).alias("line"))
    words = lines.where(F.length("line") >= 2 * least - 1).select("doc_id", "row", F.split(normalised(F.col("line")), " ").alias("words"))
    words = words.where(F.size("words") >= least)
    vocabulary = sorted({g for own in known.values() for g in own})
    pairs = F.array_distinct(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    most = max(b for _, b in spans)
    # Only a line that repeats itself can have more words than the most distinct bigrams allow.
    made = words.where((F.size("words") <= most + 1) | (F.size(F.array_distinct("words")) <= most + 1)).select("doc_id", "row", pairs.alias("own"))
    made = made.where(F.arrays_overlap("own", F.array(*map(F.lit, vocabulary))))
    scored = [
        F.struct(F.lit(name).alias("license"), F.size(F.array_intersect("own", F.array(*map(F.lit, own)))).alias("shared"), (F.size("own") + len(own)).alias("total"))
        for name, own in known.items()
    ]
    matched = made.select("doc_id", "row", F.filter(F.transform(F.array(*scored), lambda m: F.struct(m["license"].alias("license"), (2.0 * m["shared"] / m["total"]).alias("dice"), (200 * m["shared"] >= percent * m["total"]).alias("fits"))), lambda m: m["fits"]).alias("ms"))
    # A line stands for the template that it is most like, for each of several that it is like as much.
    found = matched.where(F.size("ms") > 0).withColumn("top", F.array_max(F.transform("ms", lambda m: m["dice"]))).select("doc_id", "row", "top", F.explode("ms").alias("m")).where("m.dice = top").select("doc_id", "row", "m.license", "m.dice")
    own = {name: (len(plain_words(text)), frozenset(known[name])) for name, text in sorted((TEMPLATES if templates is None else templates).items()) if name in known}
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    inside = docs.where(low.rlike(sought(known, percent))).select("text", "doc_id", row).mapInArrow(_windows(own, percent), "doc_id long, row long, license string, dice double")
    found = found.withColumn("n", F.lit(1)).unionByName(inside.withColumn("n", F.lit(0)))
    best = found.groupBy("doc_id", "row", "license").agg(F.max("dice").alias("dice"), F.sum("n").alias("n_lines"))
    return best.select("doc_id", "license", F.round("dice", 6).alias("dice"), F.col("n_lines").cast("long").alias("n_lines"))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """One row per document: its licences in order of name, and the best coefficient of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("license", "dice", "n_lines"))).alias("found"))
    return found.select("doc_id", F.array_join("found.license", ",").alias("licenses"), F.element_at("found.dice", 1).alias("first_dice"), F.array_max("found.dice").alias("best_dice"), F.aggregate("found.n_lines", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_lines"))


def oracle(percent: int = PERCENT) -> str:
    """The same by whole-table SQL, without the bounds."""
    values = ", ".join(f"('{name}', '{gram}', {len(own)})" for name, text in TEMPLATES.items() if (own := bigrams(plain_words(text))) for gram in own)
    sizes = ", ".join(f"('{name}', {len(plain_words(text))})" for name, text in TEMPLATES.items())
    return f"""
WITH t(license, gram, size) AS (VALUES {values}),
z(license, n_words) AS (VALUES {sizes}),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, hash(text) AS h, unnest(CASE WHEN len(ls) > 1 THEN list_append(ls, text) ELSE ls END) AS line FROM d),
n AS (SELECT doc_id, h, row_number() OVER () AS line_id, string_split(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM l),
g AS (SELECT doc_id, h, line_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS own FROM n WHERE len(w) > 1),
p AS (SELECT doc_id, h, line_id, len(own) AS size_own, unnest(own) AS gram FROM g),
m AS (SELECT doc_id, h, line_id, license, count(*) AS shared, any_value(size_own) + any_value(size) AS total FROM p JOIN t USING (gram) GROUP BY ALL),
k AS (SELECT *, 2.0::DOUBLE * shared / total AS dice FROM m WHERE 200 * shared >= {percent} * total),
f AS (SELECT doc_id, h, license, dice, 1 AS n FROM (SELECT *, max(dice) OVER (PARTITION BY line_id) AS top FROM k) WHERE dice = top),
x AS (SELECT row_number() OVER () AS row_id, doc_id, h, w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS grams FROM (SELECT doc_id, hash(text) AS h, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL)),
y AS (SELECT row_id, len(w) AS n_text, unnest(grams) AS gram, unnest(range(1, len(w))) AS place FROM x WHERE len(w) > 1),
s AS (SELECT row_id, license, size, n_words, n_text, gram, unnest(range(place - n_words + 2, place + 1)) AS since FROM y JOIN t USING (gram) JOIN z USING (license)),
c AS (SELECT row_id, license, size, n_words, since, count(DISTINCT gram) AS shared FROM s WHERE since >= 1 AND since + n_words - 1 <= n_text GROUP BY ALL HAVING 200 * count(DISTINCT gram) >= {percent} * (size + count(DISTINCT gram))),
e AS (SELECT row_id, doc_id, h, license, since, since + n_words AS upto, shared, size + len(list_distinct(grams[since:since + n_words - 2])) AS total FROM c JOIN x USING (row_id)),
v AS (SELECT *, 2.0::DOUBLE * shared / total AS dice FROM e WHERE 200 * shared >= {percent} * total),
i AS (SELECT doc_id, h, license, dice, 0 AS n FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.row_id = v.row_id AND o.since < v.upto AND o.upto > v.since AND o.dice > v.dice)),
b AS (SELECT doc_id, h, license, round(max(dice), 6) AS dice, sum(n) AS n_lines FROM (SELECT * FROM f UNION ALL SELECT * FROM i) GROUP BY ALL)
SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses, CAST(arg_min(dice, license) AS DOUBLE) AS first_dice, CAST(max(dice) AS DOUBLE) AS best_dice, CAST(sum(n_lines) AS BIGINT) AS n_lines
FROM b GROUP BY doc_id"""
