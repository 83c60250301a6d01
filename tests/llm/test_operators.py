"""The training-data operators against brute force, round trips and edge cases, on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from nestwright.llm import byte_bpe, decontamination, fingerprints, language_id, licenses, ngram_jaccard, quality, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, node string, h string, th string"


def docs_of(spark, texts, parts=3):
    rows = [(i, t, "xx", "s", len(t or ""), 5, "n", "h", "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def odd_rows(spark):
    """Nulls, empty and repeated texts, a repeated id, a null id, and column names that clash."""
    return spark.createDataFrame(
        [(1, None, None, None, None, 1, "n", "h", "t"), (2, "", "xx", "s", 0, 1, None, None, None), (3, " \n\t", "xx", "s", 3, 1, "n", "h", "t"), (4, "a b", "xx", None, 3, 1, "n", "h", "t"), (4, "a b", "xx", None, 3, 1, "n", "h", "t"), (5, "a b", None, "s", 3, 1, "n", "h", "t"), (None, "é" * 3000, "xx", "s", 3000, 1, "n", "h", "t")],
        SCHEMA,
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng, n, letters="abcdeéf"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


# 1. Suffix-array dedup.


def removed_by_hand(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(3)
    for k in range(40):
        text = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 200)))
        text = text[:15] * 8 if k % 3 == 0 else text
        data = np.frombuffer(text, np.uint8)
        order = suffix_dedup.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        found = suffix_dedup.common_prefixes(data, order, 1 << 20)
        for i in range(1, len(order)):
            a, b = text[order[i - 1] :], text[order[i] :]
            assert found[i] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("fragments", [2048, 3])
def test_repeats_are_removed(spark, monkeypatch, fragments):
    monkeypatch.setattr(suffix_dedup, "SHARD_FRAGMENTS", fragments)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    rng = random.Random(4)
    shared, other = words(rng, 60), words(rng, 30)
    texts = [None, "", "a" * 900, "ab" * 600, words(rng, 100)]
    for _ in range(40):
        text = words(rng, rng.randint(5, 60))
        text += " " + shared + words(rng, rng.randint(0, 20)) if rng.random() < 0.5 else ""
        texts.append(text + (other + " " + words(rng, 5) + other[: rng.randint(0, len(other))] if rng.random() < 0.4 else ""))
    texts += texts[5:12]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs_of(spark, texts), 60).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_hand(texts, 60)
    kept = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs_of(spark, texts), 60).collect()}
    for i, (_, gone, _, body) in enumerate(removed_by_hand(texts, 60)):
        assert kept.get(i) == (None if gone and not body else texts[i] if texts[i] is None else body.decode(errors="ignore"))


@pytest.mark.parametrize("kind", [np.uint8, suffix_dedup.CODE])
def test_windows_that_cannot_be_repeated_stay_out_of_suffix_arrays(kind):
    rng, length = np.random.default_rng(5), 60
    passage = rng.integers(1, 256, 100)
    bodies = [np.concatenate([rng.integers(1, 256, 80), passage[: (100, 59, 64, 40)[i % 4]], rng.integers(1, 256, 80)]).astype(kind) for i in range(16)]
    data, offsets = np.concatenate(bodies), np.cumsum([0, *map(len, bodies)])
    text, key, frag, start, windows, _ = suffix_dedup.fragments(data, offsets, length)
    group = [(k, w, data[offsets[t] + a : offsets[t] + a + w + length - 1].tobytes()) for t, k, a, w in zip(text.tolist(), key.view(np.int64).tolist(), start.tolist(), windows.tolist(), strict=True)]
    lo, hi = suffix_dedup.may_repeat(group, length, kind)
    whole = suffix_dedup.shard_repeats([(1, w, body) for _, w, body in group], length, kind)
    kept = 0
    for i, ((repeated, _), a, b) in enumerate(zip(whole, lo.tolist(), hi.tolist(), strict=True)):
        # Only windows left out that have no like one, and all of the texts whose passage is too short.
        assert not repeated[:a].any() and not repeated[b:].any()
        assert text[i] % 4 not in (3,) or a == b
        kept += b - a
    assert sum(int(r.sum()) for r, _ in whole) == 4 * 41 + 4 * 5 <= kept < windows.sum() / 4


@pytest.mark.parametrize("coded", [False, True])
def test_a_passage_that_repeats_itself_has_one_row_for_its_periods(monkeypatch, coded):
    rng, length = random.Random(8), 60
    texts = [(words(rng, k % 3 * 30) + " " + f"{'ab' * (k % 5 + 1)} cd " * 700 + words(rng, k % 2 * 80)) for k in range(10)] + ["xyz " * 700] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(texts), *(pa.array(range(len(texts)), t) for t in (pa.int64(), pa.int32(), pa.int32()))], ["text", *suffix_dedup.TEXT])
    data, offsets = suffix_dedup._bytes(batch.column(0), coded)
    text, key, frag, start, windows, _ = suffix_dedup.fragments(data, offsets, length)
    rows = [r for b in suffix_dedup._anchored(length, coded)(iter([batch])) for r in b.to_pylist()]
    whole = [(r["th"], r["key"], r["frag"], r["start"] + k * r["windows"], r["windows"]) for r in rows for k in range(r["run"])]
    assert whole == list(zip(text.tolist(), key.view(np.int64).tolist(), frag.view(np.int64).tolist(), start.tolist(), windows.tolist(), strict=True))
    assert len(rows) < len(whole) / 5
    # A long text is worked on in several steps, whose windows are all there once.
    monkeypatch.setattr(suffix_dedup, "RUN", 500)
    for i in range(len(texts)):
        rows = [r for b in suffix_dedup._anchored(length, coded)(iter([batch.slice(i, 1)])) for r in b.to_pylist()]
        held = [r["start"] + k for r in rows for k in range(r["run"] * r["windows"])]
        assert sorted(held) == list(range(offsets[i + 1] - offsets[i] - length + 1))


def test_passages_that_repeat_themselves_are_removed(spark):
    rng = random.Random(9)
    texts = []
    for k in range(40):
        unit = rng.choice(["a", "ab", "aab ", "word pair ", "é", "a longer one that is said again and again, and once more; "])
        passage = (unit * 400)[rng.randint(0, 9) :][: rng.choice([58, 59, 60, 61, 62, 70, 130, 400, 700])]
        texts.append(words(rng, rng.choice([0, 3, 40])) + passage + words(rng, rng.choice([0, 3, 40])) + passage[: rng.choice([0, 0, 59, 90])])
    texts += texts[:5]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs_of(spark, texts), 60).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_hand(texts, 60)


def test_suffix_arrays_of_symbols():
    data = np.random.default_rng(6).integers(1, 4, 300).astype(suffix_dedup.CODE) << suffix_dedup.CODE(9)
    data = np.concatenate([data, data[:90], data[40:200]])
    order = suffix_dedup.suffix_array(data)
    items = data.tolist()
    assert order.tolist() == sorted(range(len(items)), key=lambda i: items[i:])
    found = suffix_dedup.common_prefixes(data, order, 1 << 20).tolist()
    for i in range(1, len(items)):
        a, b = items[order[i - 1] :], items[order[i] :]
        assert found[i] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_the_pipeline_takes_out_repeated_passages_of_51_words(spark):
    import corpus_pipeline

    rng = random.Random(6)
    short = lambda n: " ".join(rng.choice("abcdefgé") for _ in range(n))
    repeated, less, long = short(51), short(50), "".join(rng.choice("xyz") for _ in range(420))
    own = [f"{words(rng, 8)} start{i}" for i in range(12)]
    ends = [f"{i}end {words(rng, 8)}" for i in range(12)]
    texts, want = [], []
    for i in range(12):
        passage, left = [(repeated, ""), (less, less), (long, ""), (repeated.replace(" ", "\n"), ""), (repeated + " " + less, ""), (repeated.upper(), "")][i % 6]
        texts.append(f"{own[i]} {passage} {ends[i]}")
        want.append((own[i], left, ends[i]))
    texts += [None, "", "b " * 50, " ".join("cde"[k % 3] for k in range(60))]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs_of(spark, texts), "").collect()}
    for i, (a, b, c) in enumerate(want):
        assert "".join(got[i].split()) == f"{a}{b}{c}".replace(" ", "")
    # Repeated in itself at another place: both windows go, and so all words from the first to the last.
    assert (got[12], got[13], got[14]) == (None, "", "b " * 50) and 15 not in got


# 2. N-gram Jaccard join.


def linked_by_hand(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(low)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_short_variants_of_a_frequent_shingle_are_linked(spark):
    texts = []
    for size in range(4, 65):  # one posted shingle in common, frequent from four variants on
        texts += [" ".join(f"g{size}w{k}" for k in range(10)) + f" g{size}v{v}" for v in range(size)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == linked_by_hand(texts)


@pytest.mark.parametrize("tile,parts", [(2048, 32), (4, 2)])
def test_near_duplicates(spark, monkeypatch, tile, parts):
    monkeypatch.setattr(ngram_jaccard, "TILE", tile)
    monkeypatch.setattr(ngram_jaccard, "PARTS", parts)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 3)
    rng = random.Random(5)
    vocabulary = words(rng, 60).split()
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(6)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "To To To To of of of of to to", "to to to of of to of of"]
    for _ in range(90):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own) + rng.choice(["", "\n", " " + " ".join(base[0][:9])]))
    want = linked_by_hand(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in ngram_jaccard.keep_one(docs_of(spark, texts)).collect()) == [i for i, (_, c) in enumerate(want) if i == c]


# 3. Licence scans.


def test_licences(spark):
    texts = [
        "Some text.\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "licensed under the apache-license version 2.0", "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
        "Released under no license", "the mit license is long ago and far away", "All rights reserved.\n" * 3, None, "", "MIT", "x " * 500,
        "As the first pages of this long report said before: this work is licensed under the GNU General\nPublic License, version 3. And more.", "Copyright 2020 Foo. All rights reserved.", "all rights all rights reserved reserved",
        "word " * 70_000 + "The project is released under\tthe MIT License, it says. " + "word " * 70_000,
    ]

    def dice(line, template):
        a, b = (set(licenses.bigrams(licenses.plain_words(x))) for x in (line, template))
        return 2 * len(a & b) / (len(a) + len(b)) if a else 0.0

    want = {}
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        for line in [*lines, *([text] if len(lines) > 1 else [])]:
            score = {k: dice(line, t) for k, t in licenses.TEMPLATES.items()}
            best = max(score.values())
            for k, s in score.items():
                if best >= 0.8 and s == best:
                    old = want.get((i, k), (0, 0))
                    want[i, k] = (max(round(s, 6), old[0]), old[1] + 1)
        # Windows of a template's words, wherever lines end; the long text's ends can't match.
        own = licenses.plain_words((text or "").replace("word " * 69_900, ""))
        seen = [(a, a + n, k, s) for k, t in licenses.TEMPLATES.items() for n in [len(licenses.plain_words(t))] for a in range(len(own) - n + 1) if (s := dice(" ".join(own[a : a + n]), t)) >= 0.8]
        for a, b, k, s in seen:
            if not any(c < b and a < d and o > s for c, d, _, o in seen):
                old = want.get((i, k), (0, 0))
                want[i, k] = (max(round(s, 6), old[0]), old[1])
    got = {(r.doc_id, r.license): (r.dice, r.n_lines) for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == want and (0, "MIT") in got and (6, "proprietary") in got
    assert got[11, "GPL-3.0"] == (1.0, 0) and (11, "GPL-2.0") not in got and got[12, "proprietary"] == (1.0, 0) and got[14, "MIT"] == (1.0, 0)


def test_every_matching_window_has_a_bigram_that_is_sought():
    rng = random.Random(7)
    known = {name: licenses.bigrams(licenses.plain_words(text)) for name, text in licenses.TEMPLATES.items()}
    cut = {name: (len(licenses.plain_words(text)), frozenset(known[name])) for name, text in licenses.TEMPLATES.items()}
    pool = sorted({w for text in licenses.TEMPLATES.values() for w in licenses.plain_words(text)})
    found = 0
    for _ in range(3000):
        own = licenses.plain_words(rng.choice(list(licenses.TEMPLATES.values())))
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(pool)
        text = " ".join(rng.choices(pool, k=3) + own + rng.choices(pool, k=3))
        if licenses.best_windows(text, cut):
            found += 1
            assert re.search(licenses.sought(known), text)
    assert found > 500


# 4. Decontamination.


def test_contaminated_documents_are_found(spark):
    rng = random.Random(6)
    items = [words(rng, n, "abcdefghij") for n in (30, 16, 8, 3, 25)]
    broken = items[0].split()
    for k in (5, 14, 22):
        broken[k] = "zzz"
    texts = [
        words(rng, 50) + " " + items[0].upper() + ", " + words(rng, 20), " ".join(broken), " ".join(items[4].split()[4:20]), " ".join(items[4].split()[:9]), items[2], items[3] + " " + words(rng, 30),
        words(rng, 200, "abcdefghij"), None, "", items[0] + "\n" + items[1],
    ]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {0: [0], 1: [0], 2: [4], 3: [], 4: [2], 5: [], 6: [], 7: [], 8: [], 9: [0, 1]}
    # An item of three tokens is found where it is the whole text.
    short = {r.doc_id: r.item_ids for r in decontamination.contaminated(docs_of(spark, [items[3].upper() + " !", items[3] + " more", items[3].split()[0], None]), bench).collect()}
    assert short == {0: [3], 1: [], 2: [], 3: []}
    assert sorted(r.doc_id for r in decontamination.decontaminated(docs_of(spark, texts), bench).collect()) == [3, 5, 6, 7, 8]
    none = decontamination.contaminated(docs_of(spark, texts), bench.where("false")).collect()
    assert len(none) == len(texts) and not any(r.contaminated for r in none)


# 5. Toxicity.


def test_toxicity_learns(spark):
    rng = random.Random(7)
    vocabulary = words(rng, 400, "abcdefghijklm").split()
    bad = ["zoxwurp", "quyvnorz", "xixtroovy"]

    def text(toxic):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        for _ in range(3 * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        return " ".join(own)

    marks = [i % 5 == 0 for i in range(400)]
    docs = docs_of(spark, [text(m) for m in marks])
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks) if i < 300] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = [(got[i] >= 0.5) == marks[i] for i in range(300, 400)]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for s in got.values())
    assert len(toxicity.score(odd_rows(spark), model).collect()) == 7
    plain = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, plain).collect()} == {0.0}


# 6. Language identification.


def test_languages(spark):
    rng = random.Random(8)
    kinds = {"aa": "abcdefg", "bb": "abchijk", "cc": "uvwxyé"}
    langs = [list(kinds)[i % 3] for i in range(240)]
    rows = [(i, words(rng, 40, kinds[lang]), lang if i < 150 else None) for i, lang in enumerate(langs)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34 !?", "aa"), (902, "", "bb"), (903, "日本", None)], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert np.mean([got[i][0] == langs[i] for i in range(150, 240)]) > 0.97
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903][0] in kinds
    unseen = model.evidence("zzzqqq uvuvuvwx")
    assert unseen.argmax() == model.langs.index("cc")
    nothing = language_id.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


# 7. Fingerprints.


def test_fingerprints_and_edits(spark):
    rng = random.Random(9)
    texts = ["", "x", None, "ab", words(rng, 300), words(rng, 2), words(rng, 900), "é" * 500, words(rng, 40)]
    texts += texts[4:5]
    for count in (len(texts), 1, 2):
        own = texts[-count:]
        got = {r.doc_id: r for r in fingerprints.with_edits(docs_of(spark, own)).collect()}
        assert len(got) == count
        for i, text in enumerate(own):
            text, following = text or "", own[i - 1] or ""
            edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
            a, b, c = (fingerprints.chunks(t) for t in (text, edited, following))
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(a), fingerprints.fingerprint(b)) and fingerprints.parsed(r.fingerprint) == a
            assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    long = words(rng, 2000)
    assert fingerprints.likeness(fingerprints.chunks(long), fingerprints.chunks("inserted " + long)) > 0.95
    assert len(fingerprints.with_edits(odd_rows(spark)).collect()) == 7
    assert sum(fingerprints.chunks(long).values()) == len(long.encode())
    for _ in range(40):  # short texts of which the first half is kept
        text, other = words(rng, 50), words(rng, 50)
        edited = text[: len(text) // 2] + other
        near, far = (fingerprints.likeness(fingerprints.chunks(text), fingerprints.chunks(t)) for t in (edited, other))
        assert near > 0.2 and far < 0.1


def test_chunks_by_hand():
    rng = random.Random(10)
    for _ in range(20):
        body = bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(0, 1500)))
        ends, start, value = [], 0, 0
        mask = 2**32 - 1
        for i, byte in enumerate(body):
            value = ((value << 1) + int(fingerprints._GEAR[byte])) & mask
            size = i + 1 - start
            bits = fingerprints.STRICT if size < fingerprints.NORMAL else fingerprints.LOOSE
            if size == fingerprints.MOST or size >= fingerprints.LEAST and value >> (32 - bits) == 0:
                ends.append(i + 1)
                start = i + 1
        if start < len(body):
            ends.append(len(body))
        assert fingerprints.cuts(fingerprints.rolled(np.frombuffer(body, np.uint8))) == ends


# 8. Quality.


def test_quality_keeps_clean_documents(spark):
    rng = random.Random(11)
    junk = [i % 6 == 0 for i in range(360)]
    texts = [" ".join(w.upper() + "!!" for w in words(rng, 40).split()) if j else words(rng, rng.randint(20, 90)) for j in junk]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(not j)) for i, j in enumerate(junk) if i < 240], "doc_id bigint, quality int")
    found = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    assert np.mean([found[i].selected != junk[i] for i in range(240, 360)]) > 0.97
    assert sorted(r.doc_id for r in quality.selected(docs, labels).collect()) == sorted(i for i, r in found.items() if r.selected)
    assert len(quality.resample(odd_rows(spark), labels).collect()) == 7 and quality.resample(empty(spark), labels).count() == 0


def test_kth_greatest(spark):
    rng = random.Random(12)
    values = [rng.randint(-(2**62), 2**62) for _ in range(150)] + [5, 5, 5, -1, 0]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    for k in (1, 2, 77, 155):
        assert quality.kth_greatest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_greatest(df, "x", 0) is None and quality.kth_greatest(df, "x", 500) == min(values)


# 9. Byte-level BPE.

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RANKS = P.path("byte_bpe_50k.tiktoken")


def test_bpe_is_that_of_the_library(spark):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(13)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["", None, "a" * 5000, "  \n\t x  ", "<|endoftext|>", "don't WE'LL 12345678901234567890", "=" * 300]
    texts += ["".join(chr(rng.choice(points)) if rng.random() < 0.4 else rng.choice(" \n\t\x1c\x85sabcA1²é日 '") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += [words(rng, 40, "abcdefghinorstu") for _ in range(30)]
    encoded = byte_bpe.encode(docs_of(spark, texts), RANKS, P.PATTERN)
    for r in byte_bpe.decode(encoded, RANKS).collect():
        assert r.token_ids == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    digests = {r.doc_id: r for r in byte_bpe.digests(docs_of(spark, texts), RANKS, P.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_appends_and_edits():
    vocabulary = byte_bpe.vocabulary(RANKS)
    rng = random.Random(14)
    own, data = byte_bpe.Prefixes(vocabulary), b""
    for _ in range(60):
        new = words(rng, rng.randint(0, 3), "abenorst").encode().replace(b" ", b"")
        if rng.random() < 0.5:
            own.append(new)
            data += new
        else:
            a = rng.randint(0, len(data))
            b = rng.randint(a, min(len(data), a + 9))
            own.replace(a, b, new)
            data = data[:a] + new + data[b:]
        assert own.data == data and own.last == vocabulary.last_tokens(data) and vocabulary.decode(own.ids()) == data
    long = byte_bpe.Prefixes(vocabulary, words(rng, 3000, "abenorst").encode().replace(b" ", b""))
    assert long.replace(50, 51, b"x") < 1000


# 10. Token counts.


def test_token_counts(spark, tmp_path):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    texts = ["a b c", "a b c", None, "", "d  e\n", "longer text hère"] + ["a b c"] * 70
    docs = docs_of(spark, texts)
    kept = ["a b c", None, "", "d  e\n", "longer text hère"]
    count = lambda path: token_counts.maintained(docs, path, RANKS, P.PATTERN)
    want = {"words-1": (5, 3 + 0 + 0 + 2 + 3, 26), "byte_bpe_50k": (5, sum(len(library.encode_ordinary(t or "")) for t in kept), 26)}
    for _ in range(2):  # again over the same ledger: nothing changes
        assert {(r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in count(str(tmp_path / "a")).collect()} == want
    ledger = token_counts.Ledger(spark, str(tmp_path / "a"))
    assert ledger.committed() == ["delete", "insert", "revise"]
    assert not ledger.commit("insert", token_counts.deltas(docs, "words-1", token_counts.words_1(docs.text)))
    (tmp_path / "a" / "new-torn").mkdir()
    assert ledger.committed() == ["delete", "insert", "revise"]
    assert token_counts.Ledger(spark, str(tmp_path / "none")).totals().count() == 0
    with pytest.raises(ValueError):
        ledger.commit("a/b")
    # A writer that meant to commit a name that another has taken meanwhile.
    late = token_counts.Ledger(spark, str(tmp_path / "a"))
    late._there = lambda batch, seen=[]: len(seen) > 0 or seen.append(batch)
    assert not late.commit("insert", token_counts.deltas(docs, "words-1", token_counts.words_1(docs.text)))
    assert ledger.totals().count() == 2 and not [p for p in (tmp_path / "a").iterdir() if p.name.startswith("new-") and p.name != "new-torn"]
    assert token_counts.maintained(empty(spark), str(tmp_path / "b"), RANKS, P.PATTERN).count() == 0


# All of them on odd rows and on no rows.


def test_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id bigint, text string")
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    for docs, n in ((odd_rows(spark), 7), (empty(spark), 0)):
        assert suffix_dedup.remove_repeats(docs).count() == n
        assert ngram_jaccard.near_duplicates(docs).count() == n
        assert decontamination.contaminated(docs, bench).count() == n
        assert licenses.scan(docs).count() == 0
        assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == n
        assert language_id.predict(docs, language_id.fit(docs)).count() == n
        assert fingerprints.with_edits(docs).count() == n
        assert quality.resample(docs, labels).count() == n
        assert byte_bpe.digests(docs, RANKS, P.PATTERN).count() == n
    rows = {r.doc_id: r.component_id for r in ngram_jaccard.near_duplicates(odd_rows(spark)).collect()}
    assert rows == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    passage, item = words(rng, 90), words(rng, 30)
    texts = [words(rng, 150) for _ in range(30)]
    texts += [texts[0], texts[1] + " end", words(rng, 40) + " " + passage + " " + words(rng, 40), words(rng, 40) + " " + passage, words(rng, 60) + " " + item, " ".join(w.upper() + "!!" for w in words(rng, 90).split())]
    docs = docs_of(spark, texts).drop("n", "node", "h", "th")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(35, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "-"))
        seen.write.parquet(path)
        seen = spark.read.parquet(path)
        kept.append(sorted(r.doc_id for r in seen.collect()))
    assert kept[0] == list(range(35)) and kept[1] == [*range(30), 32, 33, 34] and kept[2] == kept[1] and kept[3] == [*range(30), 32, 33] == kept[4]
    final = {r.doc_id: r for r in seen.collect()}
    assert passage not in final[32].text and passage not in final[33].text and all(r.decodes for r in final.values()) and final[5].text == texts[5]
    assert {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: r.token_ids for i, r in final.items()}


def test_links_of_long_chains(spark):
    from nestwright.llm.components import components

    rng = random.Random(16)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for node in [n for n in near if near[n] - {n}]:
        found, todo = {node}, [node]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in found and not found.add(x)]
        assert got[node] == min(found)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_workers_get_small_batches(spark):
    from nestwright.llm import common

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    own = spark.newSession()
    rows = own.range(0, 3 * common.BATCH_ROWS, 1, 1)
    common.small_batches(own)
    assert [r.n for r in rows.mapInArrow(sizes, "n long").collect()] == [common.BATCH_ROWS] * 3
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    common.small_batches(own)
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"


def test_every_stage_of_the_pipeline_asks_for_small_batches(spark):
    import corpus_pipeline
    from nestwright.llm import common

    for _, stage in corpus_pipeline.STAGES:
        own = spark.newSession()
        stage(own, docs_of(own, ["a b c d e f g"] * 3), "/root/testdata/sf0.001")
        assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.BATCH_ROWS)
