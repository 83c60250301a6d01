"""Removal of every byte that a long repeated byte string covers (exact substring deduplication).

A window is a string of `length` bytes. Of its grams of GRAM bytes the one with the least hash, the leftmost
of equals, is its *anchor*; the windows of a text that share an anchor follow one another, and the bytes
they cover are a *fragment*. Equal windows have equal anchors at equal places, so only fragments whose anchor
gram stands somewhere else too can hold a repeat; all others are never moved. A passage that repeats itself over and over
has a like fragment for each of its periods: these are one row, with their number. What is left is dealt by anchor:

1. a fragment that stands twice as a whole, told by a 64-bit hash of its bytes, is repeated in all its windows;
   nothing has to be compared;
2. different fragments of one anchor are gathered into shards of bounded size. What windows of nearly one place
   about the anchor have in common is their *core*; windows whose core stands in no other fragment of the anchor can't
   be repeated and are left out. Each shard gets a suffix array of the rest (Larsson-Sadakane refinement), common
   prefixes by Kasai's recurrence, and the runs of suffixes with `length` bytes in common are its repeats;
3. an anchor with more fragments than a shard takes is cut over several; windows that are alone in their
   shard are then looked up in those of the anchor's other shards by binary search.

Texts are known by a 96-bit hash and their length, so equal texts are worked on once. One anchor, and one fragment,
may hold much of the corpus: their places are dealt to PARTS parts by text as well. Passages can also be counted in
words: the same is done to a string of one 32-bit symbol for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.common import _BYTE, beside_group, bits_of, may_have, mix, powers, slices, stash, text_bytes, unstash, word_spans

LENGTH, GRAM = 400, 32
#: Fragments of one anchor in a shard, and bytes of a shard unless one anchor's fragments are more.
SHARD_FRAGMENTS, SHARD_BYTES = 2048, 1 << 20
#: Windows that one numpy pass handles; longer texts are cut into overlapping runs.
RUN = 1 << 22
#: Bits for a place in a run, so that windows of equal bytes rank their grams alike wherever they stand.
PLACE = 23
#: What stands for a word where passages are counted in words: a hash of its own. Symbols of a gram then; words of a passage.
CODE, CODE_GRAM, WORDS = np.uint32, 8, 51
#: Cores of an anchor, each of the windows that begin at about one distance from it.
CORES = 8
#: Parts into which the places of an anchor or a fragment are dealt.
PARTS = 256


_SYMBOL = np.uint64(0x9E3779B97F4A7C15)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE[data] if data.dtype == np.uint8 else mix(data + _SYMBOL)) * up[: len(data)], out=sums[1:])
    return sums


def _gram(data: np.ndarray, length: int) -> int:
    return min(GRAM if data.dtype == np.uint8 else CODE_GRAM, length)


def _grams(sums: np.ndarray, gram: int) -> np.ndarray:
    n = len(sums) - gram
    return mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][:n])


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values that follow one another."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(rows, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def fragments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text's number, anchor's hash, fragment's hash, first window, windows, anchor's place from it) of each fragment."""
    gram = _gram(data, length)
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = _prefix_sums(data)
    grams = _grams(sums, gram)
    # The hash without its last bits, then the place: of the same bytes the order is the same in every run.
    bits = np.uint64(PLACE)
    ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    windows = len(data) - length + 1
    anchors = (_least(ranked, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(windows + 1, bool)
    change = np.ones(windows, bool)
    change[1:] = anchors[1:] != anchors[:-1]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= length:
            inside[a : b - length + 1] = True
            change[a] = True
    first = np.flatnonzero(change & inside[:-1])
    breaks = np.flatnonzero(change | ~inside[:-1])
    following = np.searchsorted(breaks, first, "right")
    last = np.where(following < len(breaks), breaks[np.minimum(following, len(breaks) - 1)], windows)
    text = np.searchsorted(offsets, first, "right") - 1
    return text, grams[anchors[first]], _hashes(sums, first, last + length - 1), first - offsets[text], last - first, anchors[first] - first


def like_runs(text: np.ndarray, key: np.ndarray, frag: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of fragments in order: where a run of like ones that follow one another in a text begins, and how many it has."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (frag[1:] != frag[:-1]) | (windows[1:] != windows[:-1]) | (start[1:] != start[:-1] + windows[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(text)))


def _bytes(texts: pa.Array, coded: bool) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and offsets, or with `coded` a symbol for each word."""
    data, offsets = text_bytes(texts)
    if not coded:
        return data, offsets
    starts, ends, first = word_spans(data, offsets)
    return np.maximum(_hashes(_prefix_sums(data), starts, ends).astype(CODE), CODE(1)), first


def _anchored(length: int, coded: bool):
    """Rows of fragments: (key, frag, th, tm, tn, start, windows, run): of `run` like ones in a row the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = _bytes(batch.column(0), coded)
            step = RUN if len(data) > RUN + length else len(data) or 1
            many = len(offsets) > 2
            # Only a slice of one long text takes several steps; of many texts the codes may be longer than the texts.
            for at in range(0, 1 if many else max(1, len(data) - length + 1), step):
                part = data if many else data[at : at + step + length - 1]
                text, key, frag, start, windows, _ = fragments(part, offsets if many else np.array([0, len(part)]), length)
                first, count = like_runs(text, key, frag, start, windows)
                rows = pa.array(text[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first].view(np.int64)), pa.array(frag[first].view(np.int64)), *(c.take(rows) for c in batch.columns[1:]), *(pa.array(x.astype(np.int32)) for x in (start[first] + at, windows[first], count))],
                    ["key", "frag", *TEXT, "start", "windows", "run"],
                )

    return run


def _eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there, or two symbols, as one number, zeros beyond the end."""
    n, bits = len(data), 8 * data.itemsize
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    out = np.zeros(n, np.uint64)
    for k in range(64 // bits):
        out |= padded[k : k + n] << np.uint64(64 - bits * (k + 1))
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. Larsson-Sadakane: suffixes are grouped by their first bytes; each round
    sorts only within groups that are not yet single, by the groups of the suffixes that stand one depth further on,
    and two where three groups fit into one number, so that the depth doubles or triples."""
    n, wide = len(data), 8 // data.itemsize
    first = _eights(data)
    # A zero byte and the end look alike here, so the ends of the shorter suffixes are told apart by their length.
    order = np.argsort(first) if data.all() else np.lexsort((np.minimum(n - np.arange(n), wide), first))
    ordered, lengths = first[order], np.minimum(n - order, wide)
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (lengths[1:] != lengths[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth, times = wide, 3 if n + 1 < 1 << 21 else 2
    places = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(places):
        suffix = order[places]
        value = rank[suffix]
        for k in range(1, times):
            further = suffix + k * depth
            value = value * (n + 1) + np.where(further < n, rank[np.minimum(further, n - 1)], -1) + 1
        by = np.argsort(value, kind="stable")
        suffix, value = suffix[by], value[by]
        order[places] = suffix
        new = np.ones(len(places), bool)
        new[1:] = value[1:] != value[:-1]
        rank[suffix] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        places = places[~(new & np.append(new[1:], True))]
        depth *= times
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many bytes or symbols each suffix has in common with the one before it in order; what is over `most` is a lower bound.

    Kasai: going through the text, a suffix has at least one byte less in common with its predecessor than the
    suffix one place before it. The rest is counted only where the bytes before the two differ, since elsewhere
    it is exactly one less."""
    n, wide, bits = len(data), 8 // data.itemsize, 8 * data.itemsize
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    fresh = (before <= 0) | (place == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = data[rest - 1] != data[before[rest] - 1]
    a = np.flatnonzero(fresh & (before >= 0))
    b, count = before[a], np.zeros(len(a), np.int64)
    eights = np.append(_eights(data), np.uint64(0))
    active = np.arange(len(a))
    limit = n - np.maximum(a, b)
    while len(active):
        unlike = eights[np.minimum(a[active] + count[active], n)] ^ eights[np.minimum(b[active] + count[active], n)]
        same = np.zeros(len(active), np.int64)
        for k in range(wide):
            same += unlike < np.uint64(1 << bits * k)
        count[active] = np.minimum(count[active] + same, limit[active])
        active = active[(same == wide) & (count[active] < limit[active]) & (count[active] < most + n)]
    full = np.zeros(n, np.int64)
    full[a] = count
    source = np.maximum.accumulate(np.where(fresh, place, 0))
    kept = full[source] - (place - source)
    kept[before < 0] = 0
    return kept[order]


def may_repeat(group: list[tuple], length: int, kind=np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """Of each fragment (anchor's hash, windows, bytes): the first and the end of the windows outside of which none is like
    one of another fragment of its anchor.

    The windows of a fragment hold its anchor, so two that are alike begin at one distance from it. Distances are cut
    into CORES ranges; the windows of a range share a core, which two fragments with like windows there have both."""
    data = np.frombuffer(b"".join(g[2] for g in group), kind)
    sizes = np.array([len(g[2]) for g in group]) // data.itemsize
    keys, windows = np.array([g[0] for g in group], np.int64).view(np.uint64), np.array([g[1] for g in group])
    first = np.cumsum(sizes) - sizes
    gram, sums = _gram(data, length), _prefix_sums(data)
    # The anchor is the first place of its gram among those that all windows hold.
    spots = length - gram + 2 - windows
    owner = np.repeat(np.arange(len(group)), spots)
    spot = np.arange(len(owner)) - np.repeat(np.cumsum(spots) - spots - (first + windows - 1), spots)
    found = np.flatnonzero(_grams(sums, gram)[spot] == keys[owner])
    owners, at = np.unique(owner[found], return_index=True)
    if len(owners) < len(group):
        raise ValueError("a fragment without its anchor")
    anchor = spot[found[at]]
    low, high = np.full(len(group), length), np.full(len(group), -1)
    step = -(-(length - gram + 1) // CORES)
    for near in range(0, length - gram + 1, step):
        far = min(near + step - 1, length - gram)
        # Distances of a fragment's windows from its anchor: from `last` to `most`.
        most = anchor - first
        last = most - windows + 1
        held = np.flatnonzero((last <= far) & (most >= near))
        core = mix(_hashes(sums, anchor[held] - near, anchor[held] - far + length) ^ keys[held])
        _, back, times = np.unique(core, return_inverse=True, return_counts=True)
        shared = held[times[back] > 1]
        low[shared], high[shared] = np.minimum(low[shared], near), far
    lo, hi = np.maximum(0, most - high), np.minimum(windows, most - low + 1)
    return np.where(high < 0, 0, lo), np.where(high < 0, 0, hi)


def shard_repeats(group: list[tuple], length: int, kind=np.uint8) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each fragment (n, windows, bytes): which windows are repeated in the shard, and which stand for theirs."""
    data = np.frombuffer(b"".join(g[2] for g in group), kind)
    ends = np.cumsum([len(g[2]) // data.itemsize for g in group])
    owned = np.zeros(len(data), np.int64)
    at = 0
    for (n, windows, _), end in zip(group, ends.tolist(), strict=True):
        owned[at : at + windows] = n
        at = end
    order = suffix_array(data)
    run = np.cumsum(common_prefixes(data, order, length) < length) - 1
    weight = np.bincount(run, owned[order])
    repeated = np.zeros(len(data), bool)
    repeated[order] = weight[run] > 1
    stands = np.zeros(len(data), bool)
    mine = np.flatnonzero(owned[order] > 0)
    stands[order[mine[np.unique(run[mine], return_index=True)[1]]]] = True
    out, at = [], 0
    for (_, windows, _), end in zip(group, ends.tolist(), strict=True):
        out.append((repeated[at : at + windows], stands[at : at + windows]))
        at = end
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _sharded(length: int, kind):
    """Rows (key, frag, lo, hi): a run of repeated windows; and (key, bucket, packed): the windows of a shard that are
    to be looked up in the anchor's other shards, as (seen, frag, place) triples in order of their hash, `seen`."""
    names = ["key", "frag", "lo", "hi", "bucket", "packed"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def told(group: list[tuple]) -> pa.RecordBatch:
        runs: list[tuple] = []
        windows: dict[tuple[int, int], list[np.ndarray]] = {}
        size, left = np.dtype(kind).itemsize, []
        for (key, frag, n, parts, held, body), lo, hi in zip(group, *(x.tolist() for x in may_repeat([(g[0], *g[4:6]) for g in group], length, kind)), strict=True):
            if parts > 1:  # the other shards may hold a like window
                left.append((key, frag, n, parts, 0, held, body))
            elif lo < hi:
                left.append((key, frag, n, parts, lo, hi - lo, body[size * lo : size * (hi - 1 + length)]))
        marks = shard_repeats([(g[2], *g[5:7]) for g in left], length, kind) if left else []
        for (key, frag, _, parts, first, _, body), (repeated, stands) in zip(left, marks, strict=True):
            runs += [(key, frag, first + lo, first + hi, None, None) for lo, hi in zip(*(x.tolist() for x in _runs(repeated)), strict=True)]
            if parts > 1:
                at = np.flatnonzero(stands)
                seen = _hashes(_prefix_sums(np.frombuffer(body, kind)), at, at + length)
                windows.setdefault((key, parts), []).append(np.stack([seen.view(np.int64), np.full(len(at), frag), at], axis=1))
        for (key, parts), held in windows.items():
            table = np.concatenate(held)
            table = table[np.argsort(table[:, 0].view(np.uint64))]
            bucket = (table[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
            for number in np.unique(bucket).tolist():
                runs.append((key, None, None, None, number, table[bucket == number].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs, strict=True) if runs else [[]] * 6, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, last = [], 0, None
        for batch in batches:
            for key, part, frag, n, parts, windows, body in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "frag", "n", "parts", "windows", "body")), strict=True):
                if size >= SHARD_BYTES and (key, part) != last:
                    yield told(shard)
                    shard, size = [], 0
                last = (key, part)
                shard.append((key, frag, n, parts, windows, body))
                size += len(body)
        if shard:
            yield told(shard)

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, frag, lo, hi) of the windows of an anchor's bucket that stand in more than one of its shards: the shards'
    sorted hashes are merged, and each hash is looked up by binary search."""

    def told(key: int, held: list[bytes]) -> pa.RecordBatch:
        table = np.concatenate([np.frombuffer(h, np.int64).reshape(-1, 3) for h in held])
        seen = table[:, 0]
        merged = np.sort(seen, kind="stable")
        found = table[np.searchsorted(merged, seen, "right") - np.searchsorted(merged, seen, "left") > 1]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found[:, 1].copy()), pa.array(found[:, 2].astype(np.int32)), pa.array((found[:, 2] + 1).astype(np.int32))], ["key", "frag", "lo", "hi"])

    last, held = None, []
    for batch in batches:
        for key, bucket, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "bucket", "packed")), strict=True):
            if held and (key, bucket) != last:
                yield told(last[0], held)
                held = []
            last = (key, bucket)
            held.append(packed)
    if held:
        yield told(last[0], held)


def _cut_out(length: int, coded: bool):
    """(key, frag, n, parts, part, windows, body) of the fragments that a text is asked for."""
    names = ["key", "frag", "n", "parts", "part", "windows"]
    types = (*[pa.int64()] * 5, pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, asked = batch.schema.get_field_index("text"), batch.column(batch.schema.get_field_index("wanted")).to_pylist()
            for i, wanted in enumerate(asked):
                body = _bytes(batch.column(at).slice(i, 1), coded)[0]
                rows = [(*(w[c] for c in names), body[w["start"] : w["start"] + w["windows"] + length - 1].tobytes()) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*names, "body"])

    return run


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, repeated boolean"
TEXT = ["th", "tm", "tn"]


def _known(docs: DataFrame) -> DataFrame:
    """docs with the hashes and the length by which texts are known; a null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), F.hash(text).alias("tm"), F.octet_length(text).alias("tn"))


def _texts(known: DataFrame) -> DataFrame:
    """The distinct texts, each with the least doc_id of its rows, whose row tells it."""
    return stash(known.groupBy(*TEXT).agg(F.min("doc_id").alias("rep")), "texts")


def repeated_spans(known: DataFrame, texts: DataFrame, length: int = LENGTH, coded: bool = False) -> DataFrame:
    """(th, tm, tn, spans): for every distinct text that has some, its repeated byte spans, array<struct<lo,hi>>,
    neither ordered nor joined; with `coded` length and spans count words. texts: those of known."""
    # A word takes a byte at least, and a space stands between two.
    long = known.where(F.octet_length("text") >= (2 * length - 1 if coded else length))
    place = F.pmod(F.xxhash64(*TEXT, "start"), F.lit(PARTS)).cast("int")
    found = long.select("text", *TEXT).mapInArrow(_anchored(length, coded), "key long, frag long, th long, tm int, tn int, start int, windows int, run int").withColumn("place", place)
    found = found.where("key is not null and place is not null").repartition("key", "place").groupBy("key", "place", "frag", *TEXT, "start", "windows", "run").agg(F.sum("run").alias("n"))
    live = stash(beside_group(found, ["key"], "place", {"times": (F.sum("n"), F.sum("times"))}, "times > 1").drop("times"), "live")

    # One row for each fragment, with the parts that hold its places, and how many fragments its anchor has.
    at = F.min(F.struct(*TEXT, "start", "windows", "place")).alias("at")
    whole = live.groupBy("key", "frag").agg(F.sum("n").alias("n"), at, F.collect_set("place").alias("places")).withColumn("slot", F.pmod("frag", F.lit(PARTS)).cast("int"))
    whole = stash(beside_group(whole, ["key"], "slot", {"kinds": (F.count("*"), F.sum("kinds"))}, "kinds > 0"), "whole")

    parts = F.ceil(F.col("kinds") / SHARD_FRAGMENTS).cast("long")
    asked = whole.where("kinds > 1").select("key", "frag", "n", parts.alias("parts"), F.pmod(F.xxhash64("frag"), parts).alias("part"), "at.*")
    asked = asked.groupBy(*TEXT).agg(F.collect_list(F.struct("key", "frag", "n", "parts", "part", "start", "windows")).alias("wanted"))
    asked = stash(asked.join(texts, TEXT), "asked")
    row = lambda doc_id: F.xxhash64(*TEXT, doc_id)
    bits = bits_of(asked, row("rep"))
    near = may_have(long, row("doc_id"), bits).where("may")
    bodies = near.join(asked.withColumnsRenamed({c: f"_{c}" for c in TEXT}), [*(F.col(c) == F.col(f"_{c}") for c in TEXT), F.col("doc_id").eqNullSafe(F.col("rep"))]).select("text", "wanted")
    bodies = bodies.mapInArrow(_cut_out(length, coded), "key long, frag long, n long, parts long, part long, windows int, body binary").dropDuplicates(["key", "frag"])
    shards = bodies.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "frag", "n", "parts", "windows", "body")
    told = stash(shards.mapInArrow(_sharded(length, CODE if coded else np.uint8), "key long, frag long, lo int, hi int, bucket long, packed binary"), "told")
    unstash(asked), unstash(bits)
    looked = told.where("bucket is not null").select("key", "bucket", "packed").repartition("key", "bucket").sortWithinPartitions("key", "bucket").mapInArrow(_looked_up, "key long, frag long, lo int, hi int")

    # A window that stands for a run in its shard and is found in another: so is the whole run's content, but each
    # fragment of the run is already marked there, or the window is alone in its run.
    partial = told.where("bucket is null").select("key", "frag", "lo", "hi").union(looked)
    full = whole.where("n > 1").select("key", "frag", F.explode("places").alias("place"), F.lit(0).alias("lo"), F.col("at.windows").alias("hi"))
    marked = full.union(partial.join(whole.where("n = 1").select("key", "frag", F.col("at.place").alias("place")), ["key", "frag"]).select("key", "frag", "place", "lo", "hi"))
    # Every place is kept by the join, so that its rows follow the input, however much of that is repeated. What stands
    # several times in a row is repeated as a whole, over all of its row.
    span = F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + (F.col("run") - 1) * F.col("windows") + F.col("hi") - 1 + length).alias("hi"))
    spans = live.join(marked, ["key", "frag", "place"], "left").select(*TEXT, F.when(F.col("lo").isNotNull(), span).alias("span"))
    spans = stash(spans.groupBy(*TEXT).agg(F.collect_list("span").alias("spans")).where(F.size("spans") > 0), "spans")
    for table in (live, whole, told):
        unstash(table)
    return spans


def all_spans(known: DataFrame, length: int, words: int | None) -> DataFrame:
    """(th, tm, tn, spans, coded): the repeated byte spans of each distinct text, and with `words` those of its codes."""
    texts = _texts(known)
    spans, none = repeated_spans(known, texts, length), F.lit(None).cast("array<struct<lo:int,hi:int>>")
    if not words:
        unstash(texts)
        return spans.withColumn("coded", none)
    coded = repeated_spans(known, texts, words, coded=True)
    both = spans.withColumn("coded", none).unionByName(coded.select(*TEXT, none.alias("spans"), F.col("spans").alias("coded")))
    out = stash(both.groupBy(*TEXT).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("coded")).alias("coded")), "spans")
    unstash(spans), unstash(coded), unstash(texts)
    return out


def joined_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _of_words(text: str | None, coded: list[dict]) -> list[dict]:
    """Byte spans of a text, from those of its words."""
    body = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = word_spans(body, np.array([0, len(body)]))
    return [{"lo": int(starts[lo]), "hi": int(ends[hi - 1])} for lo, hi in joined_spans(coded)]


def _cut(text: str | None, spans: list[dict] | None) -> tuple[bytes, bytes, int]:
    body, found = (text or "").encode(), joined_spans(spans)
    edges = [0, *(x for span in found for x in span), len(body)]
    return body, b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(found)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, texts, spans, repeated = batch.columns
        data, offsets = text_bytes(texts)
        # All spans of the batch at once, by where they begin; each text's are joined where they meet.
        owner = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = spans.flatten()
        lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[owner] for c in ("lo", "hi"))
        by = np.lexsort((lo, owner))
        owner, lo, hi = owner[by], lo[by], np.maximum.accumulate(hi[by]) if len(by) else hi
        # A text's spans end within it, so the greatest end so far is of the same text or of one before.
        new = np.ones(len(by), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (lo[1:] > hi[:-1])
        first = np.flatnonzero(new)
        lo, hi, owner = lo[first], hi[np.append(first[1:], len(by)) - 1] if len(first) else hi, owner[first]
        count = np.bincount(owner, minlength=len(offsets) - 1)
        gone = np.zeros(len(data) + 1, np.int64)
        np.add.at(gone, lo, 1)
        np.add.at(gone, hi, -1)
        left = np.cumsum(gone[:-1]) == 0
        places = np.concatenate([[0], np.cumsum(left)])[offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[left]))]).cast(pa.binary())
        sizes = np.diff(offsets)
        yield pa.RecordBatch.from_arrays([doc_id, pa.array(sizes), pa.array(sizes - np.diff(places)), pa.array(count), kept, repeated], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "repeated"])


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        found = zip(*(batch.column(c).to_pylist() for c in (at, batch.num_columns - 2, batch.num_columns - 1)), strict=True)
        cuts = [_cut(text, [*(spans or ()), *(_of_words(text, coded) if coded else ())]) for text, spans, coded in found]
        texts = pa.array([kept.decode(errors="ignore") for _, kept, _ in cuts], pa.string())
        left = pa.array([bool(kept) or not body for body, kept, _ in cuts])
        own = [texts if i == at else batch.column(i) for i in range(batch.num_columns - 2)]
        yield pa.RecordBatch.from_arrays(own, batch.schema.names[:-2]).filter(left)


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, repeated) of every row of docs(doc_id, text, ...), kept binary.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else in the input. `repeated` says
    that some do, or with `words` that so many words following one another stand elsewhere too. A null text is
    empty; texts shorter than `length` stay whole; rows that repeat a text repeat all its windows; a text of any length
    is compared whole, in overlapping runs. A row's doc_id may be null or repeated. Other columns are ignored. No rows:
    no rows. Of grams with equal hashes the leftmost is the anchor, so ties don't depend on where a window stands."""
    known = _known(docs)
    spans = all_spans(known, length, words)
    marked = may_have(known, F.xxhash64(*TEXT), bits_of(spans, F.xxhash64(*TEXT)))
    repeated = (F.coalesce(F.size("spans"), F.lit(0)) > 0) | (F.coalesce(F.size("coded"), F.lit(0)) > 0)
    cut = marked.where("may").join(spans, TEXT, "left").select("doc_id", "text", "spans", repeated.alias("repeated")).mapInArrow(_kept, KEPT)
    zero = F.lit(0).cast("long")
    whole = marked.where("not may").select("doc_id", F.col("tn").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"), F.lit(False).alias("repeated"))
    return whole.union(cut)


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """docs with the repeated bytes, and with `words` the repeated passages of so many words or more, taken out of its
    texts, and n_chars, if there, counted anew. A character that loses some of its bytes goes; so does a document of
    which nothing is left. A row that repeats a doc_id gets the text that its own text leaves. Columns are those of docs.

    Words are what white space parts, known by 32 bits of their hash; the white space between them may differ. Null and
    empty texts stay as they are; a text of any length is compared whole. No rows: no rows."""
    known = _known(docs)
    spans = all_spans(known, length, words)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({"_th": F.xxhash64(text), "_tm": F.hash(text), "_tn": F.octet_length(text)})
    keys = [f"_{c}" for c in TEXT]
    marked = may_have(own, F.xxhash64(*keys), bits_of(spans, F.xxhash64(*TEXT)), "_may")
    joined = marked.where("_may").join(spans.withColumnsRenamed({c: f"_{c}" for c in [*TEXT, "spans", "coded"]}), keys, "left")
    cut = joined.select(*docs.columns, "_spans", "_coded").mapInArrow(_shortened, docs.schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return marked.where("not _may").select(docs.columns).unionByName(cut.select(docs.columns))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and `repeated`: a passage of 400 bytes or of 51 words stands elsewhere too."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), LENGTH, WORDS)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "repeated")
