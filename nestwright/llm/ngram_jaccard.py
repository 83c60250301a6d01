"""Near-duplicate documents: all links of word-shingle Jaccard at or above a bound, and their components.

Exact similarity join in two rounds.

1. Every document's shingles are hashed to 64 bits; equal sets become one node. A set's *prefix*
   (its first n - ceil(t n) + 1 shingles in one total order) is posted; two sets with similarity t
   share a posted shingle. Shingles found to be frequent come last in the order, so that common
   lines and passages are seldom posted. In each posted group every set is tried against one set of
   the group only, a star, and links found are joined to components.
2. Groups whose sets still lie in different components become tiles: a small group is one; a larger one is cut
   into bands of set size, of which only a band and the next can hold links, and these into tiles of bounded
   size. Two sets are compared at the first posted shingle that they share, which is where the shingles before it
   differ, and where enough members follow it for a link. Hashed bitmap signatures of the sets, as wide as the
   set size asks, bound each pair's overlap from above by bit counts; pairs that pass are intersected exactly.

Links inside a component that is already joined are not needed for the answer and are never listed, so
a group of N copies costs N tries, not N*N. What is kept by a shingle or a star's middle, of which one may hold
much of the corpus, is dealt to PARTS parts by the other end too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestwright.llm.common import beside_group, bits_of, may_have, mix, slices, stash, text_bytes, unstash, word_hashes, word_spans
from nestwright.llm.components import components

#: A shingle held to be frequent, counted within runs of COUNT_RUN shingles where it stands in two sets or more.
FREQUENT, FREQUENT_MOST, COUNT_RUN = 4, 1 << 19, 1 << 22
#: Sets in a tile of the second round.
TILE = 2048
#: Parts into which the group of a frequent shingle, and the pairs of one set, are dealt.
PARTS = 32
PERCENT = 75
#: A random odd factor for each place of a word in a shingle.
_PLACES = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; fewer words than `width` are one shingle; none: empty."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * _PLACES[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.sum(words[a:b] * _PLACES[: b - a], keepdims=True) ^ np.uint64(b - a)))
        else:
            out.append(rolled[:0])
    return out


def node_of(tokens: np.ndarray) -> int:
    """A set's name: a 64-bit hash of its members."""
    return int(mix(np.sum(mix(tokens ^ np.uint64(0xA0761D6478BD642F)), keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, names = [], 0, set()

    def told() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        more = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[more].view(np.int64)), pa.array(counts[more])], ["token", "n"])

    for batch in slices(batches):
        for tokens in shingle_sets(batch):
            if len(tokens) and (name := node_of(tokens)) not in names:
                names.add(name)
                held.append(tokens)
                size += len(tokens)
        if size >= COUNT_RUN:
            yield told()
            held, size, names = [], 0, set()
    if held:
        yield told()


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """At most FREQUENT_MOST frequent shingles, rarest first. They only set the order of shingles, which
    changes the work and never the result; the bound keeps what is broadcast at 4 MB."""
    counted = docs.select("text").mapInArrow(_repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).select("token").toArrow()
    return top["token"].to_numpy()[::-1].copy()


def signature(tokens: np.ndarray) -> bytes:
    """A bitmap of at least twice as many bits as the set has members, 64 at least, a power of two."""
    bits = 64
    while bits < 2 * len(tokens):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _described(frequent: np.ndarray, percent: int):
    """Rows (doc_id, n, node, prefix, frequent members of prefix, sig)."""
    by_value = np.argsort(frequent.view(np.uint64))
    values = frequent.view(np.uint64)[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, nodes, prefixes, commons, signs = [], [], [], [], []
            for tokens in shingle_sets(batch):
                n = len(tokens)
                sizes.append(n)
                if not n:
                    nodes.append(None), prefixes.append(None), commons.append(None), signs.append(None)
                    continue
                length = n - (percent * n + 99) // 100 + 1
                at = np.minimum(np.searchsorted(values, tokens), max(0, len(values) - 1))
                often = values[at] == tokens if len(values) else np.zeros(n, bool)
                late = tokens[often][np.argsort(by_value[at[often]])]
                prefix, common = tokens[~often][:length], late[: max(0, length - (n - len(late)))]
                nodes.append(node_of(tokens)), prefixes.append(prefix.view(np.int64)), commons.append(common.view(np.int64)), signs.append(signature(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(commons, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                ["doc_id", "n", "node", "prefix", "common", "sig"],
            )

    return run


def _wide(sig: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(sig, np.uint64)
    while len(words) * 64 > bits:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


def enough(overlap, a, b, percent: int):
    """Whether an overlap of sets of a and b members is a link."""
    return 100 * overlap >= percent * (a + b - overlap)


def _likely(percent: int):
    """Whether the bit counts of two sets' signatures leave a link possible."""

    def fits(na: int, a: bytes, nb: int, b: bytes) -> bool:
        bits = 8 * min(len(a), len(b))
        x, y = _wide(a, bits), _wide(b, bits)
        both, ones, others = (int(np.bitwise_count(w).sum()) for w in (x & y, x, y))
        return enough(min(na - ones + both, nb - others + both), na, nb, percent)

    return fits


def _linked(percent: int):
    """Whether two sets, each as packed ascending members, are linked, by exact intersection."""

    def fits(na: int, a: bytes, nb: int, b: bytes) -> bool:
        return enough(len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)), na, nb, percent)

    return fits


def _beside(pairs: DataFrame, held: DataFrame, fits) -> DataFrame:
    """The pairs (u, v) whose rows of held(node, n, body) fit. The pairs of one u are dealt to PARTS parts; the body of u
    is sent once to each part that has some, not with every pair."""
    dealt = pairs.select("u", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int").alias("part"), "v")
    first = dealt.select("u", "part").distinct().join(held, F.col("u") == F.col("node")).select("u", "part", F.lit(None).cast("long").alias("v"), "n", "body")
    others = dealt.join(held, F.col("v") == F.col("node")).select("u", "part", "v", "n", "body")
    rows = first.union(others).repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (0, b"")
        for batch in batches:
            us, vs = [], []
            for u, v, n, body in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "n", "body")), strict=True):
                if v is None:
                    own = (n, body)
                elif fits(*own, n, body):
                    us.append(u), vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


TILED = ["token", "unit", "i", "j", "node", "n", "pos", "comp", "before", "low", "sig"]


def _tiles(percent: int):
    """Within each (token, unit, i, j) tile, pairs of different components that are first met here and whose bit counts
    allow a link."""

    def pairs(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        node, n, pos, comp, before, low = (np.array([r[k] for r in group], np.int64) for k in range(6))
        order = np.argsort(n, kind="stable")
        node, n, pos, comp, before, low = node[order], n[order], pos[order], comp[order], before[order], low[order] > 0
        sigs = [group[i][6] for i in order]
        left, right = [], []
        ends = np.searchsorted(n, 100 * n // percent, "right")  # sets up to here aren't too large for each
        for start in range(0, len(n), 256):
            x = np.arange(start, min(start + 256, len(n)))
            y = np.arange(start, ends[x[-1]])
            need = -(-percent * (n[x][:, None] + n[y][None, :]) // (100 + percent))
            met = (y[None, :] > x[:, None]) & low[x][:, None] & (comp[x][:, None] != comp[y][None, :]) & (before[x][:, None] != before[y][None, :])
            i, j = np.nonzero(met & (pos[x][:, None] <= n[x][:, None] - need) & (pos[y][None, :] <= n[y][None, :] - need))
            i, j = x[i], y[j]
            bits = np.array([len(sigs[k]) for k in x])
            for width in np.unique(bits).tolist():  # the smaller set's signature is the narrower one
                own = np.flatnonzero(bits[i - start] == width)
                if not len(own):
                    continue
                rows = {k: at for at, k in enumerate(np.unique(np.concatenate([i[own], j[own]])).tolist())}
                table = np.stack([_wide(sigs[k], 8 * width) for k in rows])
                count = np.bitwise_count(table).sum(1, dtype=np.int64)
                where = np.zeros(len(n), np.int64)
                where[list(rows)] = np.arange(len(rows))
                step = max(1, (1 << 20) // table.shape[1])
                for at in range(0, len(own), step):
                    a, b = i[own[at : at + step]], j[own[at : at + step]]
                    both = np.bitwise_count(table[where[a]] & table[where[b]]).sum(1, dtype=np.int64)
                    fits = enough(np.minimum(n[a] - count[where[a]], n[b] - count[where[b]]) + both, n[a], n[b], percent)
                    left.append(node[a[fits]]), right.append(node[b[fits]])
        u, v = (np.concatenate(left), np.concatenate(right)) if left else (node[:0], node[:0])
        return np.minimum(u, v), np.maximum(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            for token, unit, i, j, *row in zip(*(batch.column(c).to_pylist() for c in TILED), strict=True):
                if (token, unit, i, j) != key:
                    if len(group) > 1:
                        u, v = pairs(group)
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    key, group = (token, unit, i, j), []
                group.append(row)
        if len(group) > 1:
            u, v = pairs(group)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, tokens) of each document; tokens are packed, ascending."""
    for batch in slices(batches):
        sets = [t for t in shingle_sets(batch) if len(t)]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(t) for t in sets], pa.int64()), pa.array([t.tobytes() for t in sets], pa.binary())], ["node", "tokens"])


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes that are links, by exact intersection of the sets of one document of each."""
    needed = stash(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "n", "rep"), "node"), "needed")
    bits = bits_of(needed, F.col("rep"))
    found = may_have(docs.where("text is not null"), F.col("doc_id"), bits).where("may").select("text").mapInArrow(_members, "node long, tokens binary")
    held = stash(found.join(needed.select("node", "n"), "node").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("body")), "sets")
    links = stash(_beside(pairs, held, _linked(percent)), "links")
    unstash(needed), unstash(bits), unstash(held)
    return links


def _tiled(known: DataFrame, percent: int) -> DataFrame:
    """Rows of TILED but sig, from known(token, part, node, n, pos, comp, before): the groups that may hold new links.

    A set of n members at place pos of which `most` is the largest partner can only meet sets up to that size. Groups
    of more than TILE sets are cut into bands of size: unit k holds band k (low) and k + 1, and a pair is compared
    where its smaller set is low."""
    most = F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n")
    rows = known.withColumn("most", most)
    sums = {"size": (F.count("*"), F.sum("size")), "least": (F.min("n"), F.min("least")), "reach": (F.max("most"), F.max("reach"))}
    sums |= {f"{c}{k}": (f(c), f(f"{c}{k}")) for c in ("comp", "before") for k, f in enumerate((F.min, F.max))}
    dealt = beside_group(rows, ["token"], "part", sums, "comp0 != comp1 and before0 != before1").where("most >= least and n <= reach")
    zero = F.lit(0)
    small = dealt.where(F.col("size") <= TILE).select("token", F.lit(-2).alias("unit"), zero.alias("i"), zero.alias("j"), "node", "n", "pos", "comp", "before", F.lit(1).alias("low"))

    # A link's sizes differ by a factor of 100 / percent at most, so by one band at most; the width is a little more.
    band = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-6) + 1e-6)).cast("int")
    cut = stash(dealt.where(F.col("size") > TILE).withColumn("band", band).withColumn("unit", F.explode(F.array("band", F.col("band") - 1))).withColumn("low", (F.col("unit") == F.col("band")).cast("int")).select("token", "unit", "part", "node", "n", "pos", "comp", "before", "low"), "bands")
    large = beside_group(cut, ["token", "unit"], "part", {"size": (F.count("*"), F.sum("size")), "any": (F.max("low"), F.max("any"))}, "any > 0").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    large = large.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("with", F.explode(F.sequence(zero, F.col("tiles") - 1)))
    large = large.select("token", "unit", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "node", "n", "pos", "comp", "before", "low")
    return small.union(large)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text, ...).

    component_id is the least doc_id that links reach, the document's own included. A null or empty text,
    or one of white space only, has no shingles and no links. Rows that share a doc_id are documents of
    their own; a row without one can join others, and its component_id is theirs, or null. Other columns
    are ignored. No rows: no rows. A text of any length is read whole; one longer than a slice is worked on alone.
    Sets are told apart by a 64-bit hash of their members, so ties between equal sets don't arise."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stash(docs.mapInArrow(_described(frequent_shingles(docs), percent), "doc_id long, n int, node long, prefix array<long>, common array<long>, sig binary"), "shingles")
    sets = described.where("node is not null")
    nodes = stash(sets.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    signs = nodes.select("node", "n", F.col("sig").alias("body"))

    # Round 1. A frequent shingle's group is dealt to PARTS parts by token and node, so that no task holds it whole.
    # Part 0 is of rare shingles only: a set alone in another part may still have others of its group in the rest.
    rare = sets.select("node", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("part", F.lit(0))
    often = sets.select("node", "n", F.size("prefix").alias("before"), F.posexplode("common").alias("at", "token")).select("node", "n", (F.col("before") + F.col("at")).alias("pos"), "token")
    posted = rare.union(often.withColumn("part", (F.pmod(F.xxhash64("token", "node"), F.lit(PARTS)) + 1).cast("int"))).repartition("token", "part")
    # The hub of a group is the set with the fewest rarer shingles before this one, as an original has among its copies.
    stars = posted.groupBy("token", "part").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("place"), "node", "n", "pos")).alias("hub"), F.min("node").alias("first"), F.max("node").alias("last"))
    shared = stars.where((F.col("first") != F.col("last")) | (F.col("part") > 0)).select("token", "part", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"))
    live = stash(posted.join(shared, ["token", "part"]).select("token", "part", "node", "n", "pos", "hub", "hub_n", "hub_pos").distinct(), "live")
    # Two sets with enough in common have it in the members from their first common one on.
    need = F.ceil(percent * (F.col("n") + F.col("hub_n")) / (100 + percent))
    star = live.where((F.col("node") != F.col("hub")) & (F.col("pos") <= F.col("n") - need) & (F.col("hub_pos") <= F.col("hub_n") - need)).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    likely = stash(_beside(star, signs, _likely(percent)), "likely")
    links = _links(docs, nodes, likely, percent)
    joined = stash(components(links), "joined")
    unstash(likely)

    # Round 2. Groups that still hold several components, in tiles. `before` is the shared shingle that a set has before
    # this one: sets that agree in it meet there already, or further ahead. A set without one has its own name there.
    ahead = F.lag("token").over(Window.partitionBy("node").orderBy("pos"))
    known = live.select("token", "part", "node", "n", "pos").join(joined, "node", "left")
    known = stash(known.select("token", "part", "node", "n", "pos", F.coalesce("comp", "node").alias("comp"), F.coalesce(ahead, "node").alias("before")), "known")
    unstash(live), unstash(joined)
    tiled = _tiled(known, percent).join(nodes.select("node", "sig"), "node").select(*TILED)
    tiled = tiled.repartition("token", "unit", "i", "j").sortWithinPartitions("token", "unit", "i", "j")
    rest = stash(tiled.mapInArrow(_tiles(percent), "u long, v long").distinct(), "rest")
    unstash(known)
    more = _links(docs, nodes, rest, percent)
    joined = stash(components(links.union(more)), "joined")

    least = stash(nodes.select("node", "rep").join(joined, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp")), "members")
    for table in (rest, links, more, joined, nodes):
        unstash(table)
    names = beside_group(least.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS))), ["comp"], "part", {"component_id": (F.min("rep"), F.min("component_id"))}, "comp is not null").select("node", "component_id")
    out = described.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node").join(names, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents whose doc_id is their component's least; of rows that repeat a doc_id, all with it stay.
    Rows without a doc_id stay. Columns are those of docs."""
    least = F.coalesce(F.bool_or(F.col("doc_id") == F.col("component_id")), F.lit(True))
    gone = stash(near_duplicates(docs, percent).groupBy("doc_id").agg(least.alias("stays")).where("not stays").select(F.col("doc_id").alias("_gone")), "gone")
    own = F.col("doc_id").cast("long")
    marked = may_have(docs, own, bits_of(gone, F.col("_gone")), "_may")
    # Only documents that may go are shuffled.
    return marked.where("not _may").select(docs.columns).unionByName(marked.where("_may").join(gone, own == F.col("_gone"), "left_anti").select(docs.columns))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
