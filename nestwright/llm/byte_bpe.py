"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece exactly one token can end its encoding: of the tokens that the prefix ends
with, the one that merging in rank order never splits from, or joins to, the token that ends the rest.
Storing that token for each prefix gives the encoding by walking back from the end, the encoding of any
prefix for nothing, exact appends, and re-encoding near an edit only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.llm.common import slices

#: Entries of a generation of remembered pieces, of which a worker holds two, and of pairs of tokens before it starts anew.
PIECES, PAIRS = 150_000, 200_000
#: Bytes of text whose ids are held at once where they are returned.
CHECKED_BYTES = 1 << 18


class Vocabulary:
    """Ranks of byte strings; a lower rank merges first. Single bytes must all be there."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.reached: dict[bytes, int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged(token)
                if len(parts) != 2:  # merging never makes it; only a piece that is it gets it
                    continue
                self.halves[i] = parts
            self.reached[token] = i
        self.lengths = {i: len(t) for t, i in self.reached.items()}
        self.reach = max(self.lengths.values())
        self.ends = ahocorasick.Automaton()
        for token, i in self.reached.items():
            self.ends.add_word(token.decode("latin-1"), i)
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}

    def _merged(self, token: bytes) -> tuple[int, ...]:
        """The tokens left before the last merge that makes `token`, by plain merging."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def adjoin(self, left: int, right: int) -> bool:
        """Whether left and right can stand side by side in an encoding.

        They can unless some merge across the border comes before the merges that made the two tokens there:
        undo the younger of the two border merges again and again, and look whether the border tokens would
        have merged with each other by then."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self._adjoin(left, right)
        return known

    def _adjoin(self, left: int, right: int) -> bool:
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        # A merge across the border of rank `before` or more comes too late. A tie goes to the merge further left.
        before = 1 << 60
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < before:
                return False
            on_left, on_right = left in halves, right in halves
            if not on_left and not on_right:
                return True
            if on_left and (not on_right or left > right):
                before, left = left, halves[left][1]
            else:
                before, right = right + 1, halves[right][0]

    def last_tokens(self, data: bytes, known: list[int] | None = None) -> list[int]:
        """For each prefix of data the token that ends its encoding; `known` holds those of the first prefixes.

        An automaton over the tokens lists, prefix by prefix, the tokens that it ends with, longest first."""
        last = known if known is not None else []
        done = len(last)
        begin = max(0, done + 1 - self.reach)
        pairs, adjoin, lengths = self.pairs, self.adjoin, self.lengths
        for end, token in self.ends.iter(data[begin:].decode("latin-1")):
            if (end := end + begin) < done:
                continue
            start = end + 1 - lengths[token]
            if start:
                fits = pairs.get(last[start - 1] << 32 | token)
                if fits is None:
                    fits = adjoin(last[start - 1], token)
                if not fits:
                    continue
            last.append(token)
            done += 1
        if len(last) < len(data):
            raise ValueError("no token ends some prefix; the ranks aren't those of byte-level BPE")
        return last

    def walk(self, last: list[int], end: int | None = None) -> tuple[int, ...]:
        """The encoding of the prefix of length `end`."""
        end, out = len(last) if end is None else end, []
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return tuple(out[::-1])

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self.walk(self.last_tokens(piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """One byte string with the last token of each of its prefixes, kept through appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        self.last = vocabulary.last_tokens(data)
        self.reach = vocabulary.reach

    def ids(self, end: int | None = None) -> tuple[int, ...]:
        return self.vocabulary.walk(self.last, end)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.last_tokens(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts `new` in place of data[start:end]; returns how many prefixes were looked at again.

        What ends a prefix depends on at most `reach` prefixes before it, so once so many come out as they
        were, the rest stays."""
        tail, old = self.data[end:], self.last[end:]
        data, last = self.data[:start] + new, self.last[:start]
        self.vocabulary.last_tokens(data, last)
        same, at, looked = 0, 0, len(new)
        while at < len(tail) and same < self.reach:
            step = min(len(tail), at + 16)
            self.vocabulary.last_tokens(data + tail[:step], last)
            for k in range(at, step):
                same = same + 1 if last[len(data) + k] == old[k] else 0
            looked, at = looked + step - at, step
        self.data, self.last = data + tail, last + old[at:]
        return looked


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a space and the rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


class _Pieces(dict):
    """Ids by piece, made when first asked for. When a generation is full the one before it is forgotten, so that what
    is asked for again and again stays."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.vocabulary.encode_piece(piece.encode())
        if len(piece) < 64:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids: each match of the pattern by itself, remembered while it lasts."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary, self.find = vocabulary(path), regex.compile(pattern).findall
        self.known = _Pieces(self.vocabulary)
        # In an ASCII text the letters, digits and white space are these, and the plain matcher is faster.
        for name, plain in ((r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", r"[\t-\r ]"), (r"\S", r"[^\t-\r ]")):
            pattern = pattern.replace(name, plain)
        self.find_ascii = self.find if "\\p" in pattern or "\\s" in pattern else re.compile(pattern).findall

    def pieces(self, text: str | None) -> list[str]:
        text = text or ""
        return (self.find_ascii if text.isascii() else self.find)(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text))))

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.known.__getitem__, self.pieces(text))))


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with a column of token ids more (array<int>); a null or empty text has none. `path` must be readable
    on every executor, as an installed vocabulary is. A column called as `ids` is replaced; the others stay."""
    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(kept).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path, pattern)
        for batch in slices(batches, text):
            found = pa.array([own.encode(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*kept, ids])

    return docs.select(kept).mapInArrow(run, schema)


@cache
def _tokens(path: str) -> dict[int, bytes]:
    """All that decoding needs, without what encoding does."""
    return {i: t for t, i in read_ranks(path).items()}


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids more (binary; null ids: empty); unknown ids raise a KeyError."""
    kept = [c for c in encoded.columns if c != text]
    schema = encoded.select(kept).schema.add(text, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            found = pa.array([b"".join(map(tokens.__getitem__, x or ())) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*kept, text])

    return encoded.select(kept).mapInArrow(run, schema)


def encode_checked(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with token_ids, n_tokens and decodes more: the ids, their number, and whether decoding them gives the text
    back. One worker does both, so that the vocabulary is there once. A null or empty text has no ids and decodes to
    nothing; a text of any length is encoded whole. Columns called like the new ones are replaced. No rows: no rows."""
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "decodes")]
    schema = docs.select(kept).schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.IntegerType()).add("decodes", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path, pattern)
        for batch in slices(batches, text, CHECKED_BYTES):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = [own.encode(t) for t in texts]
            same = [own.vocabulary.decode(x) == (t or "").encode() for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int32()), pa.array(same, pa.bool_())], schema.names)

    return docs.select(kept).mapInArrow(run, schema)


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens in place of the text; a null or empty text has none."""
    kept = [c for c in docs.columns if c not in (text, out)]
    schema = docs.select(kept).schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path, pattern)
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            n = pa.array(map(own.count, batch.column(at).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), n], schema.names)

    return docs.select(*kept, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: the encoding, and the decoding of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path, pattern)
        names = {i: str(i) for i in own.vocabulary.tokens}
        for batch in slices(batches):
            n, ids_of, text_of = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                n.append(len(ids))
                ids_of.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_of.append(hashlib.sha256(own.vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_of), pa.array(text_of)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
