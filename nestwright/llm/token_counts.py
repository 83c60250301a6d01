"""Token counts by source, language and tokenizer version, kept by signed deltas.

The ledger is a folder with one small table of signed sums for each batch. A batch has a name and is committed once:
doing so again, after a failure or by mistake, changes nothing. Totals are the sums of the committed batches, so
inserts, deletes and revised counts cost what they touch, never a new count of the corpus.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwright.llm import byte_bpe
from nestwright.llm.common import beside_group, shared_folder, stash, unstash

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
#: Runs of other than ASCII white space.
WORD = r"[^ \t\n\x0B\f\r]+"


#: The versions that the query counts: a tokenizer by its rank file, and words between ASCII white space.
BPE, WORDS = "byte_bpe_50k", "words-1"
#: Parts into which the rows of one text are dealt.
PARTS = 64


def words_1(text: Column) -> Column:
    """Tokenizer `words-1`: runs of other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def estimate(n_chars: Column) -> Column:
    """A token for every four characters begun: what a document counts until its tokens are."""
    return F.ceil(n_chars / 4).cast("long")


def deltas(counted: DataFrame, tokenizer: str, tokens: Column, sign: int = 1, docs: int = 1, chars: Column | None = None) -> DataFrame:
    """Rows for Ledger.commit: each row of counted(source, lang, n_chars, ...) adds `docs`, `tokens` and its characters,
    taken `sign` times. A revised count is docs=0 and the difference of the tokens, with chars 0."""
    chars = F.col("n_chars") if chars is None else chars
    return counted.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign * docs).cast("long").alias("n_docs"), (sign * tokens).cast("long").alias("n_tokens"), (sign * F.coalesce(chars, F.lit(0))).cast("long").alias("n_chars"))


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def committed(self) -> list[str]:
        """The names of the batches that are there; a batch comes by a rename, as a whole."""
        files, top = self._file(self.path)
        if not files.exists(top):
            return []
        return sorted(s.getPath().getName()[6:] for s in files.listStatus(top) if s.getPath().getName().startswith("batch-"))

    def _there(self, batch: str) -> bool:
        files, path = self._file(f"{self.path}/batch-{batch}")
        return files.exists(path)

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Commits the sums of the changes under this name; False, and nothing changed, if the name is taken, also by
        another writer meanwhile. The sums are written beside the ledger and then renamed, which a file system does
        once or not at all; what a failed commit leaves is never read. A name is letters, digits, `_`, `-` and `.`."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a name for a batch: {batch!r}")
        if self._there(batch):
            return False
        rows = reduce(DataFrame.unionByName, (c.select(*KEYS, *SUMS) for c in changes))
        own = f"{self.path}/new-{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).write.parquet(own)
        files, path = self._file(own)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        try:
            context.rename(path, jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-{batch}"), options)
        except Py4JJavaError as error:
            if not self._there(batch):
                raise error
            files.delete(path, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars) over the committed batches; null sources and languages
        have groups of their own; groups that add up to nothing are left out."""
        batches = self.committed()
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/batch-{b}" for b in batches)) if batches else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.where(" or ".join(f"{c} != 0" for c in SUMS))


def maintained(docs: DataFrame, path: str, ranks: str, pattern: str, tokenizer: str = BPE) -> DataFrame:
    """The rollup of docs(doc_id, text, lang, source, ...) after four commits: every document, its words counted and its
    tokens estimated; the counted tokens in their place; that batch again, which changes nothing; and the removal of
    exact copies. The tokens are those of byte_bpe with the rank file and pattern.

    Of rows with equal texts those with the least doc_id stay, all of them if they tie, and rows without an id too; null
    texts are no copies and have no tokens. n_chars is counted from the text, which is read whole however long. Other
    columns are ignored. No rows: no rows."""
    text = F.col("text").cast("string")
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), words_1(text).alias("words"), F.xxhash64(text).alias("th"), F.hash(text).alias("tm"), F.octet_length(text).alias("tn"), text.alias("text"))
    facts = stash(byte_bpe.token_counts(facts, ranks, pattern, out="tokens"), "facts")
    ledger = Ledger(docs.sparkSession, path)
    words, tokens, guess = F.col("words"), F.col("tokens"), estimate(F.col("n_chars"))
    ledger.commit("insert", deltas(facts, WORDS, words), deltas(facts, tokenizer, guess))
    for _ in range(2):
        ledger.commit("revise", deltas(facts, tokenizer, tokens - guess, docs=0, chars=F.lit(0)))
    # One text may have much of the rows: these are dealt to parts.
    own = facts.where("tn is not null").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    sums = {"least": (F.min("doc_id"), F.min("least")), "times": (F.count("*"), F.sum("times"))}
    copies = beside_group(own, ["th", "tm", "tn"], "part", sums, "times > 1").where("doc_id > least")
    ledger.commit("delete", deltas(copies, WORDS, words, sign=-1), deltas(copies, tokenizer, tokens, sign=-1))
    unstash(facts)
    return ledger.totals()


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """The tokens of the 50k byte-level BPE vocabulary and the words of all documents but exact copies."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return maintained(docs, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
