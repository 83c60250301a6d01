"""The training-data queries by name, and SQL for those that SQL can express."""

from nestwright.llm import licenses, token_counts
from nestwright.llm.byte_bpe import op9_byte_bpe
from nestwright.llm.decontamination import op4_decontamination
from nestwright.llm.fingerprints import op7_fingerprints
from nestwright.llm.language_id import op6_language_id
from nestwright.llm.ngram_jaccard import op2_ngram_jaccard
from nestwright.llm.quality import op8_quality
from nestwright.llm.suffix_dedup import op1_suffix_dedup
from nestwright.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_licenses": licenses.op3_licenses,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_counts": token_counts.op10_token_counts,
}

#: The counts of op10 are an encoder's, which SQL has none of.
ORACLE_SQL: dict[str, str] = {"op3_licenses": licenses.oracle()}
