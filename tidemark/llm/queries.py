"""The registered queries of the training-data operators."""

from __future__ import annotations

from tidemark.llm.bpe import op2_byte_bpe
from tidemark.llm.chat import OP3_SQL, op3_chat_preferences
from tidemark.llm.collocations import op12_phrase_collocations
from tidemark.llm.decontaminate import op8_benchmark_decontamination
from tidemark.llm.jaccard import op1_ngram_jaccard_join
from tidemark.llm.language import op6_language_id
from tidemark.llm.licenses import op10_license_scan
from tidemark.llm.lines import op13_line_dedup
from tidemark.llm.quality import op7_quality_classifier
from tidemark.llm.resample import op11_importance_resampling
from tidemark.llm.secrets import op9_secret_scan
from tidemark.llm.statements import OP1_SQL, OP5_SQL, OP8_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from tidemark.llm.substrings import op5_substring_dedup
from tidemark.llm.winnow import op4_document_fingerprints

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_byte_bpe,
        op3_chat_preferences,
        op4_document_fingerprints,
        op5_substring_dedup,
        op6_language_id,
        op7_quality_classifier,
        op8_benchmark_decontamination,
        op9_secret_scan,
        op10_license_scan,
        op11_importance_resampling,
        op12_phrase_collocations,
        op13_line_dedup,
    )
}

#: What SQL can express at a bearable cost; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op3_chat_preferences": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
