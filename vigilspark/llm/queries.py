"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .conversations import op11_conversation_repair
from .exact_dedup import op12_exact_dedup
from .fingerprints import op2_fingerprints
from .html_text import op1_html_text
from .importance import op13_importance_resampling
from .licenses import ORACLE_SQL as LICENSE_SQL
from .licenses import op10_license_scan
from .mixing import op5_source_mixing
from .ngram_jaccard import op6_ngram_jaccard
from .oracles import EXACT_DEDUP, JACCARD, QUALITY, SUFFIX_DEDUP, WARC
from .quality import op9_quality_rules
from .suffix_dedup import op3_suffix_dedup
from .token_counts import op8_token_counts
from .warc import op4_warc_zstd

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_fingerprints": op2_fingerprints,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc_zstd": op4_warc_zstd,
    "op5_source_mixing": op5_source_mixing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op3_suffix_dedup": SUFFIX_DEDUP,
    "op4_warc_zstd": WARC,
    "op6_ngram_jaccard": JACCARD,
    "op9_quality_rules": QUALITY,
    "op10_license_scan": LICENSE_SQL,
    "op12_exact_dedup": EXACT_DEDUP,
}
