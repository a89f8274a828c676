"""Registry of this subpackage: name -> query, and the SQL that DuckDB can state for it."""

from __future__ import annotations

from . import norm_topk, oracle
from .align import op11_tokenizer_alignment
from .brown_lm import op7_brown_lm
from .decontaminate import op3_decontamination
from .html_extract import op4_html_extraction
from .jaccard_join import op5_jaccard_join
from .norm_topk import op13_exact_topk
from .packing import op8_packing
from .quality_mil import op2_quality_classifier
from .quality_rules import op10_quality_rules
from .secret_scan import op1_secret_scan
from .spelling import op12_spelling_variants
from .token_counts import op6_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_brown_lm": op7_brown_lm,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_topk": op13_exact_topk,
}

#: The others tokenise, cluster, train or hash; the tests hold them against brute force, held-out labels or exact round trips.
ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": oracle.secrets_sql(),
    "op3_decontamination": oracle.decontamination_sql(),
    "op10_quality_rules": oracle.quality_sql(),
    "op13_exact_topk": norm_topk.oracle_sql(),
}
