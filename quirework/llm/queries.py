"""The queries that the driver runs, one per operator, and their SQL."""

from __future__ import annotations

from quirework.llm import quality_rules
from quirework.llm.decontaminate import op2_decontaminate
from quirework.llm.exact_substrings import op4_exact_substrings
from quirework.llm.langid import op9_langid
from quirework.llm.license_scan import op3_license_scan
from quirework.llm.packing import op5_best_fit_packing
from quirework.llm.pii import op7_personal_data
from quirework.llm.quality_knn import op8_quality_knn
from quirework.llm.simhash import op6_simhash_dedup
from quirework.llm.token_counts import op10_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        quality_rules.op1_quality_rules,
        op2_decontaminate,
        op3_license_scan,
        op4_exact_substrings,
        op5_best_fit_packing,
        op6_simhash_dedup,
        op7_personal_data,
        op8_quality_knn,
        op9_langid,
        op10_token_counts,
    )
}
ORACLES = {"op1_quality_rules": quality_rules.oracle()}
