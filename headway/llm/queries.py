"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from headway.llm.decontaminate import OP9_SQL, op9_decontamination
from headway.llm.embedding_dedup import OP5_SQL, op5_embedding_near_dedup
from headway.llm.html_extract import op6_html_extraction
from headway.llm.jaccard_join import OP4_SQL, op4_ngram_jaccard_join
from headway.llm.lang_id import op8_language_id
from headway.llm.license_scan import op10_license_scan
from headway.llm.line_dedup import op2_line_dedup
from headway.llm.mixing import OP7_SQL, op7_mixing
from headway.llm.periodic_runs import op12_periodic_runs
from headway.llm.pii import op1_pii
from headway.llm.spelling import op13_spelling_variants
from headway.llm.suffix_dedup import op3_suffix_array_dedup
from headway.llm.toxicity import op11_toxicity

QUERIES = {
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op1_pii": op1_pii,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op10_license_scan": op10_license_scan,
    "op9_decontamination": op9_decontamination,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL = {"op4_ngram_jaccard_join": OP4_SQL, "op5_embedding_near_dedup": OP5_SQL, "op7_mixing": OP7_SQL, "op9_decontamination": OP9_SQL}
