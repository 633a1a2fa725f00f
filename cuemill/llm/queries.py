"""The queries of the corpus operators and, where SQL can express them, their oracles."""

from .cohorts import OP13_SQL, op13_cohort_retention
from .divergence import OP11_SQL, op11_source_divergence
from .jaccard import op4_ngram_jaccard
from .linededup import OP3_SQL, op3_line_dedup
from .mixing import op9_mixing
from .packing import op8_packing
from .pii import op10_pii
from .quality import op2_quality
from .sharding import op5_sharding
from .simhash import op12_simhash
from .suffixes import op7_suffix_dedup
from .tiff import op6_tiff
from .topk import OP1_SQL, op1_topk

QUERIES = {
    "op1_topk": op1_topk,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_sharding": op5_sharding,
    "op6_tiff": op6_tiff,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_source_divergence": op11_source_divergence,
    "op12_simhash": op12_simhash,
    "op13_cohort_retention": op13_cohort_retention,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op11_source_divergence": OP11_SQL,
    "op13_cohort_retention": OP13_SQL,
}
