"""The operators' queries and, where SQL can express one, its DuckDB SQL."""

from . import sql
from .alignment import op11_alignment
from .decontaminate import op1_decontamination
from .hardneg import op12_hard_negatives
from .langid import op8_language_id
from .lattice import op5_lm_scores
from .licences import op6_licences
from .mixing import op3_mixing
from .neardup import op4_near_duplicates
from .tokens import op9_token_counts
from .toxicity import op10_toxicity
from .urlfilter import op13_url_filter
from .vectors import op7_embedding_duplicates
from .warc import op2_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_lm_scores": op5_lm_scores,
    "op6_licences": op6_licences,
    "op7_embedding_duplicates": op7_embedding_duplicates,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filter": op13_url_filter,
}
ORACLE_SQL = {
    "op1_decontamination": sql.OP1,
    "op2_warc": sql.OP2,
    "op6_licences": sql.OP6,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": sql.OP12,
    "op13_url_filter": sql.OP13,
}
