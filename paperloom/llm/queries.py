"""The queries of the training-data operators and the SQL that DuckDB can check them with."""

from __future__ import annotations

from .ann import op10_nearest_neighbours
from .bpe import op9_byte_bpe
from .collocations import OP11_SQL, op11_collocations
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .htmltext import op1_html_extraction
from .langid import op7_language_id
from .near_dedup import OP3_SQL, op3_near_dedup
from .packing import op2_best_fit_packing
from .pii import OP5_SQL, op5_private_data
from .runs import op12_periodic_runs
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .token_counts import op13_token_counts
from .toxicity import op8_toxicity

QUERIES = {"op1_html_extraction": op1_html_extraction, "op2_best_fit_packing": op2_best_fit_packing, "op3_near_dedup": op3_near_dedup, "op4_substring_dedup": op4_substring_dedup, "op5_private_data": op5_private_data, "op6_exact_dedup": op6_exact_dedup, "op7_language_id": op7_language_id, "op8_toxicity": op8_toxicity, "op9_byte_bpe": op9_byte_bpe, "op10_nearest_neighbours": op10_nearest_neighbours, "op11_collocations": op11_collocations, "op12_periodic_runs": op12_periodic_runs, "op13_token_counts": op13_token_counts}
ORACLE_SQL = {"op3_near_dedup": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_private_data": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op11_collocations": OP11_SQL}
