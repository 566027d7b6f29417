"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestream.llm.chat import OP9_SQL, op9_chat_formatting
from lodestream.llm.decontaminate import OP10_SQL, op10_benchmark_decontamination
from lodestream.llm.langid import op8_language_id
from lodestream.llm.linededup import OP3_SQL, op3_line_dedup
from lodestream.llm.lm import op4_lm_scoring
from lodestream.llm.packing import op7_best_fit_packing
from lodestream.llm.quality import OP5_SQL, op5_quality_rules
from lodestream.llm.secrets import OP1_SQL, op1_secret_scan
from lodestream.llm.simhash import op6_simhash_near_dedup
from lodestream.llm.tokenfile import op2_token_files

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_files, op3_line_dedup, op4_lm_scoring, op5_quality_rules, op6_simhash_near_dedup, op7_best_fit_packing, op8_language_id, op9_chat_formatting, op10_benchmark_decontamination)}
ORACLE_SQL: dict[str, str] = {"op1_secret_scan": OP1_SQL, "op3_line_dedup": OP3_SQL, "op5_quality_rules": OP5_SQL, "op9_chat_formatting": OP9_SQL, "op10_benchmark_decontamination": OP10_SQL}
