"""The operators' queries, and SQL where it can express them."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .filter_audit import OP11_SQL, op11_filter_audit
from .language_id import op5_language_id
from .line_dedup import OP2_SQL, op2_line_dedup
from .min_max_hash import OP10_SQL, op10_min_max_hash
from .ngram_trie import op9_ngram_trie
from .packing import op4_packing
from .quality_rules import OP6_SQL, op6_quality_rules
from .radix_dedup import OP13_SQL, op13_radix_dedup
from .token_rollup import OP8_SQL, op8_token_rollup
from .vector_codes import OP12_SQL, op12_vector_codes
from .warc import OP1_SQL, op1_warc
from .weak_quality import op7_weak_quality

QUERIES = {f.__name__: f for f in (op1_warc, op2_line_dedup, op3_decontaminate, op4_packing, op5_language_id, op6_quality_rules, op7_weak_quality, op8_token_rollup, op9_ngram_trie, op10_min_max_hash, op11_filter_audit, op12_vector_codes, op13_radix_dedup)}
SQL = {"op1_warc": OP1_SQL, "op2_line_dedup": OP2_SQL, "op6_quality_rules": OP6_SQL, "op8_token_rollup": OP8_SQL, "op10_min_max_hash": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_radix_dedup": OP13_SQL}
