"""Registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from leafline.llm.codes import op11_vector_codes
from leafline.llm.decontaminate import OP5_SQL, op5_decontaminate
from leafline.llm.language import op2_language_id
from leafline.llm.lines import op9_fuzzy_lines
from leafline.llm.mixing import op7_mix_sources
from leafline.llm.neighbours import op13_hashed_neighbours
from leafline.llm.pii import op8_pii
from leafline.llm.quality import op4_quality
from leafline.llm.repeats import op12_periodic_runs
from leafline.llm.rules import OP6_SQL, op6_host_rules
from leafline.llm.sharding import op10_shard_bytes
from leafline.llm.simhash import op1_simhash_dedup
from leafline.llm.tokens import op3_token_pack

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_language_id": op2_language_id,
    "op3_token_pack": op3_token_pack,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_host_rules": op6_host_rules,
    "op7_mix_sources": op7_mix_sources,
    "op8_pii": op8_pii,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_shard_bytes": op10_shard_bytes,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hashed_neighbours": op13_hashed_neighbours,
}

ORACLE_SQL = {
    "op5_decontaminate": OP5_SQL,
    "op6_host_rules": OP6_SQL,
}
