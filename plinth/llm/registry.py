"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from plinth.llm.licenses import op9_license_scan
from plinth.llm.mixing import op8_source_mix
from plinth.llm.pii import op4_personal_data
from plinth.llm.quality import OP1_SQL, op1_quality_rules
from plinth.llm.search import OP2_SQL, op2_bm25_search
from plinth.llm.secrets import op6_secret_scan
from plinth.llm.simhash import op3_simhash_groups
from plinth.llm.token_codec import op7_bpe_roundtrip
from plinth.llm.token_counts import op5_token_histogram
from plinth.llm.token_store import op10_token_store

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bm25_search": op2_bm25_search,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_personal_data": op4_personal_data,
    "op5_token_histogram": op5_token_histogram,
    "op6_secret_scan": op6_secret_scan,
    "op7_bpe_roundtrip": op7_bpe_roundtrip,
    "op8_source_mix": op8_source_mix,
    "op9_license_scan": op9_license_scan,
    "op10_token_store": op10_token_store,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op2_bm25_search": OP2_SQL}
