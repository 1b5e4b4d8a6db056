"""The queries of the dealt operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from phonoframe.llm import archives, divergence, resampling
from phonoframe.llm.archives import op5_zip_archives
from phonoframe.llm.divergence import op12_source_divergence
from phonoframe.llm.jaccard import op4_jaccard_join
from phonoframe.llm.langid import op2_language_id
from phonoframe.llm.media import op8_image_copies
from phonoframe.llm.mixing import op3_entropy_mixing
from phonoframe.llm.packing import op9_packing
from phonoframe.llm.resampling import op11_importance_resampling
from phonoframe.llm.secrets import op7_secret_scan
from phonoframe.llm.sharding import op10_ring_sharding
from phonoframe.llm.suffixes import op6_suffix_dedup
from phonoframe.llm.tokenfiles import op13_huffman_tokens
from phonoframe.llm.vptree import op1_vantage_point_search

QUERIES = {
    "op1_vantage_point_search": op1_vantage_point_search,
    "op2_language_id": op2_language_id,
    "op3_entropy_mixing": op3_entropy_mixing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_zip_archives": op5_zip_archives,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_image_copies": op8_image_copies,
    "op9_packing": op9_packing,
    "op10_ring_sharding": op10_ring_sharding,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_source_divergence": op12_source_divergence,
    "op13_huffman_tokens": op13_huffman_tokens,
}

ORACLE_SQL = {"op5_zip_archives": archives.ORACLE, "op11_importance_resampling": resampling.ORACLE, "op12_source_divergence": divergence.ORACLE}
