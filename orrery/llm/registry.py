"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op3_nearest_neighbours
from .language import op4_language_id
from .mixing import OP9_SQL, op9_mixing
from .simhash import op8_simhash
from .neardup import OP2_SQL, op2_embedding_near_dedup
from .packing import op7_packing
from .privacy import op1_pii_surrogates
from .sharding import OP6_SQL, op6_sharding
from .substrings import OP5_SQL, op5_substring_dedup
from .urls import OP10_SQL, op10_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_url_filters": op10_url_filters,
}

SQL: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "op9_mixing": OP9_SQL, "op2_embedding_near_dedup": OP2_SQL, "op6_sharding": OP6_SQL, "op10_url_filters": OP10_SQL}
