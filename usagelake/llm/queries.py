"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import clusters, vector_codes
from .clusters import op13_ball_kmeans
from .decontaminate import op4_decontamination
from .language_model import op2_language_model
from .mixing import op1_mixing
from .near_duplicates import op5_near_duplicates
from .neighbours import op3_neighbours
from .sharding import op8_sharding
from .simhash import op12_covering_simhash
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op9_toxicity
from .urls import op7_url_filter
from .vector_codes import op11_vector_codes

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_model": op2_language_model,
    "op3_neighbours": op3_neighbours,
    "op4_decontamination": op4_decontamination,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_covering_simhash": op12_covering_simhash,
    "op13_ball_kmeans": op13_ball_kmeans,
}

ORACLE_SQL: dict[str, str] = {"op11_vector_codes": vector_codes.SQL, "op13_ball_kmeans": clusters.SQL}
