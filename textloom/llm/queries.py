"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import reply_trees, warc
from .kdtree import op3_kd_shards
from .latent import op6_latent_decontamination
from .lines import op5_line_dedup
from .media import op10_media_columns
from .packing import op7_best_fit_packing
from .pii import op1_pii_surrogates
from .simhash import op8_simhash_pivots
from .toxicity import op9_compression_toxicity


def queries():
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_warc_chunks": warc.op2_warc_chunks,
        "op3_kd_shards": op3_kd_shards,
        "op4_reply_trees": reply_trees.op4_reply_trees,
        "op5_line_dedup": op5_line_dedup,
        "op6_latent_decontamination": op6_latent_decontamination,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_simhash_pivots": op8_simhash_pivots,
        "op9_compression_toxicity": op9_compression_toxicity,
        "op10_media_columns": op10_media_columns,
    }


def oracle_sql():
    return {"op2_warc_chunks": warc.ORACLE_SQL, "op4_reply_trees": reply_trees.ORACLE_SQL}
