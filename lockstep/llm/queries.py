"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .collocations import OP12_SQL, op12_collocations
from .jaccard_join import OP2_SQL, op2_jaccard
from .knn import OP1_SQL, op1_knn
from .license_scan import OP13_SQL, op13_license_scan
from .mixing import op9_mixing
from .mpeg_audio import op8_mpeg_audio
from .periodic_runs import op11_periodic_runs
from .quality import op3_quality
from .secrets import op6_secrets
from .suffix_tree import op7_suffix_tree
from .url_filter import OP10_SQL, op10_url_filter
from .warc import OP5_SQL, op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_knn": op1_knn,
    "op2_jaccard": op2_jaccard,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_secrets": op6_secrets,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_mixing": op9_mixing,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_knn": OP1_SQL,
    "op2_jaccard": OP2_SQL,
    "op5_warc": OP5_SQL,
    "op10_url_filter": OP10_SQL,
    "op12_collocations": OP12_SQL,
    "op13_license_scan": OP13_SQL,
}
