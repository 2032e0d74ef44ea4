"""The registered queries of this subpackage. Where SQL cannot express an operator, the tests hold it against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .divergence import OP12_SQL, op12_divergence
from .html_extract import op3_html
from .language import op4_language
from .media import op7_media
from .packing import op9_packing
from .pieces import op6_sentencepiece
from .quality import op10_quality
from .resampling import OP13_SQL, op13_resampling
from .resharding import op8_resharding
from .simhash import op1_simhash
from .suffix_dedup import OP11_SQL, op11_suffix_dedup
from .token_store import op2_token_store
from .toxicity import op5_toxicity

_ALL = (
    op1_simhash, op2_token_store, op3_html, op4_language, op5_toxicity, op6_sentencepiece, op7_media, op8_resharding, op9_packing, op10_quality,
    op11_suffix_dedup, op12_divergence, op13_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op11_suffix_dedup": OP11_SQL, "op12_divergence": OP12_SQL, "op13_resampling": OP13_SQL}
