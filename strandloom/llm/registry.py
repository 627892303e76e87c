"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_bpe import op1_byte_bpe
from .op2_language import op2_language
from .op3_fingerprint import op3_fingerprint
from .op4_jaccard import OP4_SQL, op4_jaccard
from .op5_quality import op5_quality
from .op6_licenses import OP6_SQL, op6_licenses
from .op7_line_dedup import OP7_SQL, op7_line_dedup
from .op8_token_counts import op8_token_counts
from .op9_sharding import op9_sharding
from .op10_decontaminate import op10_decontaminate
from .op11_variants import OP11_SQL, op11_variants
from .op12_phrases import OP12_SQL, op12_phrases
from .op13_secrets import OP13_SQL, op13_secrets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_byte_bpe, op2_language, op3_fingerprint, op4_jaccard, op5_quality,
        op6_licenses, op7_line_dedup, op8_token_counts, op9_sharding, op10_decontaminate, op11_variants, op12_phrases, op13_secrets,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": OP4_SQL, "op6_licenses": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_variants": OP11_SQL, "op12_phrases": OP12_SQL, "op13_secrets": OP13_SQL}
