"""The subpackage's queries and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kadastra.llm.audit import OP12_SQL, op12_filter_audit
from kadastra.llm.bpe import op6_bpe
from kadastra.llm.gnat import OP13_SQL, op13_vector_codes
from kadastra.llm.licenses import OP11_SQL, op11_licenses
from kadastra.llm.mixing import op5_mixing
from kadastra.llm.pii import op8_pii
from kadastra.llm.pivots import OP9_SQL, op9_pivots
from kadastra.llm.quotes import OP1_SQL, op1_quotes
from kadastra.llm.ranking import op4_quality
from kadastra.llm.secrets import OP10_SQL, op10_secrets
from kadastra.llm.simhash import op2_simhash
from kadastra.llm.suffixes import op3_suffixes
from kadastra.llm.vptree import op7_simhash_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotes": op1_quotes,
    "op2_simhash": op2_simhash,
    "op3_suffixes": op3_suffixes,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_bpe": op6_bpe,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_pii": op8_pii,
    "op9_pivots": op9_pivots,
    "op10_secrets": op10_secrets,
    "op11_licenses": op11_licenses,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {"op1_quotes": OP1_SQL, "op9_pivots": OP9_SQL, "op10_secrets": OP10_SQL, "op11_licenses": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_vector_codes": OP13_SQL}
