"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .codes import OP11_SQL, op11_codes
from .ctw import op6_ctw
from .extract import op5_extract
from .hnsw import op9_hnsw
from .leaks import OP4_SQL, op4_leaks
from .licences import OP2_SQL, op2_licences
from .mixing import OP7_SQL, op7_mixing
from .near import OP3_SQL, op3_near
from .resample import OP13_SQL, op13_resample
from .secrets import OP10_SQL, op10_secrets
from .tokens import op12_tokens
from .toxicity import op8_toxicity
from .warc import OP1_SQL, op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc": op1_warc, "op2_licences": op2_licences, "op3_near": op3_near, "op4_leaks": op4_leaks, "op5_extract": op5_extract, "op6_ctw": op6_ctw, "op7_mixing": op7_mixing, "op8_toxicity": op8_toxicity, "op9_hnsw": op9_hnsw, "op10_secrets": op10_secrets, "op11_codes": op11_codes, "op12_tokens": op12_tokens, "op13_resample": op13_resample}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_licences": OP2_SQL, "op3_near": OP3_SQL, "op4_leaks": OP4_SQL, "op7_mixing": OP7_SQL, "op10_secrets": OP10_SQL, "op11_codes": OP11_SQL, "op13_resample": OP13_SQL}
