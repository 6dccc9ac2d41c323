"""Deterministic pseudo-random numbers derived from row keys.

md5 of plain key text is used because it gives the same value in every engine
and on every retry, so splits and synthetic rows are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits: the widest value a DOUBLE represents exactly.
_DIGITS = 13
HASH_RANGE = 16**_DIGITS


def _number_sql(key: str, salt: object) -> str:
    digest = f"md5(concat('{salt}:', CAST(`{key}` AS STRING)))"
    return f"CAST(conv(substring({digest}, 1, {_DIGITS}), 16, 10) AS BIGINT)"


def key_number(key: str, salt: object) -> Column:
    """Uniform BIGINT in [0, 2**52) from a key column."""
    return F.expr(_number_sql(key, salt))


def key_uniform(key: str, salt: object) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return F.expr(f"{_number_sql(key, salt)} / double({HASH_RANGE}L)")


def key_bucket(key: str, salt: object, buckets: int) -> Column:
    """Uniform BIGINT in [0, buckets)."""
    return F.expr(f"{_number_sql(key, salt)} % {buckets}L")
