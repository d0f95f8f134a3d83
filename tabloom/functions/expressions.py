"""Column expressions shared by the operators (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


class OperatorError(ValueError):
    """Raised for invalid operator arguments (unknown column, bad method, ...)."""


def col_type(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise OperatorError(f"unknown column: {name!r}")


def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise OperatorError(f"unknown column(s): {missing}; available: {df.columns}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(col_type(df, name), NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_list(x) -> list:
    """None, one name or several names as a list."""
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys of ``left`` are kept once."""
    keys = as_list(keys)
    named = right.select(*[qcol(k).alias(f"__tb_k{i}") for i, k in enumerate(keys)],
                         *[qcol(c) for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        on = qcol(k).eqNullSafe(F.col(f"__tb_k{i}"))
        cond = on if i == 0 else cond & on
    return left.join(named, cond, how).drop(*[f"__tb_k{i}" for i in range(len(keys))])


def qcol(name: str) -> Column:
    """Column reference that tolerates spaces, dots and symbols in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(df: DataFrame, name: str) -> Column:
    """pandas ``isna``: NULL, or NaN for floating columns."""
    c = qcol(name)
    if isinstance(col_type(df, name), FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL: what is missing in pandas is missing here."""
    c = qcol(name)
    return F.when(~F.isnan(c), c) if isinstance(col_type(df, name), FLOAT_TYPES) else c


def normalise_nan(df: DataFrame) -> DataFrame:
    """Turn floating NaN into NULL in one projection so SQL null logic applies."""
    if not any(isinstance(f.dataType, FLOAT_TYPES) for f in df.schema.fields):
        return df
    exprs = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, FLOAT_TYPES):
            exprs.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)


# Fixed multiplicative hash so sampling/splitting is reproducible and the same
# arithmetic runs in DuckDB: ((key + seed) * 2654435761) mod 2^32.
HASH_MULTIPLIER = 2654435761
HASH_MODULUS = 4294967296


def portable_hash(key: Column | str, seed: int = 42) -> Column:
    """``((key + seed) * HASH_MULTIPLIER) mod 2^32`` for any long key: the key is
    reduced first and multiplied in 16-bit halves, so nothing overflows."""
    k = F.col(key) if isinstance(key, str) else key
    m = F.lit(HASH_MODULUS)
    x = F.pmod(F.pmod(k.cast("long"), m) + F.lit(seed % HASH_MODULUS), m)
    high = F.pmod(F.shiftright(x, 16) * F.lit(HASH_MULTIPLIER), m) * F.lit(65536)
    return F.pmod(high + x.bitwiseAND(F.lit(65535)) * F.lit(HASH_MULTIPLIER), m)


def row_hash(cols, seed: int = 42) -> Column:
    """Stronger option for keys that are not a single integer column."""
    return F.xxhash64(F.lit(seed), *[qcol(c) if isinstance(c, str) else c for c in cols])


def r(c: Column, digits: int = 6) -> Column:
    """Round a floating result (used by registered queries for stable hashes)."""
    return F.round(c.cast("double"), digits)
