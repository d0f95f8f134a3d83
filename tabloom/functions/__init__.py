"""Column expressions and distribution functions."""

from tabloom.functions.expressions import (  # noqa: F401
    OperatorError, is_missing, normalise_nan, numeric_columns, string_columns,
    portable_hash, row_hash, qcol,
)
