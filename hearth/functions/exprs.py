"""Column-expression helpers. All return ``Column`` objects evaluated JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DoubleType, FloatType,
                               NumericType)

# Fixed value: clipping for log loss, the common library default (ledger D16).
LOG_LOSS_EPS = 1e-15


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(cols: Sequence[str | Column], seed: int | str) -> Column:
    """md5 hex of ``cast(c as string)`` joined by '|' with the seed appended.

    Deterministic, order independent and identical in any SQL engine with md5,
    which is what makes seeded sampling and folds reproducible.
    """
    parts = [_col(c).cast("string") for c in cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def hex_prefix_int(hex_col: Column, digits: int) -> Column:
    """Integer value of the first ``digits`` hex characters (<= 15 digits)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("long")


def clip_prob(p: str | Column, eps: float = LOG_LOSS_EPS) -> Column:
    return F.greatest(F.least(_col(p).cast("double"), F.lit(1.0 - eps)), F.lit(eps))


def log_loss_term(y: str | Column, p: str | Column, eps: float = LOG_LOSS_EPS) -> Column:
    """Per-row binary cross entropy with p clipped to [eps, 1-eps]."""
    pc = clip_prob(p, eps)
    yc = _col(y).cast("double")
    return -(yc * F.ln(pc) + (F.lit(1.0) - yc) * F.ln(F.lit(1.0) - pc))


def safe_ln(c: str | Column) -> Column:
    """Natural log, NULL for values <= 0 (ledger D8)."""
    x = _col(c).cast("double")
    return F.when(x > 0, F.ln(x))


def bin_right_closed(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed binning: (e0,e1] -> labels[0], ...; outside -> NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    x = _col(c)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def stringify(c: str | Column, dtype: DataType, null_as: str | None = "nan") -> Column:
    """Cast a value to a category string.

    Integral doubles become ``"3"`` rather than ``"3.0"``/``"3.0E7"`` so that
    output is engine independent (ledger D10); booleans are lower case; a
    NULL becomes the category ``null_as`` (ledger D7) unless it is None.
    """
    x = _col(c)
    if isinstance(dtype, (DoubleType, FloatType)):
        integral = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
        s = F.when(integral, x.cast("long").cast("string")).otherwise(x.cast("string"))
    elif isinstance(dtype, BooleanType):
        s = F.lower(x.cast("string"))
    else:
        s = x.cast("string")
    return s if null_as is None else F.coalesce(s, F.lit(null_as))


def prob_of_class(vec: str | Column, index: int = 1) -> Column:
    """Component ``index`` of an ML probability vector (``preds[:, 1]``)."""
    return vector_to_array(_col(vec))[index]


def is_numeric(dtype: DataType) -> bool:
    return isinstance(dtype, NumericType)


def logistic(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))
