"""Projection, filter and schema operators.

Column lists are configuration: nothing here hard-codes a feature name.
All operators are pure projections/filters, so Catalyst prunes columns and
pushes filters into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hearth.functions.exprs import is_numeric, stringify

#: Columns that are bookkeeping, never features.
DEFAULT_KEYS = ("id", "iid", "country", "poor", "_split", "fold", "label")


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop hand-picked columns; names absent from ``df`` are ignored."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns (``wJthinfa`` -> ``wJthinfa_2`` style)."""
    for old, new in mapping.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def numeric_columns(df: DataFrame, exclude: Iterable[str] = DEFAULT_KEYS) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = DEFAULT_KEYS) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in ex]


def select_numerical(df: DataFrame, keep: Sequence[str] = (), exclude: Iterable[str] = DEFAULT_KEYS) -> DataFrame:
    """The numeric columns (plus ``keep`` columns in front)."""
    return df.select(*keep, *numeric_columns(df, set(exclude) | set(keep)))


def select_categorical(df: DataFrame, keep: Sequence[str] = (), exclude: Iterable[str] = DEFAULT_KEYS) -> DataFrame:
    """The string (categorical) columns (plus ``keep`` columns in front)."""
    return df.select(*keep, *string_columns(df, set(exclude) | set(keep)))


def drop_categoricals(df: DataFrame, reference: DataFrame | None = None,
                      keep: Sequence[str] = ("country", "_split")) -> DataFrame:
    """P5: drop every string column except ``keep``; the list is taken from
    ``reference`` (the train frame) when given and applied to ``df``."""
    src = reference if reference is not None else df
    cols = string_columns(src, exclude=keep)
    return drop_columns(df, cols)


def features_label(df: DataFrame, label: str = "poor", drop: Sequence[str] = ("country",),
                   label_col: str = "label") -> DataFrame:
    """Features and target side by side; the target becomes a double ``label``
    in the same row (no positional pairing)."""
    out = drop_columns(df, list(drop))
    return out.withColumn(label_col, F.col(label).cast("double")).drop(label)


def filter_class(df: DataFrame, label: str = "poor", value: bool | int = True) -> DataFrame:
    """``df[df.poor == value]``."""
    return df.where(F.col(label) == F.lit(value).cast(df.schema[label].dataType))


def filter_split(df: DataFrame, split: str, col: str = "_split") -> DataFrame:
    """The row-order slice ``iloc[:n]`` / ``iloc[n:]`` as a filter on a tag."""
    return df.where(F.col(col) == split)


def stringify_columns(df: DataFrame, cols: Iterable[str], null_as: str | None = "nan") -> DataFrame:
    """Numbers treated as categories (``astype('str')``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    sel: list[Column] = []
    targets = set(cols)
    for c in df.columns:
        sel.append(stringify(F.col(c), types[c], null_as).alias(c) if c in targets else F.col(c))
    return df.select(*sel)


def add_constant(df: DataFrame, name: str, value) -> DataFrame:
    """P10: constant column."""
    return df.withColumn(name, F.lit(value))


def enforce_cols(df: DataFrame, train_cols: Sequence[str], fill=0) -> DataFrame:
    """Keep exactly ``train_cols`` in train's order; absent ones become ``fill``."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in train_cols])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """``df[col].unique()``."""
    return df.select(col).distinct()


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """``pd.concat`` of frames by column name; missing columns are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def column_difference(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """Sorted names in ``a`` but not in ``b`` (``np.setdiff1d``)."""
    return sorted(set(a) - set(b))
