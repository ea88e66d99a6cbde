"""Feature transforms.

Fit/transform split: a *fit* reduces the data to a small, size-checked state
(one row of statistics, or a vocabulary guarded by ``max_categories``); a
*transform* is a pure projection (literals or a ``map`` lookup inlined in the
plan) so it stays inside whole-stage codegen and needs no shuffle. Statistics
per group (``by``) are joined on the group keys instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, ByteType, DoubleType, IntegerType, NumericType, StringType, StructField,
                               StructType)

from hearth.functions.exprs import bin_right_closed, hash_hex, hex_prefix_int, safe_ln, stringify
from hearth.operators.joins import map_lookup
from hearth.operators.profile import long_form
from hearth.operators.ranking import attach_grouped, exact_quantile
from hearth.operators.schema import DEFAULT_KEYS, enforce_cols, string_columns
from hearth.session import written

# Fixed values from the reference: the num_indiv bins of country C (right
# closed) and their labels, the last one covering (13, 20].
NUM_INDIV_EDGES = (0, 3, 5, 10, 13, 20)
NUM_INDIV_LABELS = ("0-3", "3-5", "5-10", "10-13", "16+")


class VocabularyTooLarge(ValueError):
    pass


def _fit_rows(df: DataFrame, fit_on: Column | None) -> DataFrame:
    return df if fit_on is None else df.where(fit_on)


def _one_row(df: DataFrame) -> dict:
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError("expected exactly one statistics row")
    return rows[0].asDict()


# ---------------------------------------------------------------- scaling

def standardize(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                fit_on: Column | None = None) -> DataFrame:
    """``(x - mean) / std`` (std with n-1) for each listed numeric column.

    ``by`` are the groups that get their own statistics: the reference scales
    each split with its own statistics (``by=["_split"]``, ledger D2);
    ``fit_on`` restricts the rows the statistics come from (``fit_on_train``).
    A zero or undefined std gives NULL (ledger D3).
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}")]
    fit = _fit_rows(df, fit_on)
    if by:
        st = fit.groupBy(*by).agg(*aggs)
        j = attach_grouped(df, st, by)
        m = {c: F.col(f"__m_{c}") for c in cols}
        s = {c: F.col(f"__s_{c}") for c in cols}
    else:
        row = _one_row(fit.agg(*aggs))
        j = df
        m = {c: F.lit(row[f"__m_{c}"]).cast("double") for c in cols}
        s = {c: F.lit(row[f"__s_{c}"]).cast("double") for c in cols}
    out = j.select(*[
        F.try_divide(F.col(c) - m[c], s[c]).alias(c) if c in cols else F.col(c) for c in df.columns])
    return out


def min_max_scale(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                  fit_on: Column | None = None) -> DataFrame:
    """``(x - min) / (max - min)``; a constant column maps to 0."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}")]
    fit = _fit_rows(df, fit_on)
    if by:
        j = attach_grouped(df, fit.groupBy(*by).agg(*aggs), by)
        lo = {c: F.col(f"__lo_{c}").cast("double") for c in cols}
        hi = {c: F.col(f"__hi_{c}").cast("double") for c in cols}
    else:
        row = _one_row(fit.agg(*aggs))
        j = df
        lo = {c: F.lit(row[f"__lo_{c}"]).cast("double") for c in cols}
        hi = {c: F.lit(row[f"__hi_{c}"]).cast("double") for c in cols}

    def scaled(c: str) -> Column:
        rng = hi[c] - lo[c]
        return F.when(F.col(c).isNull(), F.lit(None).cast("double")).when(rng == 0, F.lit(0.0)) \
            .otherwise((F.col(c) - lo[c]) / rng)

    return j.select(*[scaled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- vocabularies

@dataclass
class Vocabulary:
    """Sorted distinct non-null values per column (a fitted encoder)."""
    values: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str], max_categories: int = 1000,
            fit_on: Column | None = None) -> Vocabulary:
        if not cols:
            return Vocabulary({})
        lf = long_form(_fit_rows(df, fit_on), cols, as_type="string").where(F.col("value").isNotNull())
        d = lf.select("column", "value").distinct()
        limit = max_categories * len(cols)
        rows = d.take(limit + 1)
        if len(rows) > limit:
            raise VocabularyTooLarge(
                f"more than {max_categories} categories per column on average in {list(cols)}")
        vals: dict[str, list[str]] = {c: [] for c in cols}
        for r in rows:
            vals[r["column"]].append(r["value"])
        for c, v in vals.items():
            if len(v) > max_categories:
                raise VocabularyTooLarge(f"column {c!r} has {len(v)} > {max_categories} categories")
            v.sort()
        return Vocabulary(vals)

    def codes(self, col: str) -> Column:
        """A ``map`` literal value -> 0-based code, for ``element_at`` lookup."""
        vals = self.values[col]
        if not vals:
            return F.create_map().cast("map<string,int>")
        return F.create_map(*[x for i, v in enumerate(vals) for x in (F.lit(v), F.lit(i))])


def code_table(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """``(column, value, place, code)``: every distinct non-null value of every column of ``cols``, its
    ``code``, the rank (from 0) among the column's values in string order, and its ``place`` among all
    of them, columns in the order given; for any number of columns and values.

    All values are sorted over range partitions and written once to the shared folder; a
    value's place is its rank in its partition plus the sizes of the partitions before (one row
    a partition), and a column's codes start at its first place (one row a column)."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i)])
    values = (long_form(_fit_rows(df, fit_on), cols, as_type="string").where(F.col("value").isNotNull())
              .distinct().withColumn("nth", order[F.col("column")]))
    sorted_parts = values.repartitionByRange("nth", "value").withColumn("part", F.spark_partition_id())
    parts = written(sorted_parts, "codes")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("nth", "value"))
    placed = (parts.withColumn("rank", rank).join(offsets, "part")
              .select("column", "value", (F.col("rank") - 1 + F.col("offset")).cast("long").alias("place")))
    first = placed.groupBy("column").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "column").select("column", "value", "place", (F.col("place") - F.col("first")).alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str], vocab: Vocabulary | None = None,
                 codes_from: DataFrame | None = None) -> DataFrame:
    """Each value -> its rank among the sorted distinct values (from 0), an int (a long
    where a column has more than 2^31 values). Values missing from the vocabulary and NULL become NULL.

    Codes are joined from one :func:`code_table` of ``codes_from`` (default: the frame
    itself) for all columns, or looked up in a fitted ``vocab``."""
    if vocab is not None:
        return df.select(*[
            F.element_at(vocab.codes(c), F.col(c).cast("string")).alias(c) if c in cols else F.col(c)
            for c in df.columns])
    codes = written(code_table(df if codes_from is None else codes_from, cols), "code-table")
    sizes = {r["column"]: r["most"] for r in codes.groupBy("column").agg(F.max("code").alias("most")).collect()}
    out = df
    for c in cols:
        kind = "long" if sizes.get(c, 0) >= 2**31 else "int"
        own = codes.where(F.col("column") == c).select("value", F.col("code").cast(kind).alias("code"))
        out = map_lookup(out.withColumn(c, F.col(c).cast("string")), c, own, "value", "code", out_col=c)
    return out.select(*df.columns)


#: How Spark stores a vector column.
_STORED_VECTOR = StructType([StructField("type", ByteType()), StructField("size", IntegerType()),
                             StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])


def one_hot_places(df: DataFrame, cols: Sequence[str], key: str = "id",
                   codes_from: DataFrame | None = None) -> tuple[DataFrame, int]:
    """For each row of ``df`` with a value in ``cols``, the places of its 1s (``key, places``) among the
    0/1 columns of all values of all ``cols``, and the number of those columns.

    Cells are joined with the :func:`code_table` of ``codes_from`` (default: the frame itself) by
    (column, value), and one aggregate per ``key`` (unique) puts a row's places together."""
    codes = written(code_table(df if codes_from is None else codes_from, cols), "code-table")
    size = codes.count()
    if size >= 2**31:
        raise VocabularyTooLarge(f"a vector holds fewer than 2^31 categories, there are {size}")
    cells = long_form(df, cols, ids=[key], as_type="string").where(F.col("value").isNotNull())
    ones = cells.join(codes.select("column", "value", F.col("place").cast("int").alias("place")), ["column", "value"])
    return ones.groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("places")), size


def one_hot_sparse(df: DataFrame, cols: Sequence[str], key: str = "id", codes_from: DataFrame | None = None,
                   out: str = "categories") -> DataFrame:
    """E4-E6 without a limit of categories: ``df`` with the 0/1 columns of all values of all ``cols`` as one
    sparse vector (:func:`one_hot_places`), columns in the order given and values in string order. NULL gives
    no 1. The vectors are written in the form in which Spark stores them and read back; no value
    comes to the driver."""
    rows, size = one_hot_places(df, cols, key, codes_from)
    places = F.coalesce("places", F.array().cast("array<int>"))
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), places.alias("indices"),
                      F.transform(places, lambda _: F.lit(1.0)).alias("values")).cast(_STORED_VECTOR)
    rows = rows.select(F.col(key).alias("__key"), "places")
    made = df.join(rows, df[key] == rows["__key"], "left").select(*[df[c] for c in df.columns], vector.alias(out))
    field = StructField(out, VectorUDT(), metadata={"ml_attr": {"num_attrs": size}})
    return written(made, "sparse", StructType([*df.schema, field]))


def joint_one_hot_sparse(train: DataFrame, test: DataFrame, cols: Sequence[str], key: str = "id",
                         split_col: str = "_split", out: str = "categories") -> DataFrame:
    """E5 for any number of categories: both frames together, tagged, one vocabulary over both."""
    both = train.withColumn(split_col, F.lit("train")).unionByName(
        test.withColumn(split_col, F.lit("test")), allowMissingColumns=True)
    return one_hot_sparse(both, cols, key, out=out)


def encode_all_but_sparse(df: DataFrame, numeric: Sequence[str], keys: Sequence[str] = DEFAULT_KEYS, key: str = "id",
                          null_as: str = "nan", out: str = "categories") -> DataFrame:
    """E6 for any number of categories: every column outside ``numeric`` and ``keys``, stringified, in one vector."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cats = [c for c in df.columns if c not in set(numeric) and c not in set(keys)]
    s = df.select(*[stringify(F.col(c), types[c], null_as).alias(c) if c in cats else F.col(c) for c in df.columns])
    return one_hot_sparse(s, cats, key, out=out)


def one_hot_long(df: DataFrame, cols: Sequence[str], key: str = "id",
                 codes_from: DataFrame | None = None) -> DataFrame:
    """E4 in long form, for any number of categories: one row ``(key, column, code)`` per
    non-null cell, the place of its 1. Codes are those of :func:`label_encode`."""
    coded = label_encode(df.select(key, *cols), cols, codes_from=codes_from)
    return long_form(coded, cols, ids=[key], as_type="int", value_name="code").where(F.col("code").isNotNull())


def dummy_name(col: str, value: str, sep: str = "_") -> str:
    return f"{col}{sep}{value}"


def one_hot(df: DataFrame, cols: Sequence[str], vocab: Vocabulary | None = None,
            max_categories: int = 1000, sep: str = "_") -> DataFrame:
    """E4 (``pd.get_dummies``): one 0/1 int column ``col_value`` per category.

    Other columns keep their order and come first; dummies follow per column
    in sorted value order; NULL gives all zeros. The vocabulary is fitted on
    ``df`` unless given (fit it on train+test for the joint encoding, E5).
    """
    vocab = vocab or Vocabulary.fit(df, cols, max_categories)
    keep = [F.col(c) for c in df.columns if c not in cols]
    dummies = []
    for c in cols:
        s = F.col(c).cast("string")
        for v in vocab.values[c]:
            dummies.append(F.when(s == F.lit(v), 1).otherwise(0).alias(dummy_name(c, v, sep)))
    return df.select(*keep, *dummies)


def joint_one_hot(train: DataFrame, test: DataFrame, cols: Sequence[str], split_col: str = "_split",
                  max_categories: int = 1000) -> DataFrame:
    """E5: concatenate train and test (tagged), fit one vocabulary over both,
    encode, and keep the tag so the frame can be split back by filter."""
    both = train.withColumn(split_col, F.lit("train")).unionByName(
        test.withColumn(split_col, F.lit("test")), allowMissingColumns=True)
    return one_hot(both, cols, max_categories=max_categories)


def encode_all_but(df: DataFrame, numeric: Sequence[str], keys: Sequence[str] = DEFAULT_KEYS,
                   max_categories: int = 1000, null_as: str = "nan") -> DataFrame:
    """Every column outside ``numeric`` and ``keys`` is stringified (NULL ->
    ``'nan'``, ledger D7) and one-hot encoded, numbers included."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cats = [c for c in df.columns if c not in set(numeric) and c not in set(keys)]
    s = df.select(*[stringify(F.col(c), types[c], null_as).alias(c) if c in cats else F.col(c)
                    for c in df.columns])
    return one_hot(s, cats, max_categories=max_categories)


# ---------------------------------------------------------------- imputation

def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL -> 0 in numeric columns."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    targets = [c for c in (cols or num) if c in num]
    return df.fillna(0, subset=targets) if targets else df


def _fill_with(df: DataFrame, values: dict[str, float | None], compat: bool) -> DataFrame:
    cols = list(values)
    if compat:
        first = next((values[c] for c in cols if values[c] is not None), None)
        values = {c: first for c in cols}
    # a column with gaps is float in the reference (NaN), so the filled column is double
    return df.select(*[
        F.coalesce(F.col(c).cast("double"), F.lit(values[c]).cast("double")).alias(c)
        if c in values and values[c] is not None else F.col(c) for c in df.columns])


def fill_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), compat: bool = False,
              fit_on: Column | None = None) -> DataFrame:
    """NULL -> the column mean. ``compat=True`` reproduces the reference
    loop, where every column gets the first column's usable mean (ledger D4)."""
    fit = _fit_rows(df, fit_on)
    if by and not compat:
        st = fit.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
        j = attach_grouped(df, st, by)
        return j.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")).alias(c)
                          if c in cols else F.col(c) for c in df.columns])
    row = _one_row(fit.agg(*[F.avg(c).alias(c) for c in cols]))
    return _fill_with(df, {c: row[c] for c in cols}, compat)


def fill_median(df: DataFrame, cols: Sequence[str], compat: bool = False,
                fit_on: Column | None = None) -> DataFrame:
    """NULL -> the exact column median (distributed, see ``exact_quantile``).
    The per-column medians are one value per column, collected and inlined."""
    lf = long_form(_fit_rows(df, fit_on), cols)
    med = {r["column"]: r["median"] for r in
           exact_quantile(lf, "value", 0.5, by=["column"], out_col="median").collect()}
    return _fill_with(df, {c: med.get(c) for c in cols}, compat)


# ---------------------------------------------------------------- single-column transforms

def log_transform(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Natural log; values <= 0 give NULL (ledger D8)."""
    return df.withColumn(out or col, safe_ln(col))


def bin_column(df: DataFrame, col: str, edges: Sequence[float] = NUM_INDIV_EDGES,
               labels: Sequence[str] = NUM_INDIV_LABELS, out: str | None = None) -> DataFrame:
    """``pd.cut`` with right-closed bins; outside every bin -> NULL."""
    return df.withColumn(out or col, bin_right_closed(col, edges, labels))


# ---------------------------------------------------------------- target / frequency encodings

def target_mean_encode(df: DataFrame, cols: Sequence[str], label: str = "poor",
                       fit_on: Column | None = None, suffix: str = "") -> DataFrame:
    """Category -> mean of the target over the fit rows (train); a NULL, and a
    category not seen in the fit rows, becomes NULL (J4 semantics)."""
    fit = _fit_rows(df, fit_on)
    out = df
    for c in cols:
        means = fit.groupBy(c).agg(F.avg(F.col(label).cast("double")).alias("__tm"))
        out = map_lookup(out, c, means, c, "__tm", out_col=c + suffix)
    return out.select(*[c for c in out.columns])


def smoothed_target_encode(df: DataFrame, col: str, label: str = "poor", min_samples_leaf: int = 100,
                           smoothing: float = 10.0, noise_level: float = 0.0, seed: int = 0,
                           fit_on: Column | None = None, out: str | None = None,
                           key: str = "id") -> DataFrame:
    """Smoothed target encoding (Micci-Barreca):
    ``w = 1/(1+exp(-(n - min_samples_leaf)/smoothing))``,
    ``enc = prior*(1-w) + mean*w``; NULL and unseen categories get the prior.
    Optional multiplicative noise ``1 + noise_level*u*sqrt(3)``, ``u`` uniform in
    [-1, 1) from md5(key, seed) so it is stable under repartitioning."""
    fit = _fit_rows(df, fit_on)
    y = F.col(label).cast("double")
    prior = _one_row(fit.agg(F.avg(y).alias("p")))["p"]
    st = fit.groupBy(col).agg(F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__mean"))
    w = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("__n") - F.lit(min_samples_leaf)) / F.lit(float(smoothing))))
    st = st.select(col, (F.lit(prior) * (F.lit(1.0) - w) + F.col("__mean") * w).alias("__enc"))
    out_col = out or col
    j = map_lookup(df, col, st, col, "__enc", out_col=out_col)
    j = j.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(prior)))
    if noise_level:
        u = hex_prefix_int(hash_hex([key], seed), 8) / F.lit(float(16 ** 8)) * 2 - 1
        j = j.withColumn(out_col, F.col(out_col) * (1 + F.lit(noise_level) * u * math.sqrt(3)))
    return j


def frequency_encode(df: DataFrame, col: str, fit_on: Column | None = None, out: str | None = None) -> DataFrame:
    """Category -> its share of the fit rows; NULL and unseen -> 0."""
    fit = _fit_rows(df, fit_on)
    n = fit.count()
    freq = fit.groupBy(col).agg(F.try_divide(F.count(F.lit(1)), F.lit(n)).alias("__f"))
    out_col = out or col
    j = map_lookup(df, col, freq, col, "__f", out_col=out_col)
    return j.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0.0)))


# ---------------------------------------------------------------- composite

def preprocess(df: DataFrame, normalize_num: str | None = "standardize",
               enforce: Sequence[str] | None = None, fillmean: str | None = None,
               categorical: str | None = "label_encoder", keys: Sequence[str] = DEFAULT_KEYS,
               vocab_from: DataFrame | None = None, max_categories: int = 1000) -> DataFrame:
    """E15 ``pre_process_data``: scale -> encode -> align -> fill, same option names.

    * ``normalize_num``: ``standardize`` | ``min_max`` | None, on the frame's
      own statistics (reference parity).
    * ``categorical``: ``label_encoder`` | ``get_dummies`` | None. The
      vocabulary comes from ``vocab_from`` (the train frame) when given.
    * ``enforce``: train's output columns; applied *after* encoding so that
      validation keeps its dummies (ledger D5) and in train order (D6).
    * ``fillmean``: ``mean`` | ``median`` | None (0).
    """
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keys]
    if normalize_num == "standardize":
        df = standardize(df, num)
    elif normalize_num == "min_max":
        df = min_max_scale(df, num)
    elif normalize_num is not None:
        raise ValueError(f"unknown normalize_num {normalize_num!r}")
    cats = string_columns(df, exclude=keys)
    src = vocab_from if vocab_from is not None else df
    if categorical == "label_encoder" and cats:
        df = label_encode(df, cats, codes_from=src)
    elif categorical == "get_dummies" and cats:
        df = one_hot(df, cats, Vocabulary.fit(src, cats, max_categories))
    elif categorical is not None and categorical not in ("label_encoder", "get_dummies"):
        raise ValueError(f"unknown categorical {categorical!r}")
    if enforce is not None:
        df = enforce_cols(df, list(enforce))
    num_after = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keys]
    if fillmean == "mean":
        df = fill_mean(df, num_after)
    elif fillmean == "median":
        df = fill_median(df, num_after)
    elif fillmean is None:
        df = fill_zero(df, num_after)
    else:
        raise ValueError(f"unknown fillmean {fillmean!r}")
    return df
