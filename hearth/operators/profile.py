"""Profiling aggregates.

Wide profiles are computed in *long* form: columns are unpivoted to
``(column, value)`` and aggregated with ``groupBy(column)``. This keeps one
small aggregate per statistic however many columns there are (440 columns x
5 statistics in one ``agg`` would fall out of whole-stage codegen), and the
partial aggregation happens map-side before any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.operators.ranking import (attach_grouped, exact_quantile, join_nullsafe,  # noqa: F401  (re-export)
                                     ordered_cumulative, quantile_from_cumulative)
from hearth.session import compiled_methods


def long_form(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), as_type: str = "double",
              column_name: str = "column", value_name: str = "value") -> DataFrame:
    """Unpivot ``cols`` into ``(ids..., column, value)``; NULL values are kept."""
    sel = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in cols])
    return sel.unpivot(list(ids), list(cols), column_name, value_name)


def count_per_key(df: DataFrame, key: str = "id", name: str = "n") -> DataFrame:
    """A1: rows per key (partial aggregation map-side, then one shuffle)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def column_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A2/A3: n (non-null), mean, std (n-1), min, max per column (and group)."""
    lf = long_form(df, cols, ids=by)
    return (lf.groupBy(*by, "column")
            .agg(F.count("value").alias("n"),
                 F.avg("value").alias("mean"),
                 F.stddev_samp("value").alias("std"),
                 F.min("value").alias("min"),
                 F.max("value").alias("max")))


def mean_median(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A4: mean and exact median per column (median via the distributed rank).
    The mean is a plain ``avg`` over the rows (a second, map-side aggregated
    pass), so it sums the rows exactly as any SQL engine's ``avg`` does."""
    lf = long_form(df, cols, ids=by)
    means = lf.groupBy(*by, "column").agg(F.avg("value").alias("mean"))
    med = exact_quantile(lf, "value", 0.5, by=[*by, "column"], out_col="median")
    return join_nullsafe(means, med, [*by, "column"], how="left")


def nunique(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), approx: bool = False,
            rsd: float = 0.01) -> DataFrame:
    """A5: distinct non-null values per column. Exact form is two aggregations
    (distinct (column, value), then count); ``approx`` uses HyperLogLog++."""
    lf = long_form(df, cols, ids=by, as_type="string").where(F.col("value").isNotNull())
    if approx:
        return lf.groupBy(*by, "column").agg(F.approx_count_distinct("value", rsd).alias("nunique"))
    d = lf.select(*by, "column", "value").distinct()
    out = d.groupBy(*by, "column").agg(F.count(F.lit(1)).alias("nunique"))
    # columns that are entirely NULL (in a group) have no distinct value: report 0
    names = F.explode(F.array(*[F.lit(c) for c in cols])).alias("column")
    every = df.select(*by).distinct().select(*by, names) if by else df.sparkSession.range(1).select(names)
    return join_nullsafe(every, out, [*by, "column"], how="left").select(
        *by, "column", F.coalesce("nunique", F.lit(0)).cast("long").alias("nunique"))


def null_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, NULL rows and NULL share per column."""
    lf = long_form(df, cols, ids=by, as_type="string")
    return (lf.groupBy(*by, "column")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).cast("long").alias("n_null"))
            .withColumn("null_share", F.col("n_null") / F.col("n_rows")))


def constant_columns(df: DataFrame, cols: Sequence[str], max_unique: int = 1) -> DataFrame:
    """Columns with at most ``max_unique`` distinct non-null values."""
    return nunique(df, cols).where(F.col("nunique") <= max_unique)


def high_cardinality(df: DataFrame, cols: Sequence[str], threshold: int = 10) -> DataFrame:
    """Categorical columns with more than ``threshold`` distinct values."""
    return nunique(df, cols).where(F.col("nunique") > threshold)


def correlation(df: DataFrame, cols: Sequence[str], method: str = "pairs") -> DataFrame:
    """Pearson correlation of every column pair (a < b in list order).

    ``pairs``: one aggregate with ``corr(a, b)`` per pair (few columns).
    ``matrix``: one pass in which every task multiplies blocks of its rows
    (numpy) and keeps one row of moments a pair, for hundreds of columns; the
    result is bounded by the column count. Both modes are pairwise-complete.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    spark = df.sparkSession
    if method == "pairs":
        row = df.agg(*[F.corr(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
        cells = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}").alias("corr"))
                          for i, (a, b) in enumerate(pairs)])
        return row.select(F.inline(cells))
    if method == "matrix":
        found = _pair_moments(df, cols)
        data = []
        for i, a in enumerate(cols):
            for j in range(i + 1, len(cols)):
                va, vb, vab = found.get((i, j), (0.0, 0.0, 0.0))
                data.append((a, cols[j], vab / math.sqrt(va * vb) if va > 0 and vb > 0 else None))
        return spark.createDataFrame(data, "col_a string, col_b string, corr double")
    raise ValueError(f"unknown method {method!r}")


def _batch_moments(x: np.ndarray) -> list[np.ndarray]:
    """Of one batch (a row per column, NaN where missing), a matrix of pairs each, over the entries where
    both are present: count, mean a, mean b and the centred sums of a^2, b^2 and ab. Columns are centred on
    their batch means first, so the sums don't cancel; a constant one on its value."""
    here = ~np.isnan(x)
    full = bool(here.all())
    if full:
        low, high, mean = x.min(axis=1), x.max(axis=1), x.mean(axis=1)
    else:
        low, high = np.fmin.reduce(x, axis=1), np.fmax.reduce(x, axis=1)
        mean = np.where(here, x, 0.0).sum(axis=1) / np.maximum(here.sum(axis=1), 1)
    shift = np.where(low == high, low, mean)
    z = x - shift[:, None]
    p = len(x)
    if full:
        n, sums = np.full((p, p), float(x.shape[1])), z.sum(axis=1)
        zz = z @ z.T
        sa, saa = np.broadcast_to(sums[:, None], (p, p)), np.broadcast_to(zz.diagonal()[:, None], (p, p))
    else:
        z[~here] = 0.0
        h = here.astype(float)
        n, sa, saa, zz = h @ h.T, z @ h.T, (z * z) @ h.T, z @ z.T
    some = np.maximum(n, 1.0)
    saa = np.maximum(saa - sa * sa / some, 0.0)
    ma, cab = shift[:, None] + sa / some, zz - sa * sa.T / some
    infinite = np.isinf(x).any(axis=1)
    if infinite.any():  # such a column has no correlations
        lost = infinite[:, None] | infinite
        n, ma = np.where(lost, some, n), np.where(lost, 0.0, ma)
        saa, cab = np.where(lost, np.nan, saa), np.where(lost, np.nan, cab)
    return [n, ma, ma.T, saa, saa.T, cab]


def _merged(s: list[np.ndarray], t: list[np.ndarray]) -> list[np.ndarray]:
    """Moments of two sets of rows together (a set without a pair's rows leaves the other's as they are)."""
    n = s[0] + t[0]
    share = np.where(n > 0, t[0] / np.maximum(n, 1.0), 0.0)
    da, db = (np.where(s[0] == 0, 0.0, np.where(t[0] == 0, 0.0, t[k] - s[k])) for k in (1, 2))
    ma, mb = (np.where(s[0] == 0, t[k], s[k] + d * share) for k, d in ((1, da), (2, db)))
    w = s[0] * share
    return [n, ma, mb, s[3] + t[3] + da * da * w, s[4] + t[4] + db * db * w, s[5] + t[5] + da * db * w]


_MOMENTS = ("n", "ma", "mb", "caa", "cbb", "cab")


def _partition_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pair moments of a partition's rows: one row for each pair that is present in some."""
    total = None
    with np.errstate(all="ignore"):
        for batch in batches:
            if batch.num_rows:
                own = _batch_moments(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                total = own if total is None else _merged(total, own)
    if total is not None:
        a, b = np.triu_indices(len(total[0]), 1)
        kept = total[0][a, b] > 0
        a, b = a[kept], b[kept]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                                          *[pa.array(m[a, b]) for m in total]], names=["a", "b", *_MOMENTS])


def _pair_moments(df: DataFrame, cols: Sequence[str]) -> dict[tuple[int, int], tuple[float, float, float]]:
    """Centred sums of a^2, b^2 and ab for each column pair over the rows where both are present (NaN counts as
    missing). One pass: a task multiplies blocks of rows with numpy and gives one row a pair; those are
    put together by (a, b), centred on one of the pair's partial means."""
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = x.mapInArrow(_partition_moments, "a int, b int, " + ", ".join(f"{m} double" for m in _MOMENTS))
    pair = Window.partitionBy("a", "b")
    parts = parts.select("*", *[(F.col(m) - F.min(m).over(pair)).alias(f"d{m[1]}") for m in ("ma", "mb")])
    n, da, db = F.col("n"), F.col("da"), F.col("db")
    sums = parts.groupBy("a", "b").agg(*[
        (F.sum(c) + F.sum(n * u * v) - F.sum(n * u) * F.sum(n * v) / F.sum(n)).alias(c)
        for c, u, v in (("caa", da, da), ("cbb", db, db), ("cab", da, db))])
    with compiled_methods(df.sparkSession):
        return {(r.a, r.b): (r.caa, r.cbb, r.cab) for r in sums.collect()}


def class_overlap(df: DataFrame, cols: Sequence[str], label: str = "poor", n_bins: int = 20) -> DataFrame:
    """A10: how well each column separates the classes.

    ``overlap``: overlap coefficient of the two per-class normalised histograms
    (``n_bins`` equal-width bins over the column's range; 1 = identical).
    ``ks``: exact two-sample Kolmogorov-Smirnov distance on the raw values,
    from the distributed running counts of each class.
    """
    lf = long_form(df, cols, ids=[label]).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    y = F.col(label).cast("int")
    rng = lf.groupBy("column").agg(F.min("value").alias("__mn"), F.max("value").alias("__mx"),
                                    F.sum(y).alias("__N1"), F.sum(1 - y).alias("__N0"))
    j = attach_grouped(lf, rng, ["column"], how="inner")
    width = F.col("__mx") - F.col("__mn")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("__mn")) / width * n_bins), F.lit(n_bins - 1)))
    hist = (j.groupBy("column", b.alias("bin"))
            .agg(F.sum(y).alias("n1"), F.sum(1 - y).alias("n0"),
                 F.first("__N1").alias("tot1"), F.first("__N0").alias("tot0")))
    overlap = hist.groupBy("column").agg(
        F.sum(F.when((F.col("tot0") > 0) & (F.col("tot1") > 0),
                     F.least(F.col("n0") / F.col("tot0"), F.col("n1") / F.col("tot1")))).alias("overlap"))
    cum = ordered_cumulative(lf, "value", {"p": y.cast("long"), "q": (1 - y).cast("long")}, by=["column"])
    ks = cum.groupBy("column").agg(
        F.max(F.abs(F.try_divide(F.col("cum_p"), F.col("tot_p")) - F.try_divide(F.col("cum_q"), F.col("tot_q"))))
        .alias("ks"))
    return overlap.join(ks, "column")


def target_ratio(df: DataFrame, label: str = "poor", by: Sequence[str] = ("country",)) -> DataFrame:
    """Percent of positive rows."""
    return df.groupBy(*by).agg((F.avg(F.col(label).cast("int")) * 100).alias("pct_positive"))


def class_counts(df: DataFrame, label: str = "poor", by: Sequence[str] = ("country",)) -> DataFrame:
    """Rows per class."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def class_category_share(df: DataFrame, feature: str, label: str = "poor",
                         by: Sequence[str] = ("country",), estimator: Column | None = None) -> DataFrame:
    """Percent of the group's rows in each (class, category) cell.
    Each group is divided by its own row count (ledger D15). ``estimator``
    is an optional caller-supplied aggregate ``Column`` evaluated per cell
    (the plotting library's ``estimator=`` hook), returned as ``value``."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([estimator.alias("value")] if estimator is not None else [])
    cells = df.groupBy(*by, label, feature).agg(*aggs)
    if by:
        tot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__tot"))
        cells = join_nullsafe(cells, tot, by)
    else:
        cells = cells.withColumn("__tot", F.lit(df.count()))
    extra = ["value"] if estimator is not None else []
    return cells.select(*by, label, feature, "n", (F.col("n") / F.col("__tot") * 100).alias("pct"), *extra)


def class_kde(df: DataFrame, col: str, label: str = "poor", grid_size: int = 32,
              by: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density of ``col`` per class on a shared grid.

    Bandwidth per class by Scott's rule, ``h = std * n^(-1/5)``; the grid runs
    from the column's min to max (over both classes) in ``grid_size`` points.
    Each grid point is one SUM aggregate over the rows, so there is no join
    of rows with grid points and the work is one partial + final aggregate.
    """
    base = df.where(F.col(col).isNotNull() & F.col(label).isNotNull()).select(
        *by, label, F.col(col).cast("double").alias("__x"))
    st = base.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__n"),
                                      F.stddev_samp("__x").alias("__sd"),
                                      F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    st = st.select(*by, label, "__n",
                   (F.col("__sd") * F.pow(F.col("__n").cast("double"), -0.2)).alias("__h"),
                   F.min("__mn").over(w).alias("__gmin"), F.max("__mx").over(w).alias("__gmax"))
    j = attach_grouped(base, st, [*by, label], how="inner")
    step = (F.col("__gmax") - F.col("__gmin")) / max(grid_size - 1, 1)
    # a class with one row or a constant value has no bandwidth: its density is NULL
    sums = [F.sum(F.exp(F.lit(-0.5) * F.pow(F.try_divide(F.col("__gmin") + step * i - F.col("__x"), F.col("__h")), 2)))
            .alias(f"k{i}") for i in range(grid_size)]
    agg = j.groupBy(*by, label).agg(F.first("__n").alias("n"), F.first("__h").alias("h"),
                                    F.first("__gmin").alias("gmin"), F.first("__gmax").alias("gmax"), *sums)
    stack = ", ".join(f"{i}, k{i}" for i in range(grid_size))
    lf = agg.selectExpr(*by, label, "n", "h", "gmin", "gmax",
                        f"stack({grid_size}, {stack}) as (grid_index, ksum)")
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    return lf.select(*by, label, F.col("grid_index").cast("int").alias("grid_index"),
                     (F.col("gmin") + (F.col("gmax") - F.col("gmin")) / max(grid_size - 1, 1) * F.col("grid_index"))
                     .alias("x"),
                     F.try_divide(F.col("ksum"), norm).alias("density"))


def group_target_mean(df: DataFrame, col: str, label: str = "poor", by: Sequence[str] = ()) -> DataFrame:
    """``groupby(col).poor.mean()``."""
    return df.groupBy(*by, col).agg(F.avg(F.col(label).cast("double")).alias("target_mean"),
                                    F.count(F.lit(1)).alias("n"))


def category_frequency(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows in each category (NULL is its own category)."""
    cells = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    if by:
        tot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__tot"))
        cells = join_nullsafe(cells, tot, by)
    else:
        total = df.count()
        cells = cells.withColumn("__tot", F.lit(total))
    return cells.select(*by, col, "n", (F.col("n") / F.col("__tot")).alias("freq"))


def zscore_outliers(df: DataFrame, cols: Sequence[str], k: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose listed columns are within ``k`` sample standard
    deviations of their group mean (NULLs and constant columns are kept)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}")]
    if by:
        st = df.groupBy(*by).agg(*aggs)
        j = attach_grouped(df, st, by, how="inner")
    else:
        row = df.agg(*aggs).first().asDict()
        j = df.select("*", *[F.lit(v).cast("double").alias(k2) for k2, v in row.items()])
    cond = F.lit(True)
    for c in cols:
        dev = F.abs(F.col(c) - F.col(f"__m_{c}"))
        ok = F.col(c).isNull() | F.col(f"__s_{c}").isNull() | (F.col(f"__s_{c}") == 0) | \
            (dev <= F.lit(k) * F.col(f"__s_{c}"))
        cond = cond & ok
    return j.where(cond).select(*df.columns)
