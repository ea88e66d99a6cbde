"""Distributed ordering primitives.

A window with no ``PARTITION BY`` (or one partitioned by a two-valued class
column) runs in one task. These helpers give the same exact answers in two
levels instead: a small per-bucket count table is ranked (it has at most
``groups x buckets`` rows), and each bucket is ranked in its own window
partition, so the heavy window work is spread over many tasks.

* :func:`hash_rank` - exact ``row_number() over (partition by .. order by md5(key || seed))``.
* :func:`ordered_cumulative` - running sums over the distinct values of a column
  (ties grouped), the building block of exact quantiles, rank-sum AUC and KS.
* :func:`exact_quantile` - ``quantile_cont`` / ``percentile`` with linear interpolation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from hearth.functions.exprs import hash_hex, hex_prefix_int
from hearth.session import written

_ALL = "__all"


def _with_group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    """Give a constant group column when ``by`` is empty; the tables joined on it
    then hold exactly one row and are broadcast explicitly."""
    if by:
        return df, list(by), False
    return df.withColumn(_ALL, F.lit(0)), [_ALL], True


def join_nullsafe(big: DataFrame, small: DataFrame, keys: Sequence[str], broadcast: bool = False,
                  how: str = "inner") -> DataFrame:
    """Equi-join (inner unless ``how`` says left) on ``keys`` where NULL matches NULL (``<=>``), so a NULL
    group is a group here exactly as in ``groupBy`` and window partitions.
    Spark still plans ``<=>`` keys as an equi-join (hash or sort-merge)."""
    keys = list(keys)
    s = small.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in small.columns])
    if broadcast:
        s = F.broadcast(s)
    cond = [big[k].eqNullSafe(s[f"__r_{k}"]) for k in keys]
    return big.join(s, cond, how).drop(*[f"__r_{k}" for k in keys])


#: Groups whose statistics are small enough to travel inside the plan.
MAX_INLINE_GROUPS = 1000


def inline_rows(df: DataFrame, limit: int = MAX_INLINE_GROUPS) -> DataFrame | None:
    """``df`` as literals in the plan if it has at most ``limit`` rows, else None.
    Collects at most ``limit + 1`` rows; the result is safe to broadcast."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        return None
    types = {f.name: f.dataType for f in df.schema.fields}
    if not rows:
        return df.sparkSession.createDataFrame([], df.schema)
    made = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in types.items()]) for r in rows])
    return df.sparkSession.range(1).select(F.inline(made))


def attach_grouped(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Attach per-group statistics to every row; a NULL group is a group.

    Statistics of at most ``MAX_INLINE_GROUPS`` groups are collected and
    broadcast as literals, so the rows don't move to a few hot group keys; more
    groups are joined by a null-safe equi-join, where skewed keys are split at
    run time."""
    keys = list(by)
    small = inline_rows(stats)
    s = stats if small is None else small
    s = s.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in stats.columns])
    s = s if small is None else F.broadcast(s)
    cond = [df[k].eqNullSafe(s[f"__r_{k}"]) for k in keys]
    return df.join(s, cond, how).drop(*[f"__r_{k}" for k in keys])


def _join_small(big: DataFrame, small: DataFrame, keys: list[str], one_row: bool) -> DataFrame:
    """Equi-join a per-group table whose arrays are too wide for the plan. One-row
    tables are broadcast by hint; others are left to AQE, which broadcasts them
    when the materialised size is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``."""
    return join_nullsafe(big, small, keys, broadcast=one_row)


def hash_rank(df: DataFrame, key_cols: Sequence[str], seed: int | str, by: Sequence[str] = (),
              rank_col: str = "_rank", digits: int = 4) -> DataFrame:
    """Exact 1-based rank of each row by ``md5(key || seed)`` within ``by``.

    Level 1: bucket = first ``digits`` hex digits of the hash; count rows per
    (group, bucket) and turn the counts into offsets (a window over at most
    ``groups * 16**digits`` rows). Level 2: ``row_number`` inside each
    (group, bucket) plus the bucket's offset. Equal to the flat window.
    With 4 digits a group of 10^11 rows gives window groups of ~1.5M rows.
    A NULL group is a group; keys should be unique (a repeated key lands in
    one bucket).
    """
    h, b, off, g = "__h", "__b", "__off", "__g"
    d = df.withColumn(h, hash_hex(key_cols, seed))
    d = d.withColumn(b, hex_prefix_int(F.col(h), digits))
    # one non-null group key (a struct holds NULL groups) for counts, join and window: rows move once
    d = d.withColumn(g, F.struct(F.lit(0).alias("_"), *[F.col(c) for c in by]))
    counts = d.groupBy(g, b).agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(g, b, F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias(off))
    d = d.join(offsets, [g, b])
    w = Window.partitionBy(g, b).orderBy(h, *key_cols)
    d = d.withColumn(rank_col, (F.row_number().over(w) + F.col(off)).cast("long"))
    return d.drop(h, b, off, g)


def hash_first(df: DataFrame, key_cols: Sequence[str], seed: int | str, take: Callable[[Column], Column],
               by: Sequence[str] = (), out: str = "_first", digits: int = 4) -> DataFrame:
    """Mark the rows with the smallest ``md5(key || seed)`` of each group: ``take`` of the
    group's size of them (as ``hash_rank(..) <= take(n)``, without ranking all rows).

    Counts per (group, hash bucket) give the one bucket of a group in which the
    cut lies. Buckets before it are taken and those after it left by a filter;
    only the cut bucket's rows are shuffled and ranked.
    """
    h, b = "__h", "__b"
    d, groups, one = _with_group(df.withColumn(h, hash_hex(key_cols, seed)), by)
    d = d.withColumn(b, hex_prefix_int(F.col(h), digits))
    counts = d.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.select(*groups, b, "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                          F.sum("__n").over(Window.partitionBy(*groups)).alias("__tot"))
    want = F.least(take(F.col("__tot")), F.col("__tot"))
    cuts = (sizes.withColumn("__want", want).where((F.col("__off") < F.col("__want"))
                                                  & (F.col("__want") <= F.col("__off") + F.col("__n")))
            .select(*groups, F.col(b).alias("__cut"), (F.col("__want") - F.col("__off")).alias("__need")))
    j = attach_grouped(d, cuts, groups)
    clear = j.where(F.col("__cut").isNull() | (F.col(b) != F.col("__cut")))
    clear = clear.withColumn(out, F.coalesce(F.col(b) < F.col("__cut"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(h, *key_cols))
    edge = j.where(F.col(b) == F.col("__cut")).withColumn(out, place <= F.col("__need"))
    return clear.unionByName(edge).select(*df.columns, out)


def _bucket_of(bounds: Column, n_used: Column, v: Column, steps: int) -> Column:
    """Index of the first of the ``n_used`` chosen bounds that is >= v, by
    binary search (``steps`` = ceil(log2(max buckets))), O(log B) per row.
    Chosen bound i is entry ``floor(i * max_buckets / n_buckets)`` of the fine bound array."""
    init = F.struct(F.lit(0).alias("lo"), (n_used - 1).alias("hi"))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        go_right = F.try_element_at(bounds, mid + 1) < v
        open_ = acc["lo"] <= acc["hi"]
        return F.struct(F.when(open_ & go_right, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(open_ & ~go_right, mid - 1).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def value_buckets(dist: DataFrame, v: str, groups: list[str], one: bool, max_buckets: int,
                  rows_per_bucket: int) -> DataFrame:
    """Number the distinct values ``v`` of each group by ordered buckets ``__bk`` of about
    ``rows_per_bucket`` values (step 2 of :func:`ordered_cumulative`)."""
    probs = [i / max_buckets for i in range(1, max_buckets)]
    steps = max(1, (max_buckets - 1).bit_length())
    stats = dist.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__nd"),
        F.percentile_approx(v, F.array(*[F.lit(p) for p in probs]), 4 * max_buckets).alias("__fine"))
    numeric = isinstance(dist.schema[v].dataType, NumericType)
    cuts = F.greatest(F.lit(1), F.ceil(F.col("__nd") / F.lit(rows_per_bucket * max_buckets))).cast("long")
    nb = F.least(F.lit(max_buckets), F.greatest(F.lit(1), F.ceil(F.col("__nd") / F.lit(rows_per_bucket))))
    stats = stats.select(*groups, (nb - 1).cast("int").alias("__nu"), cuts.alias("__cuts"), F.transform(
        F.sequence(F.lit(1), F.greatest(nb - 1, F.lit(1)).cast("int")),
        lambda i: F.element_at("__fine", F.greatest(F.lit(1), F.least(
            F.floor(i * F.lit(max_buckets) / nb).cast("int"), F.lit(max_buckets - 1))))).alias("__bounds"))
    dist = _join_small(dist, stats, groups, one)
    coarse = F.when(F.col("__nu") <= 0, F.lit(0)).otherwise(_bucket_of(F.col("__bounds"), F.col("__nu"), F.col(v), steps))
    dist = dist.withColumn("__bk", coarse.cast("long"))
    if numeric:  # an even cut of a bucket keeps the order; the outermost buckets have one bound only
        lo, hi = F.try_element_at("__bounds", F.greatest(F.lit(1), F.col("__bk").cast("int"))), F.try_element_at(
            "__bounds", (F.col("__bk") + 1).cast("int"))
        inner = (F.col("__cuts") > 1) & (F.col("__bk") > 0) & (F.col("__bk") < F.col("__nu")) & (hi > lo)
        part = F.least(F.floor((F.col(v) - lo) / (hi - lo) * F.col("__cuts")), F.col("__cuts") - 1)
        dist = dist.withColumn("__bk", F.col("__bk") * F.col("__cuts") + F.when(inner, F.greatest(
            F.lit(0), part)).otherwise(0).cast("long"))
    return dist.drop("__bounds", "__nu", "__cuts")


def ordered_cumulative(df: DataFrame, value_col: str, weights: Mapping[str, Column],
                       by: Sequence[str] = (), max_buckets: int = 1024,
                       rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Running sums of ``weights`` over the distinct values of ``value_col``.

    Returns one row per (group, distinct value) with, for each weight ``w``:
    ``w`` (sum at this value), ``cum_w`` (sum over values <= this one),
    ``w_before`` (sum over values < this one) and ``tot_w`` (group total).
    Ties share one row, so the result is tie-safe. Rows whose value is NULL
    are ignored.

    Plan: (1) aggregate rows to distinct (group, value) - partial aggregation
    collapses hot values map-side; (2) per group, one pass gives the distinct
    count and ``max_buckets - 1`` approximate quantile bounds; a group uses
    ``ceil(count / rows_per_bucket)`` buckets: up to ``max_buckets`` of them are
    bounded by quantiles (binary search), and beyond that each is cut evenly
    between its bounds, so the number of buckets grows with the data; (3) bucket totals -> offsets
    (a window over at most groups x buckets rows); (4) the running sum of each
    bucket in its own window partition plus its offset. Exactness does not
    depend on the approximate bounds: they only balance the buckets.
    """
    names = list(weights)
    base = df.where(F.col(value_col).isNotNull())
    base, groups, one = _with_group(base, by)
    v = "__v"
    dist = (base.groupBy(*groups, F.col(value_col).alias(v))
            .agg(*[F.sum(weights[n]).alias(n) for n in names]))
    dist = value_buckets(dist, v, groups, one, max_buckets, rows_per_bucket)
    totals = dist.groupBy(*groups, "__bk").agg(*[F.sum(n).alias(f"__t_{n}") for n in names])
    w_off = Window.partitionBy(*groups).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*groups)
    offsets = totals.select(*groups, "__bk", *[
        F.coalesce(F.sum(f"__t_{n}").over(w_off), F.lit(0)).alias(f"__o_{n}") for n in names], *[
        F.sum(f"__t_{n}").over(w_all).alias(f"tot_{n}") for n in names])
    dist = join_nullsafe(dist, offsets, [*groups, "__bk"])
    w = Window.partitionBy(*groups, "__bk").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    out = dist.select(
        *groups, F.col(v).alias(value_col), *names,
        *[(F.sum(n).over(w) + F.col(f"__o_{n}")).alias(f"cum_{n}") for n in names],
        *[f"tot_{n}" for n in names])
    for n in names:
        out = out.withColumn(f"{n}_before", F.col(f"cum_{n}") - F.col(n))
    return out.drop(_ALL) if one else out


def quantile_from_cumulative(cum: DataFrame, value_col: str, q: float, by: Sequence[str] = (),
                             out_col: str = "quantile") -> DataFrame:
    """Exact quantile (linear interpolation between closest ranks) read off a
    running count ``n`` from :func:`ordered_cumulative`: the value(s) covering
    ranks ``floor`` and ``ceil`` of ``q*(n-1)``."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")
    cum, groups, one = _with_group(cum, by)
    pos = F.lit(q) * (F.col("tot_n") - 1)
    j = cum.select("*", pos.alias("__pos"), F.floor(pos).alias("__lo"), F.ceil(pos).alias("__hi"))

    def covers(r: Column) -> Column:
        return (F.col("n_before") <= r) & (r < F.col("cum_n"))

    res = (j.where(covers(F.col("__lo")) | covers(F.col("__hi")))
           .groupBy(*groups)
           .agg(F.max(F.when(covers(F.col("__lo")), F.col(value_col))).alias("__vlo"),
                F.max(F.when(covers(F.col("__hi")), F.col(value_col))).alias("__vhi"),
                F.first("__pos").alias("__pos"), F.first("__lo").alias("__lo")))
    res = res.select(*groups, (F.col("__vlo") + (F.col("__pos") - F.col("__lo"))
                               * (F.col("__vhi") - F.col("__vlo"))).alias(out_col))
    return res.drop(_ALL) if one else res


def exact_quantile(df: DataFrame, value_col: str, q: float, by: Sequence[str] = (),
                   out_col: str = "quantile", rows_per_bucket: int = 1_000_000, accuracy: int = 10_000) -> DataFrame:
    """Exact quantile with linear interpolation between closest ranks.

    Same definition as ``percentile``/``median`` in Spark and ``quantile_cont``
    in DuckDB, by selection between bounds: (1) a sketch of every group gives two values
    that bracket the wanted rank within ``4 / accuracy`` of the group's rows; (2) one pass counts
    the rows below and above, and each value between: only those values (after the
    map-side count) are shuffled, and written; (3) the rank is read off their running
    count. A group whose bracket misses the rank, should a sketch be further off than it
    promises, is solved from the running count of all its values.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")
    base, groups, one = _with_group(df.where(F.col(value_col).isNotNull()).select(*by, value_col), by)
    ends = [max(0.0, q - 2.0 / accuracy), min(1.0, q + 2.0 / accuracy)]
    sketch = base.groupBy(*groups).agg(F.percentile_approx(value_col, F.array(*map(F.lit, ends)), accuracy).alias("__ends"))
    sketch = sketch.select(*groups, F.col("__ends")[0].alias("__from"), F.col("__ends")[1].alias("__to"))
    v = F.col(value_col)
    side = F.when(v < F.col("__from"), -1).when(v > F.col("__to"), 1).otherwise(0)
    counts = attach_grouped(base, sketch, groups).withColumn("__side", side)
    counts = written(counts.groupBy(*groups, "__side", F.when(F.col("__side") == 0, v).alias(value_col))
                     .agg(F.count(F.lit(1)).alias("n")), "bracket")
    held = lambda s: F.coalesce(F.sum(F.when(F.col("__side") == s, F.col("n"))), F.lit(0))
    place = counts.groupBy(*groups).agg(held(-1).alias("__below"), F.sum("n").alias("tot_n"), held(0).alias("__in"))
    rank = F.lit(q) * (F.col("tot_n") - 1)
    hit = (F.floor(rank) >= F.col("__below")) & (F.ceil(rank) < F.col("__below") + F.col("__in"))
    inside = counts.where("__side = 0").drop("__side")
    if inside.count() <= rows_per_bucket:  # few values in all: one running count a group
        w = Window.partitionBy(*groups).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
        cum = inside.withColumn("cum_n", F.sum("n").over(w)).withColumn("n_before", F.col("cum_n") - F.col("n"))
    else:
        cum = ordered_cumulative(inside, value_col, {"n": F.col("n")}, by=groups, rows_per_bucket=rows_per_bucket).drop("tot_n")
    cum = attach_grouped(cum, place.where(hit).drop("__in"), groups, how="inner")
    cum = cum.withColumn("cum_n", F.col("cum_n") + F.col("__below")).withColumn("n_before", F.col("n_before") + F.col("__below"))
    out = quantile_from_cumulative(cum.drop("__below"), value_col, q, groups, out_col)
    missed = place.where(~hit).select(*groups)
    if not missed.isEmpty():
        rest = join_nullsafe(base, missed, groups)
        whole = ordered_cumulative(rest, value_col, {"n": F.lit(1).cast("long")}, by=groups, rows_per_bucket=rows_per_bucket)
        out = out.unionByName(quantile_from_cumulative(whole, value_col, q, groups, out_col))
    return out.drop(_ALL) if one else out
