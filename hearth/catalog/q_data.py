"""Catalog: sources/sinks (S1-S7), projections (P1-P12, P18, P19), joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.catalog.common import hh, ind, scored
from hearth.catalog.registry import query
from hearth.catalog.sqlfrag import BASE, HH, IND
from hearth.operators import joins, profile, schema
from hearth.operators.encode import Vocabulary, one_hot
from hearth.sources import io, tables

# ------------------------------------------------------------------ sources / sinks


@query("s1_load_hhold_train", f"WITH {HH} SELECT * FROM hh WHERE _split = 'train'")
def s1(spark, sf):
    """The household train file."""
    return io.load_hhold(spark, sf, "train")


@query("s2_load_hhold_test", f"WITH {HH} SELECT * EXCLUDE (poor) FROM hh WHERE _split = 'test'")
def s2(spark, sf):
    """The household test file (no target)."""
    return io.load_hhold(spark, sf, "test")


@query("s3_load_indiv_train", f"WITH {IND} SELECT * FROM ind WHERE _split = 'train'", round_cols=["o_totalprice"])
def s3(spark, sf):
    """S3: the individual train file."""
    return io.load_indiv(spark, sf, "train")


@query("s4_load_indiv_test", f"WITH {IND} SELECT * FROM ind WHERE _split = 'test'", round_cols=["o_totalprice"])
def s4(spark, sf):
    """The individual test file."""
    return io.load_indiv(spark, sf, "test")


_IND_COUNTRY = f"""WITH {HH},\n{IND}
SELECT ind.id, iid, country, o_orderstatus, o_totalprice FROM ind JOIN hh ON ind.id = hh.id WHERE ind._split = """


def _indiv_file(spark, sf, split):
    country = hh(spark, sf).select("id", "country")
    return io.load_indiv(spark, sf, split).join(country, "id").select(
        "id", "iid", "country", "o_orderstatus", "o_totalprice")


@query("s1_hhold_train_csv", f"WITH {HH} SELECT * FROM hh WHERE _split = 'train'")
def s1_csv(spark, sf):
    """S1 in the reference's layout: a household train CSV per country, written and read back."""
    return io.survey_roundtrip(spark, io.load_hhold(spark, sf, "train"), "hhold", "train")


@query("s2_hhold_test_csv", f"WITH {HH} SELECT * EXCLUDE (poor) FROM hh WHERE _split = 'test'")
def s2_csv(spark, sf):
    """S2 in the reference's layout."""
    return io.survey_roundtrip(spark, io.load_hhold(spark, sf, "test"), "hhold", "test")


@query("s3_indiv_train_csv", _IND_COUNTRY + "'train'", round_cols=["o_totalprice"])
def s3_csv(spark, sf):
    """S3 in the reference's layout."""
    return io.survey_roundtrip(spark, _indiv_file(spark, sf, "train"), "indiv", "train")


@query("s4_indiv_test_csv", _IND_COUNTRY + "'test'", round_cols=["o_totalprice"])
def s4_csv(spark, sf):
    """S4 in the reference's layout."""
    return io.survey_roundtrip(spark, _indiv_file(spark, sf, "test"), "indiv", "test")


@query("s5_submission_csv", BASE + "SELECT id, country, p AS poor FROM sc WHERE _split = 'test'",
       round_cols=["poor"])
def s5(spark, sf):
    """The submission ``(id, country, poor)`` for the test households,
    written as CSV to the shared checkpoint folder and read back."""
    sub = scored(spark, sf).where(F.col("_split") == "test").select(
        "id", "country", F.col("p").alias("poor"))
    return io.submission_roundtrip(spark, sub)


@query("s7_shape", f"WITH {HH} SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols FROM hh WHERE _split = 'train'")
def s7_shape(spark, sf):
    """``df.shape`` of the household train file."""
    return io.shape(io.load_hhold(spark, sf, "train"))


@query("s7_head", f"WITH {HH} SELECT * FROM hh WHERE _split = 'train' ORDER BY id LIMIT 5")
def s7_head(spark, sf):
    """``df.head()`` (first 5 households by id; the limit is the feature)."""
    return io.head(io.load_hhold(spark, sf, "train"), 5)


# ------------------------------------------------------------------ projections


@query("p1_drop_columns", f"WITH {IND} SELECT * EXCLUDE (o_orderpriority) FROM ind", round_cols=["o_totalprice"])
def p1(spark, sf):
    """Drop a configured column list from the individual table."""
    return schema.drop_columns(ind(spark, sf), ["o_orderpriority", "not_present"])


@query("p2_rename", f"WITH {IND} SELECT id, iid, o_orderstatus AS o_orderstatus_2, o_totalprice, "
       "o_orderpriority, _split FROM ind", round_cols=["o_totalprice"])
def p2(spark, sf):
    """Rename an individual column that must not clash with a household one."""
    return schema.rename_columns(ind(spark, sf), {"o_orderstatus": "o_orderstatus_2"})


@query("p3_select_numerical",
       "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax "
       "FROM lineitem", round_cols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
def p3(spark, sf):
    """Numeric columns chosen from the schema."""
    return schema.select_numerical(tables.read_table(spark, sf, "lineitem"), exclude=())


@query("p4_select_categorical", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def p4(spark, sf):
    """String columns chosen from the schema (keys kept in front)."""
    return schema.select_categorical(tables.read_table(spark, sf, "lineitem"),
                                     keep=["l_orderkey", "l_linenumber"], exclude=())


@query("p5_drop_categoricals", f"WITH {HH} SELECT id, country, poor, c_nationkey, _split FROM hh")
def p5(spark, sf):
    """P5: drop every string column but country (list taken from train)."""
    h = hh(spark, sf)
    return schema.drop_categoricals(h, reference=h.where(F.col("_split") == "train"))


@query("p6_features_label", f"WITH {HH} SELECT id, c_mktsegment, c_nationkey, _split, "
       "CAST(poor AS DOUBLE) AS label FROM hh WHERE _split = 'train'", round_cols=["label"])
def p6(spark, sf):
    """Features and the target as a double label in the same row."""
    return schema.features_label(hh(spark, sf).where(F.col("_split") == "train"))


@query("p7_filter_class", f"WITH {HH} SELECT * FROM hh WHERE poor")
def p7(spark, sf):
    """``df[df.poor == 1]``."""
    return schema.filter_class(hh(spark, sf), "poor", True)


@query("p8_split_filter", f"WITH {HH} SELECT * EXCLUDE (poor) FROM hh WHERE _split = 'test'")
def p8(spark, sf):
    """Concat train and test (U1), then take the test slice by its tag."""
    u = schema.union_frames([io.load_hhold(spark, sf, "train"), io.load_hhold(spark, sf, "test")])
    return schema.filter_split(u, "test").drop("poor")


@query("p9_stringify", f"""WITH {HH}
SELECT id,
       coalesce(CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE c_nationkey END AS VARCHAR), 'nan') AS nation,
       coalesce(lower(CAST(poor AS VARCHAR)), 'nan') AS poor
FROM hh""")
def p9(spark, sf):
    """Numbers and booleans as category strings; NULL -> 'nan' (nulls made on purpose)."""
    h = hh(spark, sf).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("c_nationkey"))
                             .alias("nation"), "poor")
    return schema.stringify_columns(h, ["nation", "poor"])


@query("p10_constant_column", f"WITH {HH} SELECT *, 'survey' AS source FROM hh")
def p10(spark, sf):
    """P10: a constant column."""
    return schema.add_constant(hh(spark, sf), "source", "survey")


@query("p11_select_order", f"WITH {HH} SELECT id, country, poor FROM hh WHERE _split = 'train'")
def p11(spark, sf):
    """Select and order columns."""
    return hh(spark, sf).where(F.col("_split") == "train").select("id", "country", "poor")


_A_NATIONS = list(range(0, 25, 3))


@query("p12_enforce_cols", f"WITH {HH} SELECT id, " + ", ".join(
    f"CASE WHEN CAST(c_nationkey AS VARCHAR) = '{n}' THEN 1 ELSE 0 END AS c_nationkey_{n}"
    for n in sorted(_A_NATIONS, key=str)) + ", CAST(0 AS INTEGER) AS not_in_test FROM hh WHERE _split = 'test'")
def p12(spark, sf):
    """Test encoded with its own vocabulary, aligned to train's columns
    (train = country A households, so most test nations are dropped and an
    absent column is added as 0), in train's order."""
    h = hh(spark, sf)
    tr = h.where((F.col("_split") == "train") & (F.col("country") == "A")).select("id", "c_nationkey")
    train_cols = one_hot(tr, ["c_nationkey"], Vocabulary.fit(tr, ["c_nationkey"])).columns + ["not_in_test"]
    te = h.where(F.col("_split") == "test").select("id", "c_nationkey")
    return schema.enforce_cols(one_hot(te, ["c_nationkey"]), train_cols)


@query("p18_distinct", f"WITH {HH} SELECT DISTINCT country FROM hh")
def p18(spark, sf):
    """``df['country'].unique()``."""
    return schema.distinct_values(hh(spark, sf), "country")


@query("p19_outlier_filter", f"""WITH {IND},
st AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM ind)
SELECT ind.* FROM ind, st WHERE abs(o_totalprice - m) <= 2.5 * s""", round_cols=["o_totalprice"])
def p19(spark, sf):
    """Drop rows beyond 2.5 sample standard deviations of the mean."""
    return profile.zscore_outliers(ind(spark, sf), ["o_totalprice"], k=2.5)


# ------------------------------------------------------------------ joins


@query("j1_num_indiv", f"WITH {HH},\n{IND}\nSELECT hh.*, coalesce(c.n, 0) AS num_indiv FROM hh "
       "LEFT JOIN (SELECT id, count(*) AS n FROM ind GROUP BY id) c ON hh.id = c.id")
def j1(spark, sf):
    """Individuals per household attached to the household table."""
    return joins.num_indiv(hh(spark, sf), ind(spark, sf))


@query("j1_num_indiv_childless",
       "SELECT o.o_orderkey AS id, o.o_orderstatus, o.o_totalprice, coalesce(c.n, 0) AS num_indiv "
       "FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) c "
       "ON o.o_orderkey = c.l_orderkey", round_cols=["o_totalprice"])
def j1_childless(spark, sf):
    """J1 where some households (orders) have no individual (line item): 0."""
    return joins.num_indiv(tables.households_childless(spark, sf), tables.individuals_childless(spark, sf))


@query("j2_indiv_semi_join", f"WITH {HH},\n{IND}\nSELECT * FROM ind WHERE id IN "
       "(SELECT id FROM hh WHERE _split = 'train')", round_cols=["o_totalprice"])
def j2(spark, sf):
    """Individuals of the train households (left semi join)."""
    return joins.indiv_of(ind(spark, sf), hh(spark, sf).where(F.col("_split") == "train"))


@query("j3_coverage", """SELECT o_orderstatus, count(*) AS n_households,
  CAST(sum(CASE WHEN l.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_without_indiv,
  bool_or(l.k IS NOT NULL) AS any_covered, bool_and(l.k IS NOT NULL) AS all_covered
FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.o_orderkey = l.k
GROUP BY o_orderstatus""")
def j3(spark, sf):
    """Households without individuals, per group (orders / line items)."""
    return joins.coverage(tables.households_childless(spark, sf), tables.individuals_childless(spark, sf),
                          by=["o_orderstatus"])


@query("j4_lookup_map", f"""WITH {HH},
f AS (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM hh WHERE _split = 'train') AS fr
      FROM hh WHERE _split = 'train' GROUP BY c_mktsegment)
SELECT hh.id, hh.c_mktsegment, f.fr AS seg_freq FROM hh LEFT JOIN f ON hh.c_mktsegment = f.c_mktsegment
WHERE hh._split = 'test'""", round_cols=["seg_freq"])
def j4(spark, sf):
    """Map test categories through a table fitted on train (unseen -> NULL)."""
    h = hh(spark, sf)
    freq = profile.category_frequency(h.where(F.col("_split") == "train"), "c_mktsegment")
    te = h.where(F.col("_split") == "test").select("id", "c_mktsegment")
    return joins.map_lookup(te, "c_mktsegment", freq, "c_mktsegment", "freq", out_col="seg_freq")


@query("j5_stats_broadcast", f"""WITH {IND}
SELECT id, iid, o_totalprice, avg(o_totalprice) OVER () AS mean, stddev_samp(o_totalprice) OVER () AS std
FROM ind""", round_cols=["o_totalprice", "mean", "std"])
def j5(spark, sf):
    """Whole-column statistics attached to every row (collected one-row
    statistics inlined as literals, no join)."""
    i = ind(spark, sf).select("id", "iid", "o_totalprice")
    st = i.agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("std"))
    return joins.attach_stats(i, st)

