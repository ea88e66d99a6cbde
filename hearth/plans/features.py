"""Recipe -> model-ready feature frame (the feature part of SURVEY M9/M10).

One frame holds the train and test (or train-fold and validation-fold) rows
of a country, tagged by ``_split``, so the joint one-hot encoding (E5) sees
both and the split back is a filter, not a row position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from hearth.operators import encode, joins, schema
from hearth.plans.recipes import Recipe
from hearth.session import written

KEYS = ("id", "country", "poor", "_split", "fold", "label", "_holdout", "_draw")

#: The vector of a sparse recipe's categories.
CATEGORIES = "categories"


@dataclass
class FeatureFrame:
    df: DataFrame
    feature_cols: list[str]
    #: string columns left for encoders inside the model's pipeline (which new rows then pass through)
    cat_cols: list[str] = field(default_factory=list)


def build_features(recipe: Recipe, hhold: DataFrame, indiv: DataFrame | None, split_col: str = "_split",
                   standardize_by_split: bool = True) -> FeatureFrame:
    """Apply a country's recipe: drops, renames, num_indiv, binning, scaling,
    log, stringify + joint one-hot, NULL -> 0 (ledger D20).

    ``indiv=None`` means ``hhold`` already carries ``num_indiv`` (computed
    once and reused across folds: a household's size does not depend on the
    fold it is in)."""
    h = hhold.where(F.col("country") == recipe.country)
    h = schema.drop_columns(h, recipe.drop_hhold)
    if recipe.drop_string_cats:
        h = schema.drop_categoricals(h, reference=h.where(F.col(split_col) == "train"),
                                     keep=("country", split_col))
    if indiv is not None:
        i = schema.rename_columns(schema.drop_columns(indiv, recipe.drop_indiv), recipe.rename_indiv)
        # written: vocabulary, statistics, fit and score read the sizes instead of counting individuals again
        h = written(joins.num_indiv(h, i.select("id")), "households")
    elif "num_indiv" not in h.columns:
        raise ValueError("hhold needs num_indiv when no individual table is given")
    binned: list[str] = []
    if recipe.bin_num_indiv:
        h = encode.bin_column(h, "num_indiv")
        binned = ["num_indiv"]
    std = [c for c in recipe.standardize if c in h.columns and c not in binned]
    if std:
        h = encode.standardize(h, std, by=[split_col] if standardize_by_split else ())
    for c in recipe.log:
        if c in h.columns:
            h = encode.log_transform(h, c)
    numeric = [*std, *[c for c in recipe.log if c in h.columns]]
    if not recipe.bin_num_indiv and "num_indiv" not in numeric:
        numeric.append("num_indiv")
    types = {f.name: f.dataType for f in h.schema.fields}
    if recipe.encode_all_but_numeric:
        to_str = [c for c in h.columns if c not in KEYS and c not in numeric and c not in binned]
    else:
        to_str = [c for c in recipe.as_category if c in h.columns]
    h = schema.stringify_columns(h, to_str, null_as="nan")
    cats = [c for c in h.columns if c not in KEYS and c not in numeric
            and (c in to_str or c in binned or isinstance(types.get(c), StringType))]
    if recipe.sparse:
        h = schema.stringify_columns(h, [c for c in cats if c not in to_str], null_as=None)
        if cats:  # the categories of train and test rows, in one vector (the columns stay beside it)
            h = encode.one_hot_sparse(h, cats, out=CATEGORIES)
    else:
        h = encode.one_hot(h, cats, max_categories=recipe.max_categories)
    feats = [f.name for f in h.schema.fields if f.name not in KEYS and f.name not in cats
             and isinstance(f.dataType, NumericType)]
    h = h.fillna(0, subset=feats)
    return FeatureFrame(h, [*([CATEGORIES] if recipe.sparse and cats else []), *feats])
