"""Per-country feature and model recipes (one config object used by both the
training driver and the cross-validation driver, SURVEY 3.2).

Feature names are configuration. ``REFERENCE_*`` hold the reference's own
column lists and model parameters for data with the competition's schema;
``standin_recipes()`` maps the same recipe shapes onto the household tables
built from the test data (customer/orders).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values from the reference (per-country drop lists and model
# parameters). Kept together, in the reference's order.
REFERENCE_DROPS = {
    "A": {
        "indiv_many_nulls": ["OdXpbPGJ"],
        "hhold_overlapping": ["YFMZwKrU", "OMtioXZZ"],
    },
    "B": {
        "hhold_many_nulls": ["FGWqGkmD", "BXOWgPgL", "umkFMfvA", "McFBIGsm", "IrxBnWxE", "BRzuVmyf",
                             "dnlnKrAg", "aAufyreG", "OSmfjCbE"],
        "hhold_one_value": ["ZehDbxxy", "qNlGOBmo", "izDpdZxF", "dsUYhgai"],
        "hhold_overlapping": ["qrOrXLPM", "NjDdhqIe", "rCVqiShm", "ldnyeZwD", "BEyCyEUG", "VyHofjLM",
                              "GrLBZowF", "oszSdLhD", "NBWkerdL", "vuQrLzvK", "cDhZjxaW", "IOMvIGQS"],
        "hhold_correlated": ["ZvEApWrk"],
        "indiv_many_nulls": ["BoxViLPz", "qlLzyqpP", "unRAgFtX", "TJGiunYp", "WmKLEUcd", "DYgxQeEi",
                             "jfsTwowc", "MGfpfHam", "esHWAAyG", "DtcKwIEv", "ETgxnJOM", "TZDgOhYY",
                             "sWElQwuC", "jzBRbsEG", "CLTXEwmz", "WqEZQuJP", "DSttkpSI", "sIiSADFG",
                             "uDmhgsaQ", "hdDTwJhQ", "AJgudnHB", "iZhWxnWa", "fyfDnyQk", "nxAFXxLQ",
                             "mAeaImix", "HZqPmvkr", "tzYvQeOb", "NfpXxGQk"],
    },
    "C": {
        "hhold_one_value": ["GRGAYimk", "DNnBfiSI", "laWlBVrk", "XAmOFyyg", "gZWEypOM", "kZmWbEDL",
                            "tTScFJYA", "xyzchLjk", "MtkqdQSs", "enTUTSQi", "kdkPWxwS", "HNRJQbcm"],
        "hhold_overlapping": ["LhUIIEHQ", "PNAiwXUz", "NONtAKOM", "WWuPOkor", "CtFxPQPT", "qLDzvjiU",
                              "detlNNFh", "tXjyOtiS", "EQtGHLFz", "cmjTMVrd", "hJrMTBVd", "IRMacrkM",
                              "EQSmcscG", "aFKPYcDt", "BBPluVrb", "gAZloxqF", "vSqQCatY", "phbxKGlB",
                              "snkiwkvf", "ZZGQNLOX", "POJXrpmn", "jmsRIiqp", "izNLFWMH", "nTaJkLaJ"],
    },
}

# Fixed value: individual column renamed to avoid a household name clash (B).
REFERENCE_INDIV_RENAME = {"B": {"wJthinfa": "wJthinfa_2"}}

REFERENCE_FEATURES = {
    "A": {"standardize": ["TiwRslOh", "num_indiv"], "as_category": ["nEsgxvAq"]},
    "B": {"standardize": ["num_indiv"], "drop_string_cats": True, "encode_all_but_numeric": True},
    "C": {"standardize": ["xFKmUXhu", "kLAQgdly", "mmoCpqWS"], "log": ["DBjxSUvf"], "bin_num_indiv": True,
          "drop_string_cats": True, "encode_all_but_numeric": True},
}

REFERENCE_MODELS = {
    "A": {"kind": "gbt", "n_estimators": 100, "max_depth": 5, "subsample": 0.5, "min_child_weight": 1,
          "seed": 144},
    "B": {"kind": "gbt", "n_estimators": 400, "max_depth": 3, "min_child_weight": 5},
    "C": {"kind": "gbt", "n_estimators": 400, "max_depth": 5, "subsample": 0.5, "min_child_weight": 1,
          "seed": 144},
    "C_cv": {"kind": "logistic", "C": 2.0},
}

# Seeds of the reference's resampling and fold splits.
RESAMPLE_SEED = 144
FOLD_SEED = 2
N_FOLDS = 3


@dataclass
class Recipe:
    """Feature and model recipe of one country."""
    country: str
    drop_hhold: list[str] = field(default_factory=list)
    drop_indiv: list[str] = field(default_factory=list)
    rename_indiv: dict[str, str] = field(default_factory=dict)
    drop_string_cats: bool = False
    standardize: list[str] = field(default_factory=list)
    as_category: list[str] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    bin_num_indiv: bool = False
    encode_all_but_numeric: bool = False
    model: dict = field(default_factory=lambda: {"kind": "gbt", "n_estimators": 100, "max_depth": 5})
    resample: str | None = None
    max_categories: int = 1000
    #: wide data: categories of train and test rows go into one sparse vector, for any number of them,
    #: instead of one dense 0/1 column each
    sparse: bool = False


def reference_recipes() -> dict[str, Recipe]:
    """The reference's recipes, for household data with its schema. Its hundreds of
    categories, decimal numbers among them, go into sparse vectors."""
    out = {}
    for c in ("A", "B", "C"):
        d = REFERENCE_DROPS[c]
        f = REFERENCE_FEATURES[c]
        hh = [x for k, v in d.items() if k.startswith("hhold") for x in v]
        iv = [x for k, v in d.items() if k.startswith("indiv") for x in v]
        out[c] = Recipe(country=c, drop_hhold=hh, drop_indiv=iv,
                        rename_indiv=dict(REFERENCE_INDIV_RENAME.get(c, {})),
                        drop_string_cats=f.get("drop_string_cats", False),
                        standardize=list(f.get("standardize", [])), as_category=list(f.get("as_category", [])),
                        log=list(f.get("log", [])), bin_num_indiv=f.get("bin_num_indiv", False),
                        encode_all_but_numeric=f.get("encode_all_but_numeric", False),
                        model=dict(REFERENCE_MODELS[c]), sparse=True)
    return out


def standin_recipes(model_overrides: dict | None = None) -> dict[str, Recipe]:
    """The same three recipe shapes on the test-data households.

    A: string categoricals kept and one-hot encoded, the nation key used as a
       category, num_indiv standardised.
    B: string categoricals dropped; every column but num_indiv one-hot encoded.
    C: as B, with num_indiv binned instead of standardised.
    """
    mo = model_overrides or {}
    a = Recipe("A", standardize=["num_indiv"], as_category=["c_nationkey"],
               model={**REFERENCE_MODELS["A"], **mo})
    b = Recipe("B", drop_string_cats=True, standardize=["num_indiv"], encode_all_but_numeric=True,
               model={**REFERENCE_MODELS["B"], **mo})
    c = Recipe("C", drop_string_cats=True, bin_num_indiv=True, encode_all_but_numeric=True,
               model={**REFERENCE_MODELS["C"], **mo})
    return {"A": a, "B": b, "C": c}
