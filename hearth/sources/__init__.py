from hearth.sources.io import (head, load_hhold, load_indiv, metrics_roundtrip,
                               read_csv_table, shape, submission_roundtrip,
                               write_metrics, write_submission)
from hearth.sources.tables import (households, households_childless, individuals,
                                   individuals_childless, labelled_documents,
                                   read_table)

__all__ = [
    "head", "load_hhold", "load_indiv", "metrics_roundtrip", "read_csv_table", "shape",
    "submission_roundtrip", "write_metrics", "write_submission", "households",
    "households_childless", "individuals", "individuals_childless", "labelled_documents",
    "read_table",
]
