from wardspark.functions.clinical import (  # noqa: F401
    baseline_creatinine, binarize, clear_sentinel, concat_ids, convert_unit, gender_code, is_valid,
    one_hot, parse_number, parse_trial_file, parse_visit_file, sentinel, stage_from_ratio, status,
)
from wardspark.functions.vocab import (  # noqa: F401
    ALL_FEATURES, CHART_FEATURES, LAB_FEATURES, LABEL_HORIZONS, bounds_table, item_vocab,
)
