"""Operators on DataFrames."""

from lotwise.operators.keys import (
    expected_row_draws,
    key_filter,
    key_frequency,
    key_metadata,
    key_totals,
    merge_memos,
    nonzero,
    restrict_memo,
    site_key_shares,
)
from lotwise.operators.rows import (
    at_site,
    tag_site,
    with_partner,
    with_record_id,
    with_unit_weight,
)
from lotwise.operators.sampling import repeat_rows, sample_per_key, weighted_sample
from lotwise.operators.sketch import approximate_weights, count_min_sketch, sample_by_sketch

__all__ = [
    "approximate_weights",
    "at_site",
    "count_min_sketch",
    "expected_row_draws",
    "key_filter",
    "key_frequency",
    "key_metadata",
    "key_totals",
    "merge_memos",
    "nonzero",
    "repeat_rows",
    "sample_by_sketch",
    "restrict_memo",
    "sample_per_key",
    "site_key_shares",
    "tag_site",
    "weighted_sample",
    "with_partner",
    "with_record_id",
    "with_unit_weight",
]
