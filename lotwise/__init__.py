"""Count and sample join results without computing the join."""

from lotwise.operators import repeat_rows, sample_per_key, weighted_sample
from lotwise.plans import ChainJoin, TableSpec, TreeJoin
from lotwise.session import build_session
from lotwise.staging import Staging, release_all

__all__ = [
    "ChainJoin",
    "Staging",
    "TableSpec",
    "TreeJoin",
    "build_session",
    "release_all",
    "repeat_rows",
    "sample_per_key",
    "weighted_sample",
]
