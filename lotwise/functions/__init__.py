"""Column expressions shared by the operators."""

from lotwise.functions.hashing import draw_position, quoted, row_hash
from lotwise.functions.scalars import common_type, half_up, to_share

__all__ = ["common_type", "draw_position", "half_up", "quoted", "row_hash", "to_share"]
