"""Queries: descriptions that build DataFrames."""

from lotwise.plans.chain import ChainJoin, TableSpec
from lotwise.plans.tree import TreeJoin

__all__ = ["ChainJoin", "TableSpec", "TreeJoin"]
