"""Registered queries with the SQL that checks them."""

from lotwise.catalogue import draws, keys, tables, weights

_MODULES = (tables, weights, keys, draws)


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
