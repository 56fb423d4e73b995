"""The two-table fixture over three sites, generated.

Row counts by (site, key) and the values are fixed values that the golden
numbers in FIXTURES.md belong to.
"""

from __future__ import annotations

# tbl0 rows per site: key -> (distinct values, copies of each)
TBL0 = {
    "s0": {"A": (4, 1), "B": (4, 1), "C": (4, 1), "D": (4, 1)},
    "s1": {"A": (8, 55), "B": (2, 11), "C": (3, 31), "D": (3, 33)},
    "s2": {"A": (7, 1), "B": (6, 1), "C": (5, 1), "D": (3, 1)},
}
# tbl1 rows per site: key -> (first value, number of values)
TBL1 = {
    "s0": {"A": (800, 12), "B": (900, 5), "C": (900, 5)},
    "s1": {"A": (10000, 6), "B": (10100, 3), "C": (10200, 2)},
    "s2": {"A": (500, 12), "B": (600, 5), "C": (700, 5)},
}
SCHEMA = "key string, value string, site string"


def tbl0_rows():
    return [
        (key, f"{site}-{key}-{number}", site)
        for site, keys in TBL0.items()
        for key, (values, copies) in keys.items()
        for number in range(values)
        for _ in range(copies)
    ]


def tbl1_rows():
    return [
        (key, str(first + number), site)
        for site, keys in TBL1.items()
        for key, (first, values) in keys.items()
        for number in range(values)
    ]


def fixture_chain(spark, **options):
    from lotwise import ChainJoin, TableSpec

    tables = [
        TableSpec(name, spark.createDataFrame(rows, SCHEMA), site_col="site")
        for name, rows in (("tbl0", tbl0_rows()), ("tbl1", tbl1_rows()))
    ]
    return ChainJoin(tables, [("key", "key")], **options)
