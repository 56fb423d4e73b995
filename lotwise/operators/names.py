"""Reserved working columns. Table columns may not start with ``__``."""

KEY = "__key"  # group a row or a draw belongs to
LEAF = "__leaf"  # hash slice of a large group
POS = "__pos"  # position of a draw inside its group
TOTAL = "__total"  # weight of the whole group
ROWS = "__rows"  # number of rows in the group
WEIGHT = "__weight"  # weight of one row
COPIES = "__copies"  # number of identical rows
LOW = "__low"  # first position of a row's interval
LAST = "__last"  # last position of a row's interval
CELL = "__cell"  # grid cell of a position
PARTS = "__parts"  # number of grid cells in a group
SITE = "site"

PREFIX = "__"


def check_user_columns(columns) -> None:
    bad = [c for c in columns if c.startswith(PREFIX)]
    if bad:
        raise ValueError(f"column names starting with {PREFIX!r} are reserved: {bad}")
    if len(set(columns)) != len(list(columns)):
        raise ValueError(f"duplicate column names: {list(columns)}")


def output_columns(tables) -> list[dict[str, str]]:
    """Output name of each column; a name in two tables gets the table's prefix."""
    seen: dict[str, int] = {"draw_id": 1}
    for table in tables:
        for c in table.df.columns:
            seen[c] = seen.get(c, 0) + 1
    names = [{c: c if seen[c] == 1 else f"{t.name}_{c}" for c in t.df.columns} for t in tables]
    flat = [n for columns in names for n in columns.values()]
    if len(set(flat)) != len(flat):
        raise ValueError("give the tables of a join different names")
    return names
