"""Portable hashes: pure functions of their inputs, the same on every engine.

Draws and row order are derived from MD5 text digests, so a sample depends on
the data and the seed only, never on partitioning, task retries or the number
of executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_HEX_DIGITS = 15  # one hash word: 60 bits, fits a BIGINT
WORD_RANGE = 16**WORD_HEX_DIGITS
HASH_DIGITS = 32
WIDE_SQL = "DECIMAL(38,0)"
TRIES = 16


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def _word(text: str, number: int, as_type: str) -> str:
    start = 1 + number * WORD_HEX_DIGITS
    hex_word = f"substring(md5({text}), {start}, {WORD_HEX_DIGITS})"
    return f"CAST(conv({hex_word}, 16, 10) AS {as_type})"


def _text(parts: Sequence[str]) -> str:
    return f"concat_ws('|', {', '.join(f'CAST({p} AS STRING)' for p in parts)})"


def _told_apart(column: str) -> str:
    """Text of a value with its length, so that different rows give different texts."""
    value = f"CAST({quoted(column)} AS STRING)"
    return f"coalesce(concat(length({value}), ':', {value}), '-')"


def row_hash(columns: Sequence[str]) -> Column:
    """128-bit hash of the named columns, nulls included, as hexadecimal text."""
    return F.expr(f"md5(concat_ws('|', {', '.join(map(_told_apart, columns))}))")


def draw_position(seed: int, ids: Sequence[str], total: str, as_type: str) -> Column:
    """Hash of the seed and the named columns, uniform below ``total`` (SQL text).

    A 120-bit number modulo ``total``: for totals that fit a BIGINT the bias is
    below 2**-57. A larger total is drawn in two parts, the multiple of 2**60 and
    the rest, from separate hash words; a pair beyond the total is drawn again.
    At most one in nine is, so after ``TRIES`` attempts the bias is below 2**-50.
    Never null.
    """
    own = [quoted(i) for i in ids]
    position = wide_position(
        lambda attempt: _text([str(int(seed)), *own, *([f"'try{attempt}'"] if attempt else [])]),
        lambda text, i: _word(text, i, WIDE_SQL),
        f"CAST({total} AS {WIDE_SQL})",
        WIDE_SQL,
    )
    if as_type.upper() == "BIGINT":
        text = _text([str(int(seed)), *own])
        position = _modulo(_word(text, 0, WIDE_SQL), _word(text, 1, WIDE_SQL), f"CAST({total} AS {WIDE_SQL})", WIDE_SQL)
    return F.expr(f"coalesce(CAST({position} AS {as_type}), CAST(0 AS {as_type}))")


def _modulo(high: str, low: str, total: str, wide: str) -> str:
    return f"CAST({high} * {WORD_RANGE} + {low} AS {wide}) % {total}"


def wide_position(text, word, total: str, wide: str, quotient: str | None = None) -> str:
    """SQL text of a position below ``total``, in any engine.

    ``text(attempt)`` is the text to hash, ``word(text, i)`` its i-th word,
    ``quotient`` the total divided by 2**60, rounded down.
    """
    quotient = quotient or f"CAST(floor({total} / {WORD_RANGE}) AS {wide})"
    rest = f"({total} % {WORD_RANGE})"
    draws = []
    for attempt in range(1, TRIES + 1):
        other = text(attempt)
        high = f"({_modulo(word(other, 0), word(other, 1), f'({quotient} + 1)', wide)})"
        low = word(text(attempt + TRIES), 0)
        fits = f"{high} < {quotient} OR {high} = {quotient} AND {low} < {rest}"
        draws.append(f"CASE WHEN {fits} THEN CAST({high} * {WORD_RANGE} + {low} AS {wide}) END")
    plain = _modulo(word(text(0), 0), word(text(0), 1), total, wide)
    return f"CASE WHEN {total} < {1 << 63} THEN {plain} ELSE coalesce({', '.join([*draws, plain])}) END"
