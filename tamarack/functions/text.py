"""Column expressions over typed-in labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))


def plain(value: Column) -> Column:
    """Lower case, with full-width characters as plain ones."""
    return F.lower(F.translate(value, _WIDE, _PLAIN))


def letters(value: Column) -> Column:
    """Only the letters of a label, in lower case: ``Very Hard``, ``very-hard`` and ``VeryHard`` agree; null stays null."""
    return F.regexp_replace(plain(value), r"[^\p{L}]+", "")


def name_key(value: Column) -> Column:
    """The letters and the number of a name, however typed: ``M-11``, ``m０１１`` and `` m011`` agree; null where there is neither."""
    digits = F.regexp_replace(F.regexp_replace(plain(value), r"[^0-9]+", ""), r"^0+(?=.)", "")
    key = F.concat(letters(value), F.lit("|"), digits)
    return F.when(key != "|", key)


def _plain_sql(column: str) -> str:
    return f"translate({column}, '{_WIDE}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')"


def letters_sql(column: str) -> str:
    """SQL of ``letters``."""
    return rf"regexp_replace(lower({_plain_sql(column)}), '[^\p{{L}}]+', '', 'g')"


def name_key_sql(column: str) -> str:
    """SQL of ``name_key``."""
    digits = rf"regexp_replace(regexp_replace({_plain_sql(column)}, '[^0-9]+', '', 'g'), '^0+(.)', '\1')"
    return f"nullif({letters_sql(column)} || '|' || {digits}, '|')"
