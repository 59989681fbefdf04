"""Case- and accent-insensitive matching as built-in column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# Accented letters and the plain letter each one matches.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"
_TABLE = str.maketrans(ACCENTED, PLAIN)


def fold(col: Column | str) -> Column:
    """Lower-case and strip accents, so 'Pão' and 'PAO' become equal."""
    col = F.col(col) if isinstance(col, str) else col
    return F.translate(F.lower(col), ACCENTED, PLAIN)


def fold_text(text: str) -> str:
    """The same folding for a literal."""
    return text.lower().translate(_TABLE)


def fold_key(col: Column | str) -> Column:
    """Folding for equality: trailing blanks do not count either."""
    col = F.col(col) if isinstance(col, str) else col
    return fold(F.rtrim(col))


def same_text(col: Column | str, text: str) -> Column:
    return fold_key(col) == F.lit(fold_text(text.rstrip(" ")))


def contains_any(cols: list[str], text: str) -> Column:
    """True when any column holds ``text``; NULL columns are simply no match.

    The search text is taken literally: ``%`` and ``_`` are ordinary characters.
    """
    needle = F.lit(fold_text(text))
    return reduce(or_, (F.coalesce(fold(c).contains(needle), F.lit(False)) for c in cols))


def distinct_text(df: DataFrame, name: str) -> DataFrame:
    """The sorted values of a text column; values equal but for case or accents are one."""
    spellings = df.select(name).distinct()
    groups = spellings.groupBy(fold_key(name).alias("_key")).agg(F.min(name).alias(name))
    return groups.orderBy("_key").select(name)
