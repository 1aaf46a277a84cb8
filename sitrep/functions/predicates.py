"""Filter conditions with the null rules of a document store made explicit."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitrep import constants as K


def all_of(conditions: Iterable[Column | None]) -> Column:
    """Conjunction of the conditions that are present; none present keeps every row."""
    present = [c for c in conditions if c is not None]
    return functools.reduce(operator.and_, present, F.lit(True))


def missing_to_null(c: Column) -> Column:
    """'null', '', 'none', 'nan' and 'Unknown ...' become NULL."""
    text = F.lower(F.trim(c))
    marker = text.isin("null", "", "none", "nan", "unknown") | text.startswith("unknown ")
    return F.when(~marker, c)


def not_equal_or_null(c: Column, value: object) -> Column:
    """Not equal, where a null counts as different."""
    return ~c.eqNullSafe(F.lit(value))


def not_in_and_present(c: Column, values: Iterable[str]) -> Column:
    """Present and outside the list."""
    return c.isNotNull() & ~c.isin(list(values))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def in_days(c: Column, start: str | date | None = None, end: str | date | None = None) -> Column | None:
    """Inclusive day range. Half-open on the upper side, so it reaches the file scan."""
    conds = []
    if start is not None:
        conds.append(c >= F.lit(start).cast("date"))
    if end is not None:
        conds.append(c < F.date_add(F.lit(end).cast("date"), 1))
    return all_of(conds) if conds else None


def type_is(c: Column, wanted: str | None) -> Column | None:
    """Type equality on the normal form; ``None``, '' and 'all' mean no filter."""
    if not wanted or wanted.strip().lower() == "all":
        return None
    return c == normal_type(wanted)


def normal_type(wanted: str) -> str:
    """'forestFire' and 'Forest Fire' both mean 'forest fire'."""
    out = []
    for before, ch in zip(" " + wanted, wanted):
        if ch.isupper() and before.islower():
            out.append(" ")
        out.append(ch)
    return "".join(out).lower().strip()


def text_matches(c: Column, term: str, regex: bool = False) -> Column:
    """Case-insensitive search; plain text unless ``regex``."""
    if regex:
        return c.rlike("(?i)" + term)
    return F.contains(F.lower(c), F.lit(term.lower()))


def any_text_matches(cols: Iterable[Column], terms: str | list[str] | None, regex: bool = False) -> Column | None:
    """Any column matches any of the terms."""
    if not terms:
        return None
    wanted = [terms] if isinstance(terms, str) else list(terms)
    hits = [text_matches(c, t, regex) for c in cols for t in wanted]
    return functools.reduce(operator.or_, [F.coalesce(h, F.lit(False)) for h in hits])


def not_authority(
    verified: Column, verification_type: Column, professional_type: Column, followers: Column
) -> Column:
    """Ordinary accounts only: not verified, no badge, not a business, few followers."""
    return ~(
        F.coalesce(verified, F.lit(False))
        | (F.coalesce(verification_type, F.lit("null")) != "null")
        | F.coalesce(professional_type.isin("Business", "Creator"), F.lit(False))
        | (F.coalesce(followers, F.lit(0)) > K.MAX_FOLLOWERS)
    )


def min_text(c: Column, n: int) -> Column:
    """At least ``n`` characters; null fails."""
    return F.coalesce(F.length(c) >= n, F.lit(False))


def valid_coordinates(c: Column) -> Column:
    """An array of exactly two numbers."""
    return F.coalesce(
        (F.size(c) == 2) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)
    )
