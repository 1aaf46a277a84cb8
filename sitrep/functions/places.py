"""Place names: mentions, canonical spellings, bounding box, fuzzy matching."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep.functions.text import literal_map


def mentions_any(c: Column, names: Iterable[str] = K.PLACE_KEYWORDS) -> Column:
    """The lower-cased text contains one of the names; null and '' do not.

    Written over a one-element array so that the text is lower-cased once, not once per name.
    """
    names = list(names)

    def hit(low: Column) -> Column:
        return functools.reduce(operator.or_, [F.contains(low, F.lit(n)) for n in names])

    return F.coalesce(F.exists(F.array(F.lower(c)), hit), F.lit(False))


def any_mentions(cols: Iterable[Column], names: Iterable[str] = K.PLACE_NAMES) -> Column:
    """Any of the columns mentions one of the names."""
    names = list(names)
    return functools.reduce(operator.or_, [mentions_any(c.cast("string"), names) for c in cols])


def in_bounding_box(lat: Column, lon: Column) -> Column:
    lat_n, lon_n = lat.cast("string").try_cast("double"), lon.cast("string").try_cast("double")
    return F.coalesce(
        lat_n.between(K.LAT_MIN, K.LAT_MAX) & lon_n.between(K.LON_MIN, K.LON_MAX), F.lit(False)
    )


def state_map(extra: bool = True) -> dict[str, str]:
    return {**K.STATE_DISPLAY, **(K.STATE_DISPLAY_EXTRA if extra else {})}


def canonical_state(c: Column) -> Column:
    """Display name of a state alias; other names are kept."""
    return F.coalesce(F.try_element_at(literal_map(state_map()), F.lower(F.trim(c))), c)


def is_known_state(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(K.STATE_WHITELIST), F.lit(False))


def fuzzy_limit(term: str) -> int:
    """Edit distance allowed for a term: 0, 1 or 2 by length (<=2, 3-5, >5)."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def fuzzy_place(cols: Iterable[Column], wanted: str | None) -> Column | None:
    """Some word of ``wanted`` is close to some word of a column. 'malaysia' means anywhere."""
    if not wanted or wanted.strip().lower() == "malaysia":
        return None
    # one rule splits both sides, so 'port-dickson' is 'port dickson'; without words no filter
    terms = re.findall(r"[^\W_]+", wanted.lower())
    if not terms:
        return None

    def near(words: Column, term: str) -> Column:
        k = fuzzy_limit(term)
        close = F.exists(
            words, lambda w: (w != "") & (F.levenshtein(w, F.lit(term), k) >= 0)
        )
        return F.coalesce(close, F.lit(False))

    word_lists = [F.split(F.lower(c), r"[^\p{L}\p{N}]+") for c in cols]
    hits = [near(words, term) for words in word_lists for term in terms]
    return functools.reduce(operator.or_, hits)


def grid_cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)))
