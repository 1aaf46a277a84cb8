"""Text cleaning, tokens, lexicon matches and labels.

Java's ``\\s`` and ``\\w`` are ASCII only; the classes below spell out the Unicode meaning. Texts
are long and mostly ASCII, so every pattern rejects an ASCII character with one cheap test
before it consults a Unicode class, and a pass that needs a rare marker ('@', 'http') only runs
on texts that contain it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitrep import constants as K

# --- fixed values: character classes ------------------------------------------
SPACE = (
    r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"\p{L}\p{N}_"
KEYCAP = r"[0-9#*]\x{FE0F}?\x{20E3}"
EMOJI = (
    r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}"
    r"\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{25AA}-\x{25FE}"
    r"\x{2934}\x{2935}\x{3030}\x{303D}\x{3297}\x{3299}\x{A9}\x{AE}\x{FE0F}\x{200D}]"
)
# the same classes behind a cheap first test
_EMOJI = rf"[\x{{A9}}-\x{{1FAFF}}&&{EMOJI}]"
_ODD_SPACE = rf"[\x00-\x1F\x{{85}}-\x{{3000}}&&[{SPACE}]]"
_NOT_WORD = rf"[\W&&[^{WORD}]]"
_NOT_WORD_OR_SPACE = rf"[\W&&[^{WORD}{SPACE}]]"


def _where_present(c: Column, marker: str, pattern: str) -> Column:
    """Delete a pattern, in the texts that contain its marker."""
    return F.when(F.contains(c, F.lit(marker)), F.regexp_replace(c, pattern, "")).otherwise(c)


def plain_spaces(c: Column) -> Column:
    """Any white space becomes a blank."""
    return F.regexp_replace(c, _ODD_SPACE, " ")


def strip_space(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def drop_keycaps(c: Column) -> Column:
    return _where_present(c, "\u20e3", KEYCAP)


def drop_emoji(c: Column) -> Column:
    return F.regexp_replace(drop_keycaps(c), _EMOJI, "")


def clean_text(c: Column) -> Column:
    """Post text without links, mentions, emoji and punctuation.

    Other emoji than keycaps need no pass of their own: none holds a letter or digit.
    """
    c = _where_present(c, "http", f"http[^{SPACE}]+")
    c = _where_present(c, "@", f"@[{WORD}]+")
    c = plain_spaces(drop_keycaps(c))
    c = F.regexp_replace(c, r"[[^\w ]_]+", "")
    return F.trim(F.regexp_replace(c, "  +", " "))


def clean_caption(c: Column) -> Column:
    """Caption text: emoji first, then links, tags and mentions; keeps ``.,!?``. Null is ''."""
    c = drop_emoji(F.coalesce(c, F.lit("")))
    links = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www"))
    c = F.when(links, F.regexp_replace(c, f"http[^{SPACE}]+|www[^{SPACE}]+", "")).otherwise(c)
    tags = F.contains(c, F.lit("@")) | F.contains(c, F.lit("#"))
    c = F.when(tags, F.regexp_replace(c, f"[@#][{WORD}]+", "")).otherwise(c)
    c = F.regexp_replace(plain_spaces(c), r"[[^\w .,!?]_]+", "")
    return F.trim(F.regexp_replace(c, "  +", " "))


def clean_hashtag(c: Column) -> Column:
    """One hashtag: lower case, no leading '#', blanks or punctuation."""
    return F.regexp_replace(F.lower(c), f"{_NOT_WORD}+", "")


def hashtag_list(c: Column) -> Column:
    """Comma-joined hashtags as a list of clean tags; empty or null gives an empty list."""
    filled = F.nullif(c, F.lit(""))
    return F.coalesce(
        F.transform(F.split(filled, ","), clean_hashtag), F.array().cast("array<string>")
    )


def tokens(c: Column) -> Column:
    """Lower-case alphabetic tokens without English and Malay stopwords."""
    stop = [*K.ENGLISH_STOPWORDS, *K.MALAY_STOPWORDS, ""]
    parts = F.split(F.lower(c), f"{_NOT_WORD}+")
    return F.filter(parts, lambda t: ~t.isin(stop) & t.rlike(r"^\p{L}+$"))


def tidy_topic(c: Column) -> Column:
    """A topic phrase in lower case without punctuation."""
    return strip_space(F.regexp_replace(F.lower(c), f"{_NOT_WORD_OR_SPACE}+", ""))


def keyword_text(value: Column) -> Column:
    """A list of keywords as one string, without empty items."""
    return F.array_join(F.filter(value, lambda k: k.isNotNull() & (k != "")), ", ")


def split_camel(c: Column) -> Column:
    """'KualaLumpur' -> 'kuala lumpur'; names containing 'Unknown' stay as they are."""
    spaced = strip_space(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")))
    return F.when(F.contains(c, F.lit("Unknown")) | (c == ""), c).otherwise(spaced)


def title_label(c: Column) -> Column:
    return F.initcap(c)


def hashtag_label(c: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.regexp_replace(c, f"[{SPACE}]+", "")))


# --- lexicon matching ------------------------------------------------------------
def factored(terms: Iterable[str]) -> str:
    """A choice of terms with common beginnings written once: a position in the text tries a few
    first letters instead of every term. The longest term wins: 'banjir kilat' over 'banjir'."""
    tree: dict = {}
    for term in set(terms):
        node = tree
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def write(node: dict) -> str:
        branches = [
            (ch if ch.isalnum() or ch in " _" else "\\" + ch) + write(node[ch])
            for ch in sorted(node)
            if ch
        ]
        if not branches:
            return ""
        if len(branches) == 1 and "" not in node:
            return branches[0]
        return "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")

    return write(tree)


def word_pattern(terms: Iterable[str], prefix: bool = False) -> str:
    """Terms as whole words, or as word beginnings when ``prefix``."""
    terms = set(terms)
    first = "".join(sorted({t[0] for t in terms}))
    tail = "" if prefix else rf"(?![\w{WORD}])"
    # the first letter is tested first: most places in a text fail there, before the look-behind
    return rf"(?=[{first}])(?<![\w{WORD}])({factored(terms)}){tail}"


def term_matches(c: Column, terms: Iterable[str], prefix: bool = False) -> Column:
    """All terms found, in text order: one pass over the text for the whole list."""
    return F.regexp_extract_all(F.lower(c), F.lit(word_pattern(terms, prefix)), F.lit(1))


def count_in(found: Column, terms: Iterable[str]) -> Column:
    """How many of the found terms belong to a list."""
    wanted = list(terms)
    return F.size(F.filter(found, lambda m: m.isin(wanted)))


def has_term(c: Column, terms: Iterable[str], prefix: bool = False) -> Column:
    return F.lower(c).rlike(word_pattern(terms, prefix))


def quoted(value: str | None) -> str:
    """A SQL string literal."""
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: Iterable[str | None]) -> Column:
    return F.expr("array(" + ", ".join(quoted(v) for v in values) + ")")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(quoted(x) for kv in pairs.items() for x in kv) + ")")


def normalise_terms(c: Column) -> Column:
    """Malay hazard terms, as whole words, replaced by their English type; text lower-cased.

    One pattern for all terms, the longest first. A text with terms is cut at them and joined
    again with what each stands for.
    """
    low, pattern = F.lower(c), word_pattern(K.MALAY_TERMS)
    to_type = literal_map(K.MALAY_TERMS)
    kinds = F.transform(
        F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda m: F.element_at(to_type, m)
    )
    with_kinds = F.zip_with(
        F.split(low, pattern), kinds, lambda piece, kind: F.concat(piece, F.coalesce(kind, F.lit("")))
    )
    return F.when(low.rlike(pattern), F.array_join(with_kinds, "")).otherwise(low)
