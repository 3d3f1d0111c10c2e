"""Text columns: normalisation, HTML to text, titles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from oppflow.functions import fixed

#: Letters with a diacritic and their base letters, by canonical decomposition, for Latin up to U+024F and U+1E00-1EFF.
_MARKED = [(chr(c), d) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)]


def ascii_edges(pattern: str) -> str:
    r"""The pattern with each ``\\b`` an edge of ASCII words, whatever the Java version takes for one."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def any_of(c: Column, pattern: str) -> Column:
    """Whether a pattern matches somewhere, in either case, accented letters too."""
    return F.coalesce(c, F.lit("")).rlike(f"(?iu){ascii_edges(pattern)}")


def normalize_text(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def strip_marks(c: Column) -> Column:
    """Latin letters without their diacritics."""
    return F.regexp_replace(F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)), r"[̀-ͯ]", "")


def normalize_for_match(c: Column) -> Column:
    """:func:`normalize_text` without diacritics."""
    return strip_marks(normalize_text(c))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def fold(c: Column) -> Column:
    """Compatibility forms to plain ones (NFKC). Only rows with letters beyond ASCII leave the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.pandas_udf(_nfkc, StringType())(c)).otherwise(F.coalesce(c, F.lit("")))


def clean_title(c: Column, compat: bool = True) -> Column:
    """Repair broken apostrophes and dashes, drop invisible characters, collapse white space."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(c, "â€™", "'")
    c = F.regexp_replace(c, "â€[\u0080-¿–-›™]?", " ")
    c = F.regexp_replace(c, "[  ​-‍﻿]", " ")
    c = F.trim(F.regexp_replace(c, r"[\s ]+", " "))
    return fold(c) if compat else c


def _without_element(c: Column, name: str) -> Column:
    """A page without the elements of a name, each up to its first end tag; one that never ends stays. The text is cut at the end tags, so none is searched for twice."""
    inner = lambda x: F.concat(F.regexp_replace(x, rf"(?is)<{name}\b.*$", ""), F.lit(" "))
    without = lambda cut: F.concat(F.array_join(F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), inner), ""), F.element_at(cut, -1))
    return let(F.split(c, rf"(?i)</{name}>", -1), without)


def html_to_text(c: Column, blocks: bool = False) -> Column:
    """Text of a page. ``blocks``: line ends for br, p, div, li and tr, bars between cells; else one line."""
    c = _without_element(_without_element(F.coalesce(c, F.lit("")), "style"), "script")
    if blocks:
        c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n")
        c = F.regexp_replace(c, r"(?i)</t[dh]>", " | ")
    # what stands after the last end of a tag holds none, and before it each tag ends
    ended = lambda x, rest: F.concat(F.regexp_replace(F.left(x, F.char_length(x) - F.char_length(rest)), r"(?s)<[^>]*>", " "), rest)
    c = let(c, lambda x: let(F.substring_index(x, ">", -1), lambda rest: ended(x, rest)))
    for name, ch in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    if not blocks:
        return F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n+", "\n\n"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-záéíóúñü0-9]+)"), F.lit(1))


def _none_of(words: list[str]):
    return lambda w: ~w.isin(words)


def identity_words(title: Column) -> Column:
    """Words of a title that could identify it."""
    return F.filter(_words(title), lambda w: (F.length(w) > 2) & ~w.isin(fixed.NAME_STOP + fixed.GENERIC_TITLE_WORDS) & ~w.rlike(r"^\d+$"))


def is_generic_title(title: Column) -> Column:
    """At most one identifying word."""
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & (F.size(identity_words(title)) <= 1)


def _significant(c: Column) -> Column:
    return F.filter(_words(c), lambda w: (F.length(w) > 2) & ~w.isin(fixed.NAME_STOP))


def funder_is_reliable(funder: Column, source: Column) -> Column:
    """A short single name that is not just the channel's own."""
    f = F.trim(F.coalesce(funder, F.lit("")))
    mine = _significant(f)
    return (F.length(f) >= 3) & ~f.rlike("[|,;]") & (F.length(f) <= 45) & (F.size(_words(f)) <= 6) & (F.size(mine) > 0) & (F.size(F.array_except(mine, _significant(source))) > 0)


def funder_appears_in(title: Column, funder: Column) -> Column:
    """The title already names the funder."""
    squash = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9áéíóúñü]", "")
    mine = _significant(funder)
    return (F.size(mine) == 0) | F.arrays_overlap(mine, _words(title)) | F.contains(squash(title), squash(funder)) | F.contains(squash(funder), squash(title))


def qualify_title(title: Column, funder: Column, source: Column) -> Column:
    """``Funder — Title`` where the title alone says too little and the funder is a reliable one."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when(is_generic_title(t) & funder_is_reliable(funder, source) & ~funder_appears_in(t, funder), F.concat(F.trim(funder), F.lit(" — "), t)).otherwise(t)


def first_valid_title(*candidates: Column) -> Column:
    """The first that is not empty and not a mere status word."""
    status = r"(?iu)^\s*(abiert[oa]s?|cerrad[oa]s?|open|closed|nuev[oa]|new|vigente|próximamente)\s*$"
    return F.coalesce(*[F.when((F.trim(c) != "") & ~c.rlike(status), F.trim(c)) for c in candidates])
