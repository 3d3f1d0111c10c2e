"""Identity keys of records: from addresses and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.text import fold as nfkc
from oppflow.functions.text import ascii_edges, normalize_text, strip_marks


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def url_domain(url: Column) -> Column:
    """Host without ``www.``, lower-cased; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(_text(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def _path(url: Column) -> Column:
    return F.regexp_extract(_text(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def clean_url(url: Column) -> Column:
    """Host and path only, lower-cased, without a slash at the end."""
    u = F.trim(_text(url))
    whole = F.lower(F.concat(url_domain(u), _path(u)))
    rest = F.regexp_replace(F.lower(u), r"[?#].*", "")
    return F.regexp_replace(F.when(url_domain(u) != "", whole).otherwise(rest), r"/$", "")


def path_segments(url: Column) -> Column:
    return F.filter(F.split(_path(url), "/"), lambda s: s != "")


def program_path_key(url: Column) -> Column:
    """Path of at least two segments, without years; empty for shorter ones."""
    k = F.lower(F.array_join(path_segments(url), "/"))
    k = F.regexp_replace(F.regexp_replace(k, r"(?<!\w)20\d{2}(?!\w)", ""), "-{2,}", "-")
    k = F.regexp_replace(F.regexp_replace(F.regexp_replace(k, "-/", "/"), "/-", "/"), "-$", "")
    return F.when(F.size(path_segments(url)) >= 2, k).otherwise("")


def is_aggregator(domain: Column) -> Column:
    return domain.isin(fixed.AGGREGATOR_HOSTS) | domain.rlike(r"(^|\.)linkedin\.com$")


def year_of(title: Column) -> Column:
    """First 20xx in a title, or null."""
    return F.nullif(F.regexp_extract(_text(title), r"(?<!\w)(20\d{2})(?!\w)", 1), F.lit(""))


def acronyms(folded: Column, programs_only: bool = False) -> Column:
    """Capital words of a folded title; none for a headline all in capitals."""
    found = F.regexp_extract_all(folded, F.lit(r"(?<!\w)([A-Z]{3,})(?!\w)"), F.lit(1))
    drop = fixed.GENERIC_ACRONYMS + (fixed.INSTITUTION_ACRONYMS if programs_only else [])
    headline = ~folded.rlike("[a-z]") & (F.size(found) >= 3)
    return F.when(headline, F.array().cast("array<string>")).otherwise(F.filter(found, lambda a: ~a.isin(drop)))


def word_list(folded: Column) -> Column:
    """Words of four letters or more that tell titles apart, in order."""
    t = F.regexp_replace(strip_marks(F.lower(folded)), r"(?<!\w)\d{4}(?!\w)", "")
    words = F.split(F.regexp_replace(t, r"[^\w\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(fixed.TITLE_STOP))


def title_words(folded: Column) -> Column:
    """The same as a set."""
    return F.array_distinct(word_list(folded))


def squash(folded: Column) -> Column:
    """A title's letters and digits, without years and a leading article."""
    t = F.regexp_replace(strip_marks(F.lower(folded)), r"(?<!\w)20\d{2}(?!\w)", "")
    return F.regexp_replace(F.regexp_replace(t, r"^the\s+", ""), "[^a-z0-9]+", "")


def expand_acronyms(title: Column) -> Column:
    """Spelled-out names as acronyms, the first of each."""
    t = _text(title)
    for short, phrase in fixed.GLOSSARY:
        t = F.regexp_replace(t, f"(?s)^(.*?)(?i:{ascii_edges(phrase)})", f"$1{short}")
    return t


def residual_words(expanded: Column, shared: Column) -> Column:
    """Sorted distinct words of an expanded title beyond filler and acronyms."""
    t = F.regexp_replace(strip_marks(F.lower(expanded)), r"(?<!\w)20\d{2}(?!\w)", "")
    low = F.transform(shared, F.lower)
    return F.array_sort(F.array_distinct(F.filter(F.split(t, "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(fixed.RESIDUAL_FILLER) & ~F.array_contains(low, w))))


def variant_tokens(squashed: Column, cleaned_url: Column) -> Column:
    """Marks of a sibling program in title or address."""
    s = F.concat(squashed, F.regexp_replace(cleaned_url, "[^a-z0-9]", ""))
    return F.filter(F.array(*map(F.lit, fixed.VARIANT_MARKERS)), lambda m: F.contains(s, m))


def fingerprint(title: Column, url: Column, compat: bool = True) -> Column:
    """The stored identity key: host and year, or acronyms, words and year where the host says nothing; may be empty."""
    t = nfkc(_text(title)) if compat else _text(title)
    domain, year = url_domain(url), F.coalesce(year_of(title), F.lit(""))
    part = F.array_join(F.slice(F.concat(F.slice(acronyms(t), 1, 2), F.slice(word_list(t), 1, 5)), 1, 5), "-")
    own = F.concat(F.lit("|"), part, F.lit("|"), year)
    return F.when((domain != "") & ~is_aggregator(domain), F.concat(domain, F.lit("||"), year)).when(F.length(own) > 3, own).otherwise("")


def identity_key(fp: Column, url: Column) -> Column:
    return F.when(F.length(fp) > 3, fp).otherwise(F.nullif(url, F.lit("")))


def research_key(fp: Column, rid: Column) -> Column:
    return F.when(F.length(fp) > 3, F.concat(F.lit("fp:"), fp)).otherwise(F.concat(F.lit("id:"), rid.cast("string")))


def content_fingerprint(source: Column, text: Column) -> Column:
    """SHA-256 of source and normalised text."""
    return F.sha2(F.concat(_text(source), F.lit("|"), normalize_text(text)).cast("binary"), 256)


def surrogate_id(*c: Column) -> Column:
    """SHA-256 of the first of the columns that is not empty."""
    return F.sha2(F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit("")).cast("binary"), 256)
