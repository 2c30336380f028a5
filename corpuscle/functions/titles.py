"""Page titles: normalisation, categories, media and disambiguation markers as column expressions."""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, functions as F


def _lines(name: str) -> list[str]:
    return [x for x in pkgutil.get_data(__package__, name).decode().split("\n") if x]


def _aliases(kind: str) -> dict[str, tuple[str, ...]]:
    """Names of a namespace by language; the file lists each name with the languages that use it."""
    out: dict[str, tuple[str, ...]] = {}
    for k, name, languages in (line.split("\t") for line in _lines("namespaces.tsv")):
        if k == kind:
            for language in languages.split():
                out[language] = (*out.get(language, ()), name)
    return out


#: Namespace aliases by language, besides the English names that all have; callers may pass their own.
CATEGORY_ALIASES: dict[str, tuple[str, ...]] = _aliases("category")
MEDIA_ALIASES: dict[str, tuple[str, ...]] = _aliases("media")
#: Lower-cased names of templates that mark a disambiguation page, in all languages.
DISAMBIGUATION_TEMPLATES: tuple[str, ...] = tuple(_lines("disambiguation.txt"))


def _prefixes(names: tuple[str, ...]) -> str:
    return "(?i)^(?:" + "|".join(re.escape(n) for n in names) + "):"


def category_pattern(language: str, aliases: dict[str, tuple[str, ...]] | None = None) -> str:
    return _prefixes(("Category", *(aliases or CATEGORY_ALIASES).get(language, ())))


def media_pattern(language: str, aliases: dict[str, tuple[str, ...]] | None = None) -> str:
    return _prefixes(("File", "Image", "Media", *(aliases or MEDIA_ALIASES).get(language, ())))


def normalize_title(title: Column) -> Column:
    """First letter in upper case, underscores as spaces; an empty title stays empty."""
    return F.replace(F.concat(F.upper(F.substring(title, 1, 1)), F.substring(title, 2, 2**31 - 1)), F.lit("_"), F.lit(" "))


def is_category_title(title: Column, language: str, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    return title.rlike(category_pattern(language, aliases))


def is_media_title(title: Column, language: str, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    return title.rlike(media_pattern(language, aliases))


def strip_category_prefix(text: Column, language: str, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    return F.regexp_replace(text, category_pattern(language, aliases), "")


def strip_quote_markup(text: Column) -> Column:
    """Drop every run of two or more apostrophes."""
    return F.regexp_replace(text, "''+", "")


def is_redirect(redirect: Column) -> Column:
    return F.coalesce(redirect != "", F.lit(False))


def is_disambiguation(wiki_text: Column, templates: tuple[str, ...] = DISAMBIGUATION_TEMPLATES) -> Column:
    """Whether any template in the text bears a disambiguation name."""
    names = F.regexp_extract_all(F.coalesce(wiki_text, F.lit("")), F.lit(r"\{\{\s*([^}|]+?)\s*(?:\||\})"), F.lit(1))
    known = F.array(*map(F.lit, templates))
    return F.exists(names, lambda n: F.array_contains(known, F.lower(n)))


def strip_disambiguator(title: Column) -> Column:
    """The title without a trailing ' (…)'."""
    return F.regexp_replace(title, r"\s\(.*\)$", "")
