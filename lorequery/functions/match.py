"""Predicates between questions and titles or abstracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorequery.functions import text as T


def keyword_hits(title: Column, keywords: Column) -> Column:
    """Keywords whose normalised form is inside the normalised title."""
    name = T.normalize(title)
    return F.size(F.filter(keywords, lambda k: (T.normalize(k) != "") & F.contains(name, T.normalize(k))))


def matches_keywords(title: Column, keywords: Column) -> Column:
    """True without keywords; else two hits, or one where there are fewer than three keywords."""
    need = F.when(F.size(keywords) >= 3, 2).otherwise(1)
    return (F.size(keywords) == 0) | (keyword_hits(title, keywords) >= need)


def matches_phrase(title: Column, phrases: Column) -> Column:
    """Whether the words of some phrase occur in the title in order, gaps allowed."""
    name = T.normalize(title)
    pattern = lambda p: F.concat(F.lit("(^| )"), F.replace(T.normalize(p), F.lit(" "), F.lit("( .*)? ")), F.lit("( |$)"))
    return F.exists(phrases, lambda p: (T.normalize(p) != "") & F.regexp_like(name, pattern(p)))


def abstract_hit(abstract: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(F.lower(F.coalesce(abstract, F.lit(""))), k))


def is_junk(title: Column) -> Column:
    """List, dated and disambiguation pages."""
    return T.is_list_page(title) | T.has_year(title) | T.is_disambiguation(title)
