"""Scalar text functions over columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorequery.functions.lexicon import ABSTRACT_LENGTH, PREVIEW_LENGTH

EDGE_MARKS = "?.,!:;'\""
REFERENCES = r"(?is)\n\s*\[?(References?|Sources?|Bibliography)\]?[:\-]?\s*(\n.*)?$"


def norm_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; other letters separate."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalize(text: Column) -> Column:
    return F.array_join(norm_tokens(text), " ")


def words(text: Column) -> Column:
    """Split at white space of any kind, without empty words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def drop_marks(text: Column) -> Column:
    """Delete ? , . wherever they stand."""
    return F.translate(text, "?,.", "")


def strip_edges(word: Column) -> Column:
    return F.btrim(word, F.lit(EDGE_MARKS))


def capitalize(word: Column) -> Column:
    """First character in title case, the rest lowered; for single words."""
    return F.initcap(word)


def is_capitalised(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def is_acronym(word: Column) -> Column:
    """Two to five characters, some upper-case letter and none in lower or title case."""
    return word.rlike(r"\p{Lu}") & ~word.rlike(r"[\p{Ll}\p{Lt}]") & F.length(word).between(2, 5)


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+\]", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def truncate(text: Column, n: int = ABSTRACT_LENGTH) -> Column:
    return F.substring(text, 1, n)


def preview(text: Column, n: int = PREVIEW_LENGTH) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def slug(title: Column) -> Column:
    return F.replace(title, F.lit(" "), F.lit("_"))


def file_name(question: Column) -> Column:
    """A question as the name of its output file."""
    return F.regexp_replace(question, "[^a-zA-Z]", "_")


def strip_references(answer: Column) -> Column:
    """Without a heading of references alone on its line and all after it, and without white space at the end."""
    return F.regexp_replace(F.regexp_replace(answer, REFERENCES, ""), r"(?U)\s+$", "")


def has_year(title: Column) -> Column:
    return title.rlike(r"\b(19|20)\d{2}\b")


def integers(text: Column) -> Column:
    """All runs of digits as numbers, in order; null where they overflow."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))


def is_list_page(title: Column) -> Column:
    low = F.lower(title)
    return low.startswith("list of") | low.startswith("lists of")


def is_disambiguation(title: Column) -> Column:
    return F.contains(F.lower(title), F.lit("disambiguation"))


def is_index(title: Column) -> Column:
    return F.contains(F.lower(title), F.lit("index of"))


def is_media(title: Column) -> Column:
    low = F.lower(title)
    from lorequery.functions.lexicon import MEDIA_SUFFIXES

    out = F.lit(False)
    for suffix in MEDIA_SUFFIXES:
        out = out | F.contains(low, F.lit(suffix.lower()))
    return out
