"""Length-bounded contents and abstracts out of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequery.functions import text as T
from lorequery.functions.lexicon import ABSTRACT_LEAST, CONTENT_LENGTH, PARAGRAPH_LEAST


def plain_paragraphs(documents: DataFrame) -> DataFrame:
    """(article_id, para_pos, paragraph): the lines of plain articles."""
    return documents.select(F.col("doc_id").alias("article_id"), F.posexplode(F.split("text", "\n")).alias("para_pos", "paragraph"))


def budget(paragraphs: DataFrame, limit: Column | int | None = None, length: int = CONTENT_LENGTH, least: int = PARAGRAPH_LEAST) -> DataFrame:
    """The paragraphs that are read: of the first `limit`, those over `least`, until one would pass the length.

    The running sum only grows, so a window keeps what a stop at the first overrun would.
    """
    rows = paragraphs if limit is None else paragraphs.filter(F.col("para_pos") < limit)
    rows = rows.filter(F.length("paragraph") > least)
    running = F.sum(F.length("paragraph")).over(Window.partitionBy("article_id").orderBy("para_pos"))
    return rows.withColumn("running", running).filter(F.col("running") <= length)


def contents(kept: DataFrame) -> DataFrame:
    """(article_id, content): paragraphs in order, citations gone, white space collapsed."""
    ordered = F.array_sort(F.collect_list(F.struct("para_pos", "paragraph")))
    joined = F.array_join(F.transform(ordered, lambda x: x["paragraph"]), "\n\n")
    return kept.groupBy("article_id").agg(T.collapse_space(T.strip_citations(joined)).alias("content"))


def abstracts(paragraphs: DataFrame) -> DataFrame:
    """(article_id, abstract): the first paragraph over the least length, cut."""
    long = paragraphs.filter(F.length("paragraph") > ABSTRACT_LEAST)
    return long.groupBy("article_id").agg(T.truncate(F.min_by("paragraph", "para_pos")).alias("abstract"))


def number_sources(selected: DataFrame, found: DataFrame) -> DataFrame:
    """(q_id, cite_no, article_id, title, url, content): selected articles with a content, numbered densely."""
    with_text = selected.join(found, "article_id").filter(F.col("content") != "")
    number = F.row_number().over(Window.partitionBy("q_id").orderBy("pick"))
    return with_text.withColumn("cite_no", number.cast("int")).select("q_id", "cite_no", "article_id", "title", "url", "content")
