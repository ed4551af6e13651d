"""Articles and questions from tables, and the inverted index over titles."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequery.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder in spark.checkpoint.dir and read back, so that several branches read it once computed.

    Only on a local master a folder of its own is made if none is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def first_filled(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several table paths that holds a row."""
    for path in paths:
        try:
            found = spark.read.parquet(path)
        except Exception as error:  # a path that is not there
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            continue
        if not found.isEmpty():
            return found
    raise ValueError(f"no table with rows among {paths}")


def page_articles(pages: DataFrame) -> DataFrame:
    """(article_id, title, url): narrow, without the html, which joins late."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select(F.col("page_id").alias("article_id"), title.alias("title"), "url")


def plain_articles(documents: DataFrame) -> DataFrame:
    """(article_id, title): the text before the first full stop of a document's first line."""
    first = F.substring_index(F.substring_index("text", "\n", 1), ".", 1)
    return documents.select(F.col("doc_id").alias("article_id"), first.alias("title"))


def benchmark_questions(benchmark: DataFrame) -> DataFrame:
    """(q_id, question): the first sentence of each item."""
    return benchmark.select(F.col("item_id").alias("q_id"), F.substring_index("text", ".", 1).alias("question"))


def user_turns(conversations: DataFrame) -> DataFrame:
    return conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))


def title_index(articles: DataFrame) -> DataFrame:
    """(token, article_id, title, url): one row for each different word of a title."""
    return articles.select(F.explode(F.array_distinct(T.norm_tokens(F.col("title")))).alias("token"), *articles.columns)


def body_index(texts: DataFrame, articles: DataFrame) -> DataFrame:
    """(token, article_id, title, url): one row for each different word of an article's text, out of (article_id, text) and articles."""
    words = texts.select("article_id", F.explode(F.array_distinct(T.norm_tokens(F.col("text")))).alias("token"))
    return words.join(articles, "article_id").select("token", *articles.columns)


def model_names(listing: str | dict | list) -> list[str]:
    """Model names in server order from either shape of listing, an object or JSON; none if it has neither."""
    data = json.loads(listing) if isinstance(listing, str) else listing
    rows = data.get("models", []) if isinstance(data, dict) else data if isinstance(data, list) else []
    return [name for r in rows if isinstance(r, dict) and (name := r.get("model") or r.get("name"))]
