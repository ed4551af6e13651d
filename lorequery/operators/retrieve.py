"""Retrieval: term search through the title index, lookups, first-wins dedup, and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequery.functions import match as M
from lorequery.functions import text as T
from lorequery.functions.lexicon import ABSTRACTS, MEDIA_SUFFIXES, SOFT_CAP
from lorequery.sources.corpus import settle

LOOKUP_TERMS = 3


def explode_terms(understood: DataFrame) -> DataFrame:
    """(q_id, term_pos, term, depth)."""
    return understood.select("q_id", "depth", F.posexplode("terms").alias("term_pos", "term"))


def search(terms: DataFrame, index: DataFrame, limit=None, bodies: DataFrame | None = None) -> DataFrame:
    """(q_id, term_pos, rank, article_id, title, url, search_score): the best articles of each term.

    terms and articles meet on words, never pair by pair. Score: the whole title 1000, its
    beginning 100, each different word in the title 10, and with bodies, (token,
    article_id, title, url) of the articles' texts, each different word in the text 1;
    ties by title length, then id. limit: a number or column, by default the question's depth.
    """
    limit = F.col("depth") if limit is None else F.lit(limit) if isinstance(limit, int) else limit
    asked = terms.select("q_id", "term_pos", "term", "depth", F.explode(F.array_distinct(T.norm_tokens(F.col("term")))).alias("token"))
    both = index.withColumn("points", F.lit(10))
    if bodies is not None:
        both = both.unionByName(bodies.withColumn("points", F.lit(1)))
    hit = asked.join(both, "token").groupBy("q_id", "term_pos", "term", "depth", "article_id", "title", "url").agg(F.sum("points").alias("points"))
    name, term = T.normalize(F.col("title")), T.normalize(F.col("term"))
    score = F.when(name == term, 1000).otherwise(0) + F.when(F.startswith(name, term), 100).otherwise(0) + F.col("points")
    order = Window.partitionBy("q_id", "term_pos").orderBy(F.desc("search_score"), F.length("title"), "article_id")
    ranked = hit.withColumn("search_score", score.cast("int")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit).select("q_id", "term_pos", "rank", "article_id", "title", "url", "search_score")


def first_wins(found: DataFrame) -> DataFrame:
    """The earliest result of each title, case apart, of each question."""
    order = Window.partitionBy("q_id", F.lower("title")).orderBy("term_pos", "rank")
    return found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def soft_cap(found: DataFrame, cap: int = SOFT_CAP) -> DataFrame:
    """Terms go on as long as fewer than cap results stand before them; the last may overshoot."""
    before = F.count("*").over(Window.partitionBy("q_id").orderBy("term_pos").rangeBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", before).filter(F.col("before") < cap).drop("before")


def direct_lookup(terms: DataFrame, articles: DataFrame, seen: DataFrame) -> DataFrame:
    """(q_id, term_pos, article_id, title, url): articles titled as one of the first terms and not seen yet."""
    asked = terms.filter(F.col("term_pos") < LOOKUP_TERMS).select("q_id", "term_pos", F.col("term").alias("title"))
    hit = asked.join(articles, "title").select("q_id", "term_pos", "article_id", "title", "url")
    return _unseen(hit, seen)


def _unseen(hit: DataFrame, seen: DataFrame) -> DataFrame:
    known = seen.select(F.col("q_id").alias("s_q"), F.lower("title").alias("s_title")).distinct()
    return hit.join(known, (F.col("q_id") == F.col("s_q")) & (F.lower("title") == F.col("s_title")), "left_anti")


def media_lookup(terms: DataFrame, articles: DataFrame, seen: DataFrame) -> DataFrame:
    """Of the first terms, the first media variant of each that exists and is not seen."""
    suffixes = F.posexplode(F.array(*map(F.lit, MEDIA_SUFFIXES))).alias("suffix_pos", "suffix")
    asked = terms.filter(F.col("term_pos") < LOOKUP_TERMS).select("q_id", "term_pos", "term", suffixes)
    hit = asked.withColumn("title", F.concat("term", "suffix")).join(articles, "title")
    first = Window.partitionBy("q_id", "term_pos").orderBy("suffix_pos", "article_id")
    found = _unseen(hit, seen).withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return found.select("q_id", "term_pos", "article_id", "title", "url")


def merge(found: DataFrame, media: DataFrame, direct: DataFrame) -> DataFrame:
    """(q_id, pos, article_id, title, url): direct hits, later terms first, then media hits alike, then the rest."""
    sides = (
        direct.select("q_id", F.lit(0).alias("side"), (-F.col("term_pos")).alias("a"), F.lit(0).alias("b"), "article_id", "title", "url")
        .unionByName(media.select("q_id", F.lit(1).alias("side"), (-F.col("term_pos")).alias("a"), F.lit(0).alias("b"), "article_id", "title", "url"))
        .unionByName(found.select("q_id", F.lit(2).alias("side"), F.col("term_pos").alias("a"), F.col("rank").alias("b"), "article_id", "title", "url"))
    )
    once = Window.partitionBy("q_id", F.lower("title")).orderBy("side", "a", "b", "article_id")
    kept = sides.withColumn("nth", F.row_number().over(once)).filter("nth = 1")
    pos = F.row_number().over(Window.partitionBy("q_id").orderBy("side", "a", "b", "article_id")) - 1
    return kept.withColumn("pos", pos.cast("int")).select("q_id", "pos", "article_id", "title", "url")


def prioritise(candidates: DataFrame) -> DataFrame:
    """pos renewed: titles with a phrase first, then with the keywords, else as before.

    candidates carry keywords and phrases; an empty list changes nothing.
    """
    phrase = F.coalesce(M.matches_phrase(F.col("title"), F.col("phrases")), F.lit(False)).cast("int")
    keyword = F.when(F.size("keywords") > 0, M.matches_keywords(F.col("title"), F.col("keywords")).cast("int")).otherwise(0)
    order = Window.partitionBy("q_id").orderBy(F.desc(phrase), F.desc(keyword), "pos")
    return candidates.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def with_abstracts(candidates: DataFrame, abstracts: DataFrame, first: int = ABSTRACTS) -> DataFrame:
    """The first candidates with their abstracts ('' where an article has none), the others with null."""
    early = candidates.filter(F.col("pos") < first).select("article_id").distinct()
    wanted = abstracts.join(early, "article_id", "left_semi")
    joined = candidates.join(wanted, "article_id", "left")
    return joined.withColumn("abstract", F.when(F.col("pos") < first, F.coalesce("abstract", F.lit("")))).select(*candidates.columns, "abstract")


def candidates(understood: DataFrame, articles: DataFrame, index: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(q_id, pos, article_id, title, url, keywords, phrases, depth): all retrieval steps in order.

    What several steps read, a few rows a question, is settled, so that it is searched once.
    """
    terms = explode_terms(understood)
    found = settle(soft_cap(first_wins(search(terms, index, bodies=bodies))))
    media = settle(media_lookup(terms, articles, found))
    direct = direct_lookup(terms, articles, found.select("q_id", "title").unionByName(media.select("q_id", "title")))
    listed = merge(found, media, direct)
    return prioritise(listed.join(understood.select("q_id", "keywords", "phrases", "depth"), "q_id"))
