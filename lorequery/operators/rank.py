"""Relevance, top-k, shortlists and the deterministic selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequery.functions import match as M
from lorequery.functions import text as T
from lorequery.functions.lexicon import DEFAULT_DEPTH, DEPTHS, SHORTLIST, SHORTLIST_EMPTY

OF = "q_id"


def score(candidates: DataFrame) -> DataFrame:
    """candidates with an additive integer score; they carry title, abstract, keywords and phrases."""
    title, abstract = F.col("title"), F.coalesce(F.col("abstract"), F.lit(""))
    phrase = F.coalesce(M.matches_phrase(title, F.col("phrases")), F.lit(False))
    any_phrase = F.max(F.col("phrase_hit").cast("int")).over(Window.partitionBy(OF)) == 1
    keyword = M.matches_keywords(title, F.col("keywords"))
    has_keywords = F.size("keywords") > 0
    points = (
        F.when(T.is_media(title), 100).otherwise(0)
        - F.when(T.is_list_page(title), 50).otherwise(0)
        - F.when(T.is_disambiguation(title) | T.is_index(title), 40).otherwise(0)
        + F.when(any_phrase, F.when(F.col("phrase_hit"), 200).otherwise(-90)).otherwise(0)
        + F.when(F.length(abstract) > 200, 20).when(F.length(abstract) > 100, 10).otherwise(0)
        + F.when(has_keywords & M.abstract_hit(abstract, F.col("keywords")), 25).otherwise(0)
        + F.when(F.length(title) < 30, 5).otherwise(0)
        + F.when(has_keywords, F.when(keyword, 80).otherwise(-60)).otherwise(0)
    )
    return candidates.withColumn("phrase_hit", phrase).withColumn("score", points.cast("int")).drop("phrase_hit")


def rank(scored: DataFrame) -> DataFrame:
    """rank from 1 by descending score; ties keep their position. Questions with no more candidates than depth keep theirs."""
    window = Window.partitionBy(OF)
    small = F.count("*").over(window) <= F.col("depth")
    by_score = F.row_number().over(window.orderBy(F.desc("score"), "pos"))
    by_pos = F.row_number().over(window.orderBy("pos"))
    return scored.withColumn("bypass", small).withColumn("rank", F.when(F.col("bypass"), by_pos).otherwise(by_score).cast("int"))


def shortlist(ranked: DataFrame) -> DataFrame:
    """(q_id, display_no, rank, title, line): what a model gets to choose from.

    Of the first ranks, those with an abstract and its preview and others by title, but
    for list pages without abstract; where nothing is left, the first titles.
    """
    top = ranked.filter(F.col("rank") <= SHORTLIST)
    abstract = F.coalesce(F.col("abstract"), F.lit(""))
    line = F.when(F.length(abstract) > 30, F.concat("title", F.lit(" - "), T.preview(abstract))).when(~T.is_list_page(F.col("title")), F.concat("title", F.lit(" (main article)")))
    lined = top.withColumn("line", line)
    none = F.max(F.col("line").isNotNull().cast("int")).over(Window.partitionBy(OF)) == 0
    kept = lined.withColumn("none", none).withColumn("line", F.when(F.col("none") & (F.col("rank") <= SHORTLIST_EMPTY), F.col("title")).otherwise(F.col("line")))
    kept = kept.filter(F.col("line").isNotNull())
    return kept.withColumn("display_no", F.row_number().over(Window.partitionBy(OF).orderBy("rank")).cast("int")).select(OF, "display_no", "rank", "title", "line")


def parse_selection(answers: DataFrame, shown: DataFrame, target: Column) -> DataFrame:
    """(q_id, pick, rank): the known numbers of an answer in order, each once, no more than target.

    answers: (q_id, answer, ...); shown: (q_id, display_no, rank).
    """
    said = answers.select(OF, target.alias("target"), F.posexplode(T.integers(F.col("answer"))).alias("at", "display_no"))
    known = said.join(shown, [OF, "display_no"])
    once = known.groupBy(OF, "display_no", "rank", "target").agg(F.min("at").alias("at"))
    pick = F.row_number().over(Window.partitionBy(OF).orderBy("at"))
    return once.withColumn("pick", pick.cast("int")).filter(F.col("pick") <= F.col("target")).select(OF, "pick", "rank")


def fallback_select(ranked: DataFrame) -> DataFrame:
    """(…, pick): the selection without a model. Each filter holds only where something is left.

    Junk titles go; then titles without the keywords, first among the rest, then among
    all; then titles without a phrase; then the first of the rank stay. Questions with
    no more candidates than depth keep all.
    """
    window = Window.partitionBy(OF)
    any_ = lambda name: F.max(F.col(name).cast("int")).over(window) == 1
    title = F.col("title")
    has_keywords, has_phrases = F.size("keywords") > 0, F.size("phrases") > 0
    flags = ranked.withColumn("clean", ~M.is_junk(title)).withColumn("kw", M.matches_keywords(title, F.col("keywords")))
    flags = flags.withColumn("ph", F.coalesce(M.matches_phrase(title, F.col("phrases")), F.lit(False))).withColumn("clean_kw", F.col("clean") & F.col("kw"))
    a = flags.withColumn(
        "a", F.when(has_keywords, F.when(any_("clean_kw"), F.col("clean_kw")).when(any_("kw"), F.col("kw")).otherwise(F.col("clean"))).otherwise(F.col("clean"))
    ).withColumn("a_ph", F.col("a") & F.col("ph"))
    b = a.withColumn("b", F.when(has_phrases & any_("a_ph"), F.col("a_ph")).otherwise(F.col("a")))
    c = b.withColumn("c", F.when(any_("b"), F.col("b")).otherwise(F.lit(True)) | F.col("bypass")).filter("c")
    picked = c.withColumn("pick", F.row_number().over(window.orderBy("rank")).cast("int")).filter(F.col("bypass") | (F.col("pick") <= F.col("depth")))
    return picked.select(*ranked.columns, "pick")


def depth_of(selected: Column) -> Column:
    """Paragraphs to read of each article, by the number of articles selected."""
    table = F.create_map(*[F.lit(x) for item in DEPTHS.items() for x in item])
    return F.coalesce(F.try_element_at(table, selected.cast("int")), F.lit(DEFAULT_DEPTH))
