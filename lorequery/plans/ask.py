"""From questions to answers: one plan over all questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequery.functions.lexicon import SELECTION_OPTIONS, SYNTHESIS_OPTIONS
from lorequery.functions.understand import understand
from lorequery.operators import assemble, content, html, models, rank, retrieve
from lorequery.sources import corpus


def page_bodies(pages: DataFrame) -> DataFrame:
    """The words of the pages' paragraphs, as corpus.body_index gives them; for many calls of ask, write it and read it back."""
    texts = html.explode_paragraphs(pages).select("article_id", F.col("paragraph").alias("text"))
    return corpus.body_index(texts, corpus.page_articles(pages)).distinct()


def ranked(understood: DataFrame, pages: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(q_id, ..., rank): scored candidates of all questions. Html joins only for the articles that need an abstract.

    Articles without either of the content containers have their abstract out of the
    body, an extension: the definition has none there.
    """
    articles = corpus.page_articles(pages)
    found = corpus.settle(retrieve.candidates(understood, articles, corpus.title_index(articles), bodies))
    early = found.filter(F.col("pos") < retrieve.ABSTRACTS).select(F.col("article_id").alias("page_id")).distinct()
    abstracts = content.abstracts(html.explode_paragraphs(pages.join(early, "page_id", "left_semi")))
    return rank.rank(rank.score(retrieve.with_abstracts(found, abstracts)))


def ask(questions: DataFrame, pages: DataFrame, backend=None, model: str = "none", max_results: int | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """(q_id, question, answer, sources, model): one row for each question that is not null.

    Without a backend, articles are selected by rule and answers are extractive.
    max_results: articles of each search and of each answer, by default the question's
    depth; bodies: words of the articles' texts (page_bodies), else titles are searched.
    """
    understood = understand(questions)
    if max_results is not None:
        understood = understood.withColumn("depth", F.lit(int(max_results)))
    understood = corpus.settle(understood)
    found = corpus.settle(ranked(understood, pages, bodies))
    picked = rank.fallback_select(found)
    if backend is not None:
        shown = rank.shortlist(found.filter(~F.col("bypass")))
        prompts = assemble.selection_prompts(shown, understood)
        said = models.chat(prompts, backend, SELECTION_OPTIONS).join(understood.select("q_id", "depth"), "q_id")
        chosen = rank.parse_selection(said, shown.select("q_id", "display_no", "rank"), F.col("depth"))
        by_model = found.join(chosen, ["q_id", "rank"]).select(*found.columns, "pick")
        picked = by_model.unionByName(picked.join(by_model.select("q_id").distinct(), "q_id", "left_anti"))
    count = F.count("*").over(rank.Window.partitionBy("q_id"))
    picked = corpus.settle(picked.withColumn("paragraphs", rank.depth_of(count)))
    need = picked.groupBy(F.col("article_id").alias("page_id")).agg(F.max("paragraphs").alias("most"))
    parts = html.explode_paragraphs(pages.join(need, "page_id", "left_semi"))
    sliced = picked.select("q_id", "article_id", "paragraphs").join(parts, "article_id").filter(F.col("para_pos") < F.col("paragraphs"))
    # the same article may be read to another depth for another question
    keyed = sliced.withColumn("own", F.col("article_id")).withColumn("article_id", F.struct("q_id", "own"))
    texts = content.contents(content.budget(keyed)).select(F.col("article_id.q_id").alias("t_q"), F.col("article_id.own").alias("t_a"), "content")
    joined = picked.join(texts, (F.col("q_id") == F.col("t_q")) & (F.col("article_id") == F.col("t_a")))
    number = F.row_number().over(rank.Window.partitionBy("q_id").orderBy("pick")).cast("int")
    sources = corpus.settle(joined.filter("content <> ''").withColumn("cite_no", number).select("q_id", "cite_no", "article_id", "title", "url", "content"))
    if backend is None:
        answers = assemble.extractive_answer(sources)
    else:
        context = assemble.contexts(sources).join(understood.select("q_id", "question"), "q_id")
        prompts = context.select("q_id", assemble.answer_prompt(F.col("question"), F.col("context"), F.col("source_list")).alias("prompt"))
        answers = models.chat(prompts, backend, SYNTHESIS_OPTIONS)
    counted = found.groupBy("q_id").agg(F.count("*").alias("n_candidates"))
    return assemble.envelope(understood.select("q_id", "question"), counted, sources, answers, model)
