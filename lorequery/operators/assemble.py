"""Contexts, prompts, help messages and the result envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequery.functions import text as T
from lorequery.functions.understand import acronyms

NOTHING_FOUND = "No matching article was found in the corpus."
FAILED = "The answer could not be generated."


def _listed(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("cite_no"), value.alias("line")))), lambda x: x["line"])


def contexts(sources: DataFrame) -> DataFrame:
    """(q_id, context, source_list, n_sources)."""
    number = F.col("cite_no").cast("string")
    block = F.concat(F.lit("[Article "), number, F.lit("] **"), F.col("title"), F.lit("**:\n"), F.col("content"))
    line = F.concat(F.lit("["), number, F.lit("] "), F.col("title"))
    return sources.groupBy("q_id").agg(
        F.array_join(_listed(block), "\n\n").alias("context"), F.array_join(_listed(line), "\n").alias("source_list"), F.count("*").alias("n_sources")
    )


def selection_prompt(question: Column, keywords: Column, phrases: Column, lines: Column, target: Column) -> Column:
    return F.concat(
        F.lit("Choose up to "), target.cast("string"), F.lit(" articles that answer the question.\nQuestion: "), question,
        F.when(F.size(keywords) > 0, F.concat(F.lit("\nKeywords: "), F.array_join(F.slice(keywords, 1, 4), ", "))).otherwise(""),
        F.when(F.size(phrases) > 0, F.concat(F.lit("\nTopic: "), F.array_join(F.slice(phrases, 1, 2), "; "))).otherwise(""),
        F.lit("\nArticles:\n"), lines, F.lit("\nReply with their numbers only, separated by commas."),
    )


def selection_prompts(shown: DataFrame, understood: DataFrame) -> DataFrame:
    """(q_id, prompt): what a model is asked to choose from, out of a shortlist and (q_id, question, keywords, phrases, depth)."""
    numbered = F.transform(F.array_sort(F.collect_list(F.struct("display_no", "line"))), lambda x: F.concat(x["display_no"].cast("string"), F.lit(". "), x["line"]))
    listed = shown.groupBy("q_id").agg(F.array_join(numbered, "\n").alias("lines")).join(understood, "q_id")
    return listed.select("q_id", selection_prompt(F.col("question"), F.col("keywords"), F.col("phrases"), F.col("lines"), F.col("depth")).alias("prompt"))


def answer_prompt(question: Column, context: Column, source_list: Column) -> Column:
    return F.concat(
        F.lit("Answer from the articles below. Begin with a direct verdict, cite [n] after each fact, and add no list of references.\nQuestion: "),
        question, F.lit("\n\n"), context, F.lit("\n\nArticles:\n"), source_list,
    )


def missing_content(question: Column) -> Column:
    """What to say where no content was found: a hint about acronyms, if there are any."""
    short = acronyms(question)
    quoted = F.array_join(F.transform(short, lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", ")
    return F.when(F.size(short) > 0, F.concat(F.lit("No article content was found. Try spelling out: "), quoted)).otherwise(
        F.lit("No article content was found. Try other words.")
    )


def extractive_answer(sources: DataFrame) -> DataFrame:
    """(q_id, answer): the first sentence of each source with its citation; an extension that needs no model."""
    first = F.concat(F.substring_index("content", ".", 1), F.lit(". ["), F.col("cite_no").cast("string"), F.lit("]"))
    return sources.groupBy("q_id").agg(F.array_join(_listed(first), " ").alias("answer"))


def envelope(questions: DataFrame, n_candidates: DataFrame, sources: DataFrame, answers: DataFrame, model: str) -> DataFrame:
    """(q_id, question, answer, sources, model): one row a question, whatever failed on its way."""
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("cite_no", "title", "content", "url"))), lambda x: F.struct(x["title"].alias("title"), x["content"].alias("content"), x["url"].alias("url"))
    )
    given = sources.groupBy("q_id").agg(listed.alias("sources"))
    joined = questions.join(n_candidates, "q_id", "left").join(given, "q_id", "left").join(answers, "q_id", "left")
    answer = (
        F.when(F.coalesce("n_candidates", F.lit(0)) == 0, F.lit(NOTHING_FOUND))
        .when(F.col("sources").isNull(), missing_content(F.col("question")))
        .otherwise(F.coalesce(T.strip_references(F.col("answer")), F.lit(FAILED)))
    )
    empty = F.array().cast("array<struct<title:string,content:string,url:string>>")
    return joined.select("q_id", "question", answer.alias("answer"), F.coalesce("sources", empty).alias("sources"), F.lit(model).alias("model"))


def console_lines(answer: Column, drop_sources: bool = False) -> Column:
    """The answer indented by three spaces; interactive printing leaves out lines of sources."""
    lines = F.split(answer, "\n")
    if drop_sources:
        lines = F.filter(lines, lambda x: ~F.startswith(F.lower(F.trim(x)), F.lit("sources:")))
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("   "), x)), "\n")


def console_sources(sources: Column) -> Column:
    """The sources of an answer as numbered lines, one each."""
    return F.array_join(F.transform(sources, lambda x, i: F.concat(F.lit("   ["), (i + 1).cast("string"), F.lit("] "), x["title"], F.lit(" - "), x["url"])), "\n")
