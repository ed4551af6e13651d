"""Command line: answers questions over a table of pages, one by one or a file of them at once."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequery.functions import text as T
from lorequery.operators import assemble, models
from lorequery.plans.ask import ask, page_bodies


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("question", nargs="?", help="a question; without one, and without --questions, questions are read line by line")
    parser.add_argument("--pages", required=True, help="parquet table of pages (page_id, url, html)")
    parser.add_argument("--questions", help="text file of questions, a line each")
    parser.add_argument("--out", help="folder for the answers, a folder for each question's file name")
    parser.add_argument("--max-results", type=int, help="articles of each answer; by default by the question")
    parser.add_argument("--titles-only", action="store_true", help="search titles, not texts")
    parser.add_argument("--url", help="chat endpoint; without one, answers are extractive")
    parser.add_argument("--model", default="none")
    return parser.parse_args(given)


def write(answers: DataFrame, folder: str) -> None:
    """Every answer into a folder of its own, named after its question."""
    named = answers.select(T.file_name(F.col("question")).alias("file"), "question", "answer", "sources", "model")
    named.write.mode("overwrite").partitionBy("file").json(folder)


def shown(answers: DataFrame, interactive: bool) -> list[str]:
    """An answer's lines for a console, with its numbered sources: those of few questions, not of a table."""
    lines = answers.select("question", assemble.console_lines(F.col("answer"), interactive).alias("text"), assemble.console_sources(F.col("sources")).alias("listed"))
    return [f"{r.question}\n\n{r.text}\n" + (f"\n   Sources:\n{r.listed}\n" if r.listed else "") for r in lines.collect()]


def run(spark: SparkSession, options: argparse.Namespace, lines: Iterable[str] = ()) -> Iterable[str]:
    """What to print: for the question, for a file of questions, or for each of lines until one says quit, exit or q."""
    pages = spark.read.parquet(options.pages)
    bodies = None if options.titles_only else page_bodies(pages)
    backend = models.http_backend(options.url, options.model) if options.url else None

    def answers(questions: DataFrame) -> DataFrame:
        return ask(questions, pages, backend, options.model, options.max_results, bodies)

    def one(question: str) -> DataFrame:
        return answers(spark.createDataFrame([(1, question)], "q_id long, question string"))

    if options.questions:
        asked = spark.read.text(options.questions).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("q_id"), F.trim("value").alias("question"))
        write(answers(asked), options.out or "answers")
        yield f"answers in {options.out or 'answers'}"
    elif options.question:
        found = one(options.question)
        if options.out:
            write(found, options.out)
        yield from shown(found, False)
    else:
        for line in lines:
            if line.strip().lower() in ("quit", "exit", "q"):
                break
            if line.strip():
                yield from shown(one(line.strip()), True)


def main() -> None:
    options = arguments()
    spark = SparkSession.builder.appName("lorequery").getOrCreate()
    try:
        for text in run(spark, options, sys.stdin):
            print(text)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
