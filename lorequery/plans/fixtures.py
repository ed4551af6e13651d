"""Literal relations for queries whose inputs the tables do not hold; the same rows for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTIONS = [
    (1, "What is photosynthesis?"),
    (2, "Who was Albert Einstein?"),
    (3, "What is the meaning of life?"),
    (4, "is the expanse a good tv show?"),
    (5, 'Is "Star Trek - Next Generation" a good tv show?'),
    (6, "What are the goals of NASA?"),
    (7, "Compare mitochondria and chloroplasts"),
    (8, "What causes earthquakes and can we predict them?"),
    (9, "How does climate change impact ocean ecosystems and what are the long-term consequences?"),
    (10, "What caused World War 2?"),
    (11, "What is AI?"),
    (12, "What's Newton's law?"),
]
#: Worked by hand from the definitions, not by this code.
TERMS = {
    1: ["Photosynthesis"],
    2: ["Albert Einstein", "Albert", "Einstein", "Albert einstein"],
    3: ["Meaning", "Life", "Meaning life"],
    4: ["Expanse", "Show"],
    5: ["Star Trek - Next Generation", "Trek", 'Next Generation"', "Star", "Next"],
    6: ["NASA", "Goals", "Nasa", "Goals nasa"],
    7: ["Compare", "Mitochondria", "Chloroplasts", "Compare mitochondria", "Mitochondria chloroplasts"],
    8: ["Earthquakes", "Predict", "Earthquakes predict"],
    9: ["Climate", "Change", "Impact", "Ocean", "Ecosystems"],
    10: ["World War", "World"],
    11: ["AI"],
    12: ["s Newton", "What's Newton's", "What's", "Newton's", "What's newton's"],
}
KEYWORDS = {
    1: ["photosynthesis"],
    2: ["albert", "einstein", "albert einstein"],
    3: ["meaning", "life", "meaning life"],
    4: ["expanse", "show", "expanse show"],
    5: ["star", "trek", "next", "generation", "show", 'generation"'],
    6: ["goals", "nasa", "goals nasa"],
    7: ["compare", "mitochondria", "chloroplasts", "compare mitochondria", "mitochondria chloroplasts"],
    8: ["earthquakes", "predict", "earthquakes predict"],
    9: ["climate", "change", "impact", "ocean", "ecosystems", "long"],
    10: ["world", "war", "world war"],
    11: ["what"],
    12: ["what's", "newton's", "law", "newton", "what's newton's", "newton's law"],
}
PHRASES = {
    2: ["Albert Einstein", "Albert einstein"],
    3: ["Meaning life"],
    5: ["Star Trek - Next Generation", 'Next Generation"'],
    6: ["Goals nasa"],
    7: ["Compare mitochondria", "Mitochondria chloroplasts"],
    8: ["Earthquakes predict"],
    10: ["World War"],
    12: ["s Newton", "What's Newton's", "What's newton's"],
}
DEPTH = {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 5, 8: 5, 9: 6, 10: 4, 11: 3, 12: 3}

TITLES = [
    (1, "Star Trek: The Next Generation"),
    (2, "Star Trek: Voyager"),
    (3, "List of next top model contestants"),
    (4, "The Expanse (TV series)"),
    (5, "Dune (film)"),
    (6, "1969 in science"),
    (7, "Mercury (disambiguation)"),
    (8, "Index of physics articles"),
    (9, "Lists of earthquakes"),
    (10, "Photosynthesis"),
    (11, "Earth science"),
    (12, "NASA"),
    (13, "Albert Einstein House"),
    (14, "Room 12034"),
    (15, "Albert Einstein"),
    (16, "Expanse (film)"),
    (17, "Expanse (TV show)"),
    (18, "The World at War (television)"),
    (19, "World War"),
    (20, "History of the World War era"),
    (21, "List of World War films"),
    (22, "Climate change and ocean ecosystems"),
    (23, "Mitochondria"),
    (24, "Chloroplasts (disambiguation)"),
    (25, "Einstein, Albert in 1921"),
    (26, "Earthquakes: how to predict them"),
    (27, "Show business"),
]
ANSWERS = [
    (1, "3, 1, 3 and 99"),
    (2, "none of them"),
    (3, "99999999999999, 2"),
    (4, "1,2,3,4,5,6"),
    (5, "Fact one [1].\n\nReferences:\n[1] Something"),
    (6, "Fact.\nSources: on one line"),
    (7, "Text\n[Bibliography]\nall gone  "),
]
MODELS = [
    (1, 0, "llama3.1:8b"), (1, 1, "mistral:7b"), (1, 2, "qwen2.5:32b-instruct"),
    (2, 0, "qwen2.5:7b"), (2, 1, "qwen2.5:32b"),
    (3, 0, "deepseek-r1:latest"), (3, 1, "mistral:7b"),
    (4, 0, "deepseek-r1:latest"), (4, 1, "other:1b"),
    (5, 0, "deepseek-r1:latest"),
]
CITED = [(1, "A fact[1] and  another[23]\nfact.\t[x] [4]end"), (2, "no citation"), (3, "")]
OUTCOMES = [(1, True), (2, False), (3, None), (4, True)]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql(rows: list, columns: str) -> str:
    """The rows as a relation in DuckDB SQL."""

    def one(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS lit({columns})"


def listed(of: dict) -> list[tuple]:
    return [(q, pos, x) for q, xs in of.items() for pos, x in enumerate(xs)]
