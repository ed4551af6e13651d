"""Question understanding as single-row column expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorequery.functions import text as T
from lorequery.functions.lexicon import BLACKLIST, COMPLEXITY, LONG_QUESTION_WORDS, SKIP_WORDS, STOPWORDS

NO_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(NO_STRINGS)


def _add(values: Column, start: Column) -> Column:
    """start with each of values that it does not hold yet, in order."""
    return F.aggregate(values, start, lambda acc, x: F.when(F.array_contains(acc, x), acc).otherwise(F.array_append(acc, x)))


def quoted_terms(q: Column) -> Column:
    found = F.transform(F.regexp_extract_all(q, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(found, lambda x: F.length(x) > 2)


def proper_nouns(q: Column) -> Column:
    """Runs of capitalised words without their leading stopwords, each joined by spaces."""
    state = F.struct(_none().alias("done"), _none().alias("run"))

    def flush(acc):
        return F.when(F.size(acc["run"]) > 0, F.array_append(acc["done"], F.array_join(acc["run"], " "))).otherwise(acc["done"])

    def step(acc, w):
        leading = (F.size(acc["run"]) == 0) & F.lower(w).isin(STOPWORDS)
        grown = F.struct(acc["done"].alias("done"), F.when(leading, acc["run"]).otherwise(F.array_append(acc["run"], w)).alias("run"))
        return F.when(T.is_capitalised(w), grown).otherwise(F.struct(flush(acc).alias("done"), _none().alias("run")))

    return F.aggregate(T.words(T.drop_marks(q)), state, step, flush)


def content_words(q: Column) -> Column:
    """Lower-case words of over three characters, edge marks included in the count, that are no stopwords."""
    low = T.words(T.drop_marks(F.lower(q)))
    kept = F.filter(low, lambda w: (F.length(w) > 3) & ~T.strip_edges(w).isin(STOPWORDS))
    return F.transform(kept, T.strip_edges)


def search_terms(q: Column) -> Column:
    """Up to five terms: quoted spans, proper nouns, single words, pairs; the question itself if there is none."""
    content, nouns = content_words(q), proper_nouns(q)
    terms = _add(F.slice(nouns, 1, 3), quoted_terms(q))
    single = F.filter(F.slice(content, 1, 5), lambda w: ~w.isin(SKIP_WORDS) & (F.length(w) >= 4))
    single = F.filter(F.transform(single, T.capitalize), lambda w: ~F.array_contains(nouns, w))
    terms = _add(single, terms)

    def pair(i):
        a, b = F.get(content, F.lit(i)), F.get(content, F.lit(i + 1))
        usable = b.isNotNull() & ~a.isin(SKIP_WORDS) & ~b.isin(SKIP_WORDS)
        return F.when(usable, F.concat(T.capitalize(a), F.lit(" "), b))

    terms = _add(F.array_compact(F.array(pair(0), pair(1))), terms)
    return F.when(F.size(terms) > 0, F.slice(terms, 1, 5)).otherwise(F.array(q))


def primary_keywords(q: Column, terms: Column | None = None) -> Column:
    """Up to six keywords: single ones of the question and its terms, then neighbouring pairs."""
    terms = search_terms(q) if terms is None else terms
    raw = F.regexp_extract_all(F.lower(q), F.lit("[a-z0-9']+"), F.lit(0))
    fit = lambda w: (F.length(w) >= 3) & ~w.isin(BLACKLIST)
    more = F.flatten(F.transform(terms, lambda t: F.split(F.lower(t), r"[\s\-_/()]+")))
    base = F.array_distinct(F.concat(F.filter(raw, fit), F.filter(more, fit)))
    count = F.greatest(F.size(base) - 1, F.lit(0))
    later = F.slice(base, F.lit(2), count)
    pairs = F.when(
        F.size(base) >= 2, F.zip_with(F.slice(base, F.lit(1), count), later, lambda a, b: F.concat(a, F.lit(" "), b))
    ).otherwise(_none())
    words = F.array_distinct(F.concat(base, pairs))
    fallback = F.slice(F.filter(raw, lambda w: F.length(w) >= 4), 1, 1)
    return F.slice(F.when(F.size(words) > 0, words).otherwise(fallback), 1, 6)


def focus_phrases(q: Column, terms: Column | None = None) -> Column:
    """Up to four phrases of two normalised words or more: quoted spans, then terms with a space."""
    terms = search_terms(q) if terms is None else terms
    pattern = F.lit("\"([^\"]+)\"|'([^']+)'")
    spans = F.zip_with(F.regexp_extract_all(q, pattern, F.lit(1)), F.regexp_extract_all(q, pattern, F.lit(2)), lambda a, b: F.when(a != "", a).otherwise(b))
    spaced = F.filter(terms, lambda t: F.contains(t, F.lit(" ")))
    all_ = F.transform(F.concat(spans, spaced), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    return F.slice(F.array_distinct(F.filter(all_, lambda t: F.size(T.norm_tokens(t)) >= 2)), 1, 4)


def depth(q: Column) -> Column:
    """Articles to retrieve, 3 to 6, by weights of substrings."""
    low, score = F.lower(q), F.lit(0)
    for weight, parts in COMPLEXITY:
        any_ = F.lit(False)
        for part in parts:
            any_ = any_ | F.contains(low, F.lit(part))
        score = score + F.when(any_, weight).otherwise(0)
    score = score + F.when(F.size(T.words(q)) > LONG_QUESTION_WORDS, 1).otherwise(0)
    return F.when(score >= 6, 6).when(score >= 4, 5).when(score >= 2, 4).otherwise(3)


def acronyms(q: Column) -> Column:
    return F.slice(F.filter(T.words(T.drop_marks(q)), T.is_acronym), 1, 3)


def understand(questions):
    """questions with terms, keywords, phrases and depth; null questions go. Terms are computed once."""
    q = F.col("question")
    return (
        questions.filter(q.isNotNull())
        .withColumn("terms", search_terms(q))
        .withColumn("keywords", primary_keywords(q, F.col("terms")))
        .withColumn("phrases", focus_phrases(q, F.col("terms")))
        .withColumn("depth", depth(q))
    )
