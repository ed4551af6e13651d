"""Question understanding against values worked by hand, its limits, and odd questions."""

from pyspark.sql import functions as F

from lorequery.functions import understand as U
from lorequery.functions.lexicon import BLACKLIST, SKIP_WORDS, STOPWORDS
from lorequery.plans import fixtures as X


def test_golden_values(spark):
    q = F.col("question")
    rows = X.frame(spark, X.QUESTIONS, "q_id int, question string").select(
        "q_id", U.search_terms(q).alias("t"), U.primary_keywords(q).alias("k"), U.focus_phrases(q).alias("p"), U.depth(q).alias("d")
    ).collect()
    for r in rows:
        assert (r.t, r.k, r.p, r.d) == (X.TERMS[r.q_id], X.KEYWORDS[r.q_id], X.PHRASES.get(r.q_id, []), X.DEPTH[r.q_id])


def test_limits_and_degenerate_questions(spark):
    questions = [(1, ""), (2, None), (3, "Is The Grand Hotel of Paris open In June"), (4, "a b " * 60), (5, "What about  NASA?")]
    rows = {r.q_id: r for r in U.understand(X.frame(spark, questions, "q_id int, question string")).collect()}
    assert 2 not in rows
    assert rows[1].terms == [""] and rows[1].keywords == [] and rows[1].phrases == [] and rows[1].depth == 3
    for r in rows.values():
        assert len(r.terms) <= 5 and len(r.keywords) <= 6 and len(r.phrases) <= 4 and 3 <= r.depth <= 6
    nouns = X.frame(spark, questions, "q_id int, question string").filter("q_id = 3").select(U.proper_nouns(F.col("question"))).first()[0]
    assert nouns == ["Grand Hotel", "Paris", "June"]


def test_word_sets():
    assert (len(STOPWORDS), len(SKIP_WORDS), len(BLACKLIST)) == (83, 48, 127)
    topics = {"science", "history", "show", "war", "music"}
    assert not topics & set(SKIP_WORDS)
