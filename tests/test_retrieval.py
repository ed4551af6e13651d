"""Matching, ordering, scores, selection, budgets and degraded modes."""

from pyspark.sql import functions as F

from lorequery.functions import match as M
from lorequery.functions import text as T
from lorequery.operators import assemble, content, html, models, rank, retrieve
from lorequery.functions.lexicon import SELECTION_MODELS
from lorequery.plans.ask import ask


def test_matching(spark):
    rows = spark.createDataFrame(
        [("Star Trek: The Next Generation", ["star", "trek", "generation"], ["Star Trek - Next Generation"]), ("List of Next Top Model contestants", ["star", "trek", "generation"], ["Star Trek - Next Generation"]),
         ("Earth", ["art"], []), ("x", [], ["!"])], "title string, k array<string>, p array<string>")
    got = rows.select(M.matches_keywords(F.col("title"), F.col("k")), M.matches_phrase(F.col("title"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, False), (True, False)]


def test_order_of_results(spark):
    found = spark.createDataFrame([(1, 0, 1, 1, "Alpha one", "u"), (1, 0, 2, 2, "Beta", "u"), (1, 1, 1, 3, "beta", "u"), (1, 1, 2, 4, "Beta two", "u")], "q_id int, term_pos int, rank int, article_id int, title string, url string")
    terms = spark.createDataFrame([(1, 0, "Alpha"), (1, 1, "Beta")], "q_id int, term_pos int, term string")
    articles = spark.createDataFrame([(10, "Alpha", "u"), (2, "Beta", "u"), (11, "Beta (film)", "u")], "article_id int, title string, url string")
    first = retrieve.first_wins(found)
    media = retrieve.media_lookup(terms, articles, first)
    direct = retrieve.direct_lookup(terms, articles, first.select("q_id", "title").unionByName(media.select("q_id", "title")))
    listed = retrieve.merge(first, media, direct)
    names = lambda df: [r.title for r in df.orderBy("pos").collect()]
    assert names(listed) == ["Alpha", "Beta (film)", "Alpha one", "Beta", "Beta two"]
    keyed = listed.withColumn("keywords", F.array(F.lit("beta"))).withColumn("phrases", F.array().cast("array<string>"))
    assert names(retrieve.prioritise(keyed)) == ["Beta (film)", "Beta", "Beta two", "Alpha", "Alpha one"]


def test_scores_of_three_articles(spark):
    rows = [(1, i, t, "x" * 80 if t != "Photosynthesis" else "photosynthesis " + "x" * 60) for i, t in enumerate(["Photosynthesis", "Chloroplast", "Biology"])]
    rows[1] = (1, 1, "Chloroplast", "organelle of photosynthesis")
    df = spark.createDataFrame(rows, "q_id int, pos int, title string, abstract string").selectExpr("*", "array('photosynthesis') keywords", "cast(array() as array<string>) phrases", "2 depth")
    scored = {r.title: r.score for r in rank.score(df).collect()}
    assert scored == {"Photosynthesis": 110, "Chloroplast": -30, "Biology": -55}
    assert all(r.bypass for r in rank.rank(rank.score(df.withColumn("depth", F.lit(3)))).collect())


def test_paragraph_budget(spark):
    def kept(lengths, limit=None):
        rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(lengths)], "article_id int, para_pos int, paragraph string")
        return [len(r.paragraph) for r in content.budget(rows, limit).orderBy("para_pos").collect()]

    assert kept([60, 40, 7900, 100, 30, 60]) == [60, 7900]
    assert kept([60, 40, 7840, 100, 30, 60]) == [60, 7840, 100]
    assert kept([60, 7880, 100, 51]) == [60, 7880]
    assert kept([60, 40, 7900], 2) == [60]


def test_html_paragraphs():
    page = '<body><p>out</p><div id="mw-content-text"><p>The <b>cat</b> sat<script>x="</p>"</script><!-- c --></p><p>a&amp;b<p>c</div></body>'
    assert html.paragraphs(page, autoclose=True) == ["Thecatsat", "a&b", "c"]
    assert html.paragraphs(page) == ["Thecatsat", "a&bc", "c"]
    assert html.paragraphs("<body><p>x</p></body>") == ["x"] and html.paragraphs("<body><p>x</p></body>", body=False) == [] and html.paragraphs(None) == []
    listing = '<div class="results"><ul><li><a href="/a">A <b>1</b></a></li><li>no link</li><li><a href="http://h/b">B</a></li></ul></div>'
    assert html.search_results(listing, "http://s", 3) == [("A 1", "http://s/a"), ("B", "http://h/b")]
    assert html.search_results(listing, "http://s", 2) == [("A 1", "http://s/a")]


def test_models_and_backends(spark):
    catalogue = spark.createDataFrame([(1, 0, "qwen2.5:7b"), (1, 1, "qwen2.5:32b"), (2, 0, "deepseek-r1:latest")], "case_id int, pos int, name string")
    assert [tuple(r) for r in models.preferred(catalogue, SELECTION_MODELS, ["r1", "deepseek"]).collect()] == [(1, "qwen2.5:7b")]

    def away(prompts, options):
        raise OSError("no server")

    said = models.chat(spark.createDataFrame([(1, "p")], "q_id long, prompt string"), away, {})
    assert said.collect()[0].answer is None


def test_ask_with_and_without_model(spark):
    text = "Photosynthesis turns light into sugar in green plants and keeps most of life on this planet alive today and tomorrow."
    pages = spark.createDataFrame([(1, "u1", f"<html><title>Photosynthesis</title><body><p>{text}</p></body></html>"), (2, "u2", "<title>Other</title>")], "page_id long, url string, html string")
    questions = spark.createDataFrame([(1, "What is photosynthesis?"), (2, "What is ZZZ?"), (3, None)], "q_id int, question string")
    rows = {r.q_id: r for r in ask(questions, pages).collect()}
    assert set(rows) == {1, 2} and rows[1].answer.endswith("[1]") and rows[1].sources[0].title == "Photosynthesis"
    assert rows[2].answer == assemble.NOTHING_FOUND and rows[2].sources == []
    failed = {r.q_id: r for r in ask(questions, pages, lambda p, o: [None] * len(p), "m").collect()}
    assert failed[1].answer == assemble.FAILED and len(failed[1].sources) == 1


def test_answers_and_console(spark):
    rows = spark.createDataFrame([("A.\nSources: x\nB\n\nReferences:\n[1] y \n",)], "a string").select(T.strip_references(F.col("a")).alias("a"))
    assert rows.select(assemble.console_lines(F.col("a"), True)).first()[0] == "   A.\n   B"
