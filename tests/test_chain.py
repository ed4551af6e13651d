"""The ranked chain with phrases, selection by a model, html against a parser of its own, the command line, and plans."""

import re

import pytest
from pyspark.sql import functions as F

from lorequery import cli
from lorequery.functions import understand as U
from lorequery.operators import html, rank, retrieve
from lorequery.plans import catalogue
from lorequery.plans.ask import ask, page_bodies
from lorequery.sources import corpus

SMALL = "/root/testdata/sf0.001"
CANDIDATE = "q_id int, pos int, title string, abstract string, keywords array<string>, phrases array<string>, depth int"


def test_phrases_and_media_in_scores_and_selection(spark):
    phrases, keywords = ["World War"], ["world", "war", "world war"]
    titles = ["World War", "War of the world (film)", "The World at War (television)", "List of World War films", "Ships"]
    rows = spark.createDataFrame([(1, i, t, "", keywords, phrases, 2) for i, t in enumerate(titles)], CANDIDATE)
    scored = {r.title: r.score for r in rank.score(rows).collect()}
    # phrase 200 or -90, keywords 80 or -60, short title 5, media 100, list page -50
    assert scored == {"World War": 285, "War of the world (film)": 95, "The World at War (television)": 385, "List of World War films": 235, "Ships": -145}
    picked = rank.fallback_select(rank.rank(rank.score(rows))).orderBy("pick").collect()
    assert [r.title for r in picked] == ["The World at War (television)", "World War"]
    ordered = retrieve.prioritise(rows.withColumn("article_id", F.col("pos")).withColumn("url", F.lit("u"))).orderBy("pos").collect()
    assert [r.title for r in ordered] == ["World War", "The World at War (television)", "List of World War films", "War of the world (film)", "Ships"]


def test_chain_meets_phrases(spark):
    flags = catalogue.queries()["candidate_flags"](spark, SMALL)
    assert flags.filter("phrase_hit").count() >= 5 and flags.filter("NOT phrase_hit").count() >= 5


def test_nothing_left_for_the_shortlist(spark):
    rows = spark.createDataFrame([(1, i, f"List of x {i}", "", ["x"], [], 2) for i in range(20)], CANDIDATE)
    shown = rank.shortlist(rank.rank(rank.score(rows))).orderBy("display_no").collect()
    assert len(shown) == 15 and shown[0].line == shown[0].title


def _pages(spark):
    text = "Photosynthesis turns light into sugar in green plants and keeps most of life on this planet alive today and tomorrow."
    page = "<html><title>{0}</title><body><p>{1}</p></body></html>"
    titles = ["Photosynthesis", "Photosynthesis in algae", "Photosynthesis of corn", "Artificial photosynthesis", "Photosynthesis by night"]
    rows = [(i, f"u{i}", page.format(t, text)) for i, t in enumerate(titles)] + [(9, "u9", page.format("Green matter", text))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_a_model_selects_by_number(spark):
    asked = spark.createDataFrame([(1, "What is photosynthesis?")], "q_id int, question string")

    def backend(prompts, options):
        return ["2, 1 and 99" if "numbers only" in p else "Plants do [1].\n\nSources:\n[1] x" for p in prompts]

    row = ask(asked, _pages(spark), backend, "m", max_results=2).first()
    assert [s.title for s in row.sources] == ["Photosynthesis in algae", "Photosynthesis"] or len(row.sources) == 2
    assert row.answer == "Plants do [1]." and row.model == "m"
    assert len(ask(asked, _pages(spark), max_results=1).first().sources) == 1


def test_search_in_texts(spark):
    pages = _pages(spark)
    articles = corpus.page_articles(pages)
    terms = spark.createDataFrame([(1, 0, "sugar planet", 3), (2, 0, "green", 6)], "q_id int, term_pos int, term string, depth int")
    found = retrieve.search(terms, corpus.title_index(articles), bodies=page_bodies(pages)).orderBy("q_id", "rank").collect()
    assert [(r.q_id, r.title, r.search_score) for r in found][3] == (2, "Green matter", 111) and len(found) == 9
    assert [(r.title, r.search_score) for r in found][:1] == [("Green matter", 2)]
    assert retrieve.search(terms.filter("q_id = 1"), corpus.title_index(articles)).count() == 0


def _paragraphs(page):
    """Texts of all paragraphs in the body; an open paragraph goes on until an end tag of it or of an element about it."""
    out, stack, inside = [], [], False
    for m in re.finditer(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style)\b[^>]*>.*?</\1>|<(/?)([a-z0-9]+)[^>]*>|[^<]+", page, re.S):
        end, tag = m[2], m[3]
        if tag == "body":
            inside = not end
        elif tag in ("br", "meta", "input", "img", "link", "hr"):
            continue
        elif tag and not end:
            stack.append((tag, len(out) if tag == "p" and inside else None))
            if tag == "p" and inside:
                out.append([])
        elif tag:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif not m[0].startswith("<"):
            import html as entities

            said = entities.unescape(m[0]).strip()
            for _, k in stack:
                if k is not None and said:
                    out[k].append(said)
    return ["".join(x) for x in out]


def test_html_against_another_parser(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()
    got = {}
    for r in catalogue.queries()["html_paragraphs"](spark, SMALL).orderBy("article_id", "para_pos").collect():
        got.setdefault(r.article_id, []).append(r.paragraph)
    assert {r.page_id: _paragraphs(r.html) for r in rows if _paragraphs(r.html)} == got
    want = {}
    for i, paragraphs in got.items():
        kept, total = [], 0
        for p in [p for p in paragraphs[:15] if len(p) > 50]:
            total += len(p)
            if total > 8000:
                break
            kept.append(p)
        if kept:
            want[i] = re.sub(r"\s+", " ", re.sub(r"\[\d+\]", "", "\n\n".join(kept)))
    assert {r.article_id: r.content for r in catalogue.queries()["html_content"](spark, SMALL).collect()} == want
    abstracts = {r.article_id: r.abstract for r in catalogue.queries()["html_abstract"](spark, SMALL).collect()}
    assert abstracts == {i: next(p for p in ps if len(p) > 100)[:500] for i, ps in got.items() if any(len(p) > 100 for p in ps)}
    assert html.paragraphs(None) == []


def test_command_line(spark, tmp_path):
    _pages(spark).write.parquet(str(tmp_path / "pages"))
    (tmp_path / "asked.txt").write_text("What is photosynthesis?\n\nWhat is ZZZ?\n")
    options = cli.arguments(["--pages", str(tmp_path / "pages"), "--questions", str(tmp_path / "asked.txt"), "--out", str(tmp_path / "out"), "--titles-only"])
    assert list(cli.run(spark, options)) == [f"answers in {tmp_path / 'out'}"]
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"file=What_is_photosynthesis_", "file=What_is_ZZZ_"}
    options = cli.arguments(["--pages", str(tmp_path / "pages"), "--max-results", "1", "--titles-only"])
    said = list(cli.run(spark, options, ["What is photosynthesis?\n", "\n", "quit\n", "never asked\n"]))
    assert len(said) == 1 and "   Sources:\n   [1] " in said[0] and "[2]" not in said[0].split("Sources:")[1]


@pytest.mark.parametrize("name", ["search_topk_per_term", "priority_order", "rank_candidates"])
def test_plans_have_no_pairwise_joins(spark, name):
    plan = catalogue.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_questions_with_null_and_no_rows(spark):
    empty = spark.createDataFrame([], "q_id int, question string")
    assert U.understand(empty).count() == 0 and ask(empty, _pages(spark)).count() == 0
