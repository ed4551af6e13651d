"""The query catalogue of the retrieval operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorequery.functions import match as M
from lorequery.functions import text as T
from lorequery.functions import understand as U
from lorequery.functions.lexicon import BLACKLIST, COMPLEXITY, SELECTION_MODELS, SKIP_WORDS, STOPWORDS, SYNTHESIS_MODELS
from lorequery.operators import assemble, content, html, models, rank, retrieve
from lorequery.plans import ask as A
from lorequery.plans import fixtures as X
from lorequery.sources import corpus

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_SQL)


# --- SQL building blocks ------------------------------------------------------


def _norm(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), ' ')"


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_PAGE = "SELECT page_id AS article_id, regexp_extract(html, '<title>((?s:.*?))</title>', 1) AS title, url FROM pages"
_PLAIN = "SELECT doc_id AS article_id, split_part(split_part(text, chr(10), 1), '.', 1) AS title FROM documents"
_BENCH = "SELECT item_id AS q_id, split_part(text, '.', 1) AS question FROM benchmark"


def _score_sql(q: str) -> str:
    parts = ["CASE WHEN " + " OR ".join(f"contains(lower({q}), '{p}')" for p in ps) + f" THEN {w} ELSE 0 END" for w, ps in COMPLEXITY]
    return " + ".join(parts) + f" + CASE WHEN len(list_filter(regexp_split_to_array({q}, '\\s+'), lambda w: w <> '')) > 12 THEN 1 ELSE 0 END"


def _depth_sql(q: str) -> str:
    return f"(CASE WHEN {_score_sql(q)} >= 6 THEN 6 WHEN {_score_sql(q)} >= 4 THEN 5 WHEN {_score_sql(q)} >= 2 THEN 4 ELSE 3 END)"


def _pages(spark, d):
    return corpus.page_articles(corpus.table(spark, d, "pages"))


def _plain(spark, d):
    return corpus.plain_articles(corpus.table(spark, d, "documents"))


def _bench(spark, d):
    return corpus.benchmark_questions(corpus.table(spark, d, "benchmark"))


def _questions(spark):
    return X.frame(spark, X.QUESTIONS, "q_id int, question string")


def _titles(spark):
    return X.frame(spark, X.TITLES, "title_id int, title string")


# --- scalar text functions ----------------------------------------------------


@query(f"SELECT article_id, {_norm('title')} AS name FROM ({_PAGE})")
def normalize_titles(spark, d):
    return _pages(spark, d).select("article_id", T.normalize(F.col("title")).alias("name"))


@query(
    "SELECT q_id, pos::INT AS pos, trim(w, '?.,!:;''\"') AS word FROM (SELECT q_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM "
    f"(SELECT q_id, list_filter(regexp_split_to_array(translate(question, '?,.', ''), '\\s+'), lambda w: w <> '') AS ws FROM ({_BENCH})))"
)
def word_split_clean(spark, d):
    rows = _bench(spark, d).select("q_id", F.posexplode(T.words(T.drop_marks(F.col("question")))).alias("pos", "word"))
    return rows.select("q_id", "pos", T.strip_edges(F.col("word")).alias("word"))


_WORDS = "SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS w FROM documents"


@query(f"SELECT doc_id, count(*) AS n, count(DISTINCT w) AS n_distinct FROM ({_WORDS}) WHERE regexp_matches(w, '^\\p{{Lu}}') GROUP BY doc_id")
def capitalised_words(spark, d):
    words = corpus.table(spark, d, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    return words.filter(T.is_capitalised(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("w").alias("n_distinct"))


@query(
    f"SELECT w AS word, count(*) AS n FROM ({_WORDS}) WHERE regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]') "
    "AND length(w) BETWEEN 2 AND 5 GROUP BY w"
)
def acronym_words(spark, d):
    words = corpus.table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    return words.filter(T.is_acronym(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT id, regexp_replace(regexp_replace(t, '\\[\\d+\\]', '', 'g'), '\\s+', ' ', 'g') AS text FROM {X.sql(X.CITED, 'id, t')}")
def strip_citations_ws(spark, d):
    return X.frame(spark, X.CITED, "id int, t string").select("id", T.collapse_space(T.strip_citations(F.col("t"))).alias("text"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\[\\d+\\]', '', 'g'), '[\\s\\x{85}\\p{Z}\\x0B\\x1C-\\x1F]+', ' ', 'g')) AS digest FROM documents")
def strip_citations_documents(spark, d):
    text = T.collapse_space(T.strip_citations(F.col("text")))
    return corpus.table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"))


@query(
    "SELECT q_id, regexp_replace(regexp_replace(answer, '(?is)\\n\\s*\\[?(References?|Sources?|Bibliography)\\]?[:\\-]?\\s*(\\n.*)?$', ''), '\\s+$', '') AS answer "
    f"FROM {X.sql(X.ANSWERS, 'q_id, answer')}"
)
def trailing_refs_strip(spark, d):
    return X.frame(spark, X.ANSWERS, "q_id int, answer string").select("q_id", T.strip_references(F.col("answer")).alias("answer"))


@query(
    "SELECT title_id, regexp_matches(title, '\\b(19|20)\\d{2}\\b') AS has_year, lower(title) LIKE 'list of%' OR lower(title) LIKE 'lists of%' AS is_list, "
    "contains(lower(title), 'disambiguation') AS is_disambiguation, contains(lower(title), 'index of') AS is_index, "
    "contains(lower(title), ' (tv series)') OR contains(lower(title), ' (film)') OR contains(lower(title), ' (tv show)') OR contains(lower(title), ' (television)') AS is_media, "
    f"replace(title, ' ', '_') AS slug, regexp_replace(title, '[^a-zA-Z]', '_', 'g') AS file_name FROM {X.sql(X.TITLES, 'title_id, title')}"
)
def title_kinds(spark, d):
    t = F.col("title")
    return _titles(spark).select(
        "title_id", T.has_year(t).alias("has_year"), T.is_list_page(t).alias("is_list"), T.is_disambiguation(t).alias("is_disambiguation"), T.is_index(t).alias("is_index"),
        T.is_media(t).alias("is_media"), T.slug(t).alias("slug"), T.file_name(t).alias("file_name"),
    )


@query(
    "SELECT article_id, regexp_matches(title, '\\b(19|20)\\d{2}\\b') AS has_year, lower(title) LIKE 'list of%' OR lower(title) LIKE 'lists of%' AS is_list, "
    f"replace(title, ' ', '_') AS slug, regexp_replace(title, '[^a-zA-Z]', '_', 'g') AS file_name FROM ({_PAGE})"
)
def page_title_kinds(spark, d):
    t = F.col("title")
    return _pages(spark, d).select("article_id", T.has_year(t).alias("has_year"), T.is_list_page(t).alias("is_list"), T.slug(t).alias("slug"), T.file_name(t).alias("file_name"))


@query("SELECT doc_id, substring(text, 1, 500) AS head, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def truncate_preview(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", T.truncate(F.col("text")).alias("head"), T.preview(F.col("text")).alias("preview"))


@query(
    f"SELECT q_id, pos::INT AS pos, TRY_CAST(x AS INTEGER) AS number FROM (SELECT q_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM "
    f"(SELECT q_id, regexp_extract_all(answer, '\\d+') AS xs FROM {X.sql(X.ANSWERS, 'q_id, answer')}))"
)
def extract_integers(spark, d):
    return X.frame(spark, X.ANSWERS, "q_id int, answer string").select("q_id", F.posexplode(T.integers(F.col("answer"))).alias("pos", "number"))


# --- understanding ------------------------------------------------------------


#: The literal questions beside those of the benchmark, whose numbers stay below the literal ones.
LITERAL = 1_000_000
_ASKED = f"SELECT q_id + {LITERAL} AS q_id, question FROM {X.sql(X.QUESTIONS, 'q_id, question')} UNION ALL {_BENCH}"


def _asked(spark, d):
    literal = _questions(spark).select((F.col("q_id") + LITERAL).cast("long").alias("q_id"), "question")
    return literal.unionByName(_bench(spark, d))


def _once(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def _capital(x: str) -> str:
    return f"CASE WHEN starts_with({x}, 'ß') THEN 'Ss' ELSE upper(substring({x}, 1, 1)) END || substring({x}, 2)"


_SPLIT = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
_PAIR = "CASE WHEN len(content) > {0} AND content[{0}] NOT IN {skip} AND content[{0} + 1] NOT IN {skip} THEN {cap} || ' ' || content[{0} + 1] END"
_FIT = f"length(w) >= 3 AND w NOT IN {_in(BLACKLIST)}"
#: Question understanding over (q_id, question) as a chain of tables that ends in u (q_id, question, terms, keywords, phrases, depth).
_UNDERSTOOD = f"""WITH src AS ({_ASKED}),
w AS (SELECT q_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT q_id, {_SPLIT.format("translate(question, '?,.', '')")} AS ws FROM src)),
caps AS (SELECT *, i - row_number() OVER (PARTITION BY q_id ORDER BY i) AS run FROM w WHERE regexp_matches(w, '^\\p{{Lu}}')),
begun AS (SELECT *, sum(CASE WHEN lower(w) IN {_in(STOPWORDS)} THEN 0 ELSE 1 END) OVER (PARTITION BY q_id, run ORDER BY i) AS n FROM caps),
runs AS (SELECT q_id, run, min(i) AS first, string_agg(w, ' ' ORDER BY i) AS phrase FROM begun WHERE n > 0 GROUP BY q_id, run),
n AS (SELECT q_id, list(phrase ORDER BY first) AS nouns FROM runs GROUP BY q_id),
b AS (SELECT src.q_id, question, coalesce(nouns, []) AS nouns,
    list_filter(list_transform(regexp_extract_all(question, '["'']([^"'']+)["'']', 1), lambda x: trim(x)), lambda x: length(x) > 2) AS quoted,
    list_transform(list_filter({_SPLIT.format("translate(lower(question), '?,.', '')")}, lambda w: length(w) > 3 AND trim(w, '?.,!:;''"') NOT IN {_in(STOPWORDS)}), lambda w: trim(w, '?.,!:;''"')) AS content
  FROM src LEFT JOIN n ON n.q_id = src.q_id),
t0 AS (SELECT *, list_filter(list_transform(list_filter(content[1:5], lambda w: w NOT IN {_in(SKIP_WORDS)} AND length(w) >= 4), lambda w: {_capital("w")}), lambda w: NOT list_contains(nouns, w)) AS singles,
    list_filter([{_PAIR.format(1, skip=_in(SKIP_WORDS), cap=_capital("content[1]"))}, {_PAIR.format(2, skip=_in(SKIP_WORDS), cap=_capital("content[2]"))}], lambda x: x IS NOT NULL) AS pairs FROM b),
t1 AS (SELECT *, list_concat(nouns[1:3], singles, pairs) AS more FROM t0),
t2 AS (SELECT *, list_concat(quoted, list_filter(more, lambda x, i: NOT list_contains(quoted, x) AND list_position(more, x) = i)) AS found FROM t1),
t3 AS (SELECT q_id, question, CASE WHEN len(found) > 0 THEN found[1:5] ELSE [question] END AS terms, regexp_extract_all(lower(question), '[a-z0-9'']+') AS raw FROM t2),
k0 AS (SELECT *, list_concat(list_filter(raw, lambda w: {_FIT}), list_filter(flatten(list_transform(terms, lambda t: regexp_split_to_array(lower(t), '[\\s\\-_/()]+'))), lambda w: {_FIT})) AS every FROM t3),
k1 AS (SELECT *, {_once("every")} AS base FROM k0),
k2 AS (SELECT *, list_concat(base, list_transform(range(1, len(base)), lambda i: base[i] || ' ' || base[i + 1])) AS both_ FROM k1),
k3 AS (SELECT *, CASE WHEN len(both_) > 0 THEN ({_once("both_")})[1:6] ELSE list_filter(raw, lambda w: length(w) >= 4)[1:1] END AS keywords,
    list_filter(list_transform(list_concat(list_transform(regexp_extract_all(question, '"[^"]+"|' || chr(39) || '[^' || chr(39) || ']+' || chr(39)), lambda x: substring(x, 2, length(x) - 2)),
      list_filter(terms, lambda t: contains(t, ' '))), lambda t: trim(t)), lambda t: len(regexp_extract_all(lower(t), '[a-z0-9]+')) >= 2) AS spans FROM k2),
u AS (SELECT q_id, question, terms, keywords, ({_once("spans")})[1:4] AS phrases, {_depth_sql("question")}::INT AS depth FROM k3)"""


def _listed(column: str, name: str) -> str:
    return f"{_UNDERSTOOD} SELECT q_id, generate_subscripts({column}, 1)::INT - 1 AS pos, unnest({column}) AS {name} FROM u"


@query(
    "SELECT q_id, pos::INT AS pos, term FROM (SELECT q_id, unnest(xs) AS term, generate_subscripts(xs, 1) - 1 AS pos FROM (SELECT q_id, "
    "list_filter(list_transform(regexp_extract_all(question, '[\"'']([^\"'']+)[\"'']', 1), lambda x: trim(x)), lambda x: length(x) > 2) AS xs "
    f"FROM {X.sql(X.QUESTIONS, 'q_id, question')}))"
)
def quoted_terms(spark, d):
    return _questions(spark).select("q_id", F.posexplode(U.quoted_terms(F.col("question"))).alias("pos", "term"))


@query(
    f"""WITH w AS (SELECT q_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT q_id, list_filter(regexp_split_to_array(translate(question, '?,.', ''), '\\s+'), lambda w: w <> '') AS ws FROM ({_BENCH}))),
c AS (SELECT *, regexp_matches(w, '^\\p{{Lu}}') AS cap FROM w),
r AS (SELECT *, i - row_number() OVER (PARTITION BY q_id ORDER BY i) AS run FROM c WHERE cap),
k AS (SELECT *, sum(CASE WHEN lower(w) IN {_in(STOPWORDS)} THEN 0 ELSE 1 END) OVER (PARTITION BY q_id, run ORDER BY i) AS begun FROM r)
SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY first) - 1)::INT AS pos, phrase FROM
(SELECT q_id, run, min(i) AS first, string_agg(w, ' ' ORDER BY i) AS phrase FROM k WHERE begun > 0 GROUP BY q_id, run)"""
)
def proper_noun_runs(spark, d):
    return _bench(spark, d).select("q_id", F.posexplode(U.proper_nouns(F.col("question"))).alias("pos", "phrase"))


@query(
    "SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY i) - 1)::INT AS pos, trim(w, '?.,!:;''\"') AS word FROM "
    "(SELECT q_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM "
    f"(SELECT q_id, list_filter(regexp_split_to_array(translate(lower(question), '?,.', ''), '\\s+'), lambda w: w <> '') AS ws FROM ({_BENCH}))) "
    f"WHERE length(w) > 3 AND trim(w, '?.,!:;''\"') NOT IN {_in(STOPWORDS)}"
)
def content_words(spark, d):
    return _bench(spark, d).select("q_id", F.posexplode(U.content_words(F.col("question"))).alias("pos", "word"))


@query(_listed("terms", "term"))
def search_terms(spark, d):
    return _asked(spark, d).select("q_id", F.posexplode(U.search_terms(F.col("question"))).alias("pos", "term"))


@query(_listed("keywords", "keyword"))
def primary_keywords(spark, d):
    return _asked(spark, d).select("q_id", F.posexplode(U.primary_keywords(F.col("question"))).alias("pos", "keyword"))


@query(_listed("phrases", "phrase"))
def focus_phrases(spark, d):
    return _asked(spark, d).select("q_id", F.posexplode(U.focus_phrases(F.col("question"))).alias("pos", "phrase"))


@query(_UNDERSTOOD + " SELECT q_id, depth FROM u")
def question_depth(spark, d):
    return _asked(spark, d).select("q_id", U.depth(F.col("question")).alias("depth"))


@query()
def understand_benchmark(spark, d):
    return U.understand(_bench(spark, d))


@query(f"SELECT depth::INT AS depth, count(*) AS n FROM (SELECT {_depth_sql('text')} AS depth FROM conversations WHERE role = 'user') GROUP BY depth")
def complexity_histogram(spark, d):
    turns = corpus.user_turns(corpus.table(spark, d, "conversations"))
    return turns.groupBy(U.depth(F.col("question")).alias("depth")).agg(F.count("*").alias("n"))


# --- matching -----------------------------------------------------------------

_KW = f"SELECT q_id, list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), lambda w: length(w) >= 3 AND w NOT IN {_in(BLACKLIST)}) AS kws FROM ({_BENCH})"


def _simple_keywords(spark, d):
    words = F.array_distinct(T.norm_tokens(F.col("question")))
    return _bench(spark, d).select("q_id", F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(BLACKLIST)).alias("keywords"))


def _grams(text: str):
    """Different runs of three characters of a column; none where it is shorter."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    return F.filter(F.array_distinct(F.transform(spots, lambda i: F.substr(text, i, F.lit(3)))), lambda g: F.length(g) == 3)


def _holding(keyed, texts, id_col: str, text_col: str):
    """(q_id, id): pairs of which some keyword's rarest run of three characters is in the text.

    Whatever holds a keyword holds its rarest run, so no pair is lost, and keywords with
    a run that no text has meet none. Keywords of the queries here have three characters
    or more; texts meet them on runs, never pair by pair, and stay out of that join.
    """
    words = keyed.select(F.explode("keywords").alias("kw")).distinct().withColumn("gram", F.explode(_grams("kw")))
    spread = texts.select(id_col, F.explode(_grams(text_col)).alias("gram"))
    counts = spread.join(words.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = words.join(counts, "gram", "left").groupBy("kw").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    asked = keyed.select("q_id", F.explode("keywords").alias("kw")).join(corpus.settle(rarest), "kw").select("q_id", "gram").distinct()
    return spread.join(asked, "gram").select("q_id", id_col).distinct()


def _trigram_pairs(keyed, articles):
    """(q_id, keywords, article_id, hits): pairs with a keyword inside the title."""
    named = articles.withColumn("name", T.normalize(F.col("title")))
    pairs = _holding(keyed, named, "article_id", "name").join(articles.select("article_id", "title"), "article_id").join(keyed, "q_id")
    return pairs.select("q_id", "keywords", "article_id", "title", M.keyword_hits(F.col("title"), F.col("keywords")).cast("int").alias("hits")).filter("hits > 0")


@query(
    f"WITH k AS ({_KW}), p AS (SELECT article_id, {_norm('title')} AS name FROM ({_PAGE})) "
    "SELECT q_id, article_id, hits::INT AS hits FROM (SELECT q_id, article_id, len(list_filter(kws, lambda w: contains(name, w))) AS hits FROM k CROSS JOIN p) WHERE hits > 0"
)
def keyword_hits(spark, d):
    return _trigram_pairs(_simple_keywords(spark, d), _pages(spark, d)).select("q_id", "article_id", "hits")


@query(
    f"WITH k AS ({_KW}), p AS (SELECT article_id, {_norm('title')} AS name FROM ({_PLAIN})) SELECT q_id, count(*) AS n_matches FROM "
    "(SELECT q_id, len(kws) AS n, len(list_filter(kws, lambda w: contains(name, w))) AS hits FROM k CROSS JOIN p) "
    "WHERE n > 0 AND hits >= CASE WHEN n >= 3 THEN 2 ELSE 1 END GROUP BY q_id"
)
def keyword_match(spark, d):
    pairs = _trigram_pairs(_simple_keywords(spark, d), _plain(spark, d))
    return pairs.filter(M.matches_keywords(F.col("title"), F.col("keywords"))).groupBy("q_id").agg(F.count("*").alias("n_matches"))


@query(
    f"SELECT q_id, title_id FROM (SELECT q_id, {_norm('phrase')} AS p FROM {X.sql(X.listed(X.PHRASES), 'q_id, pos, phrase')}) "
    f"CROSS JOIN (SELECT title_id, {_norm('title')} AS t FROM {X.sql(X.TITLES, 'title_id, title')} ) "
    "WHERE regexp_matches(t, '(^| )' || replace(p, ' ', '( .*)? ') || '( |$)') GROUP BY q_id, title_id"
)
def phrase_subsequence(spark, d):
    asked = _questions(spark).select("q_id", U.focus_phrases(F.col("question")).alias("phrases"))
    index = corpus.title_index(_titles(spark))
    tokens = asked.select("q_id", "phrases", F.explode(F.array_distinct(F.flatten(F.transform("phrases", T.norm_tokens)))).alias("token"))
    pairs = tokens.join(index, "token").select("q_id", "phrases", "title_id", "title").distinct()
    return pairs.filter(M.matches_phrase(F.col("title"), F.col("phrases"))).select("q_id", "title_id")


@query(
    f"WITH k AS ({_KW}), a AS (SELECT doc_id, lower(substring(text, 1, 500)) AS a FROM documents) "
    "SELECT q_id, count(*) AS n_hits FROM k CROSS JOIN a WHERE len(list_filter(kws, lambda w: contains(a, w))) > 0 GROUP BY q_id"
)
def abstract_keyword_hit(spark, d):
    low = corpus.table(spark, d, "documents").select("doc_id", T.truncate(F.col("text")).alias("abstract"), F.lower(T.truncate(F.col("text"))).alias("a"))
    keyed = _simple_keywords(spark, d)
    pairs = _holding(keyed, low, "doc_id", "a").join(low.select("doc_id", "abstract"), "doc_id").join(keyed, "q_id")
    return pairs.filter(M.abstract_hit(F.col("abstract"), F.col("keywords"))).groupBy("q_id").agg(F.count("*").alias("n_hits"))


# --- retrieval ----------------------------------------------------------------

#: Literal titles stand among the pages, with numbers of their own: media titles, list pages and topics of the literal questions.
_ARTICLES = f"SELECT article_id, title, url, {_norm('title')} AS name FROM ({_PAGE} UNION ALL SELECT title_id + {LITERAL}, title, 'lit' FROM {X.sql(X.TITLES, 'title_id, title')})"
_WORD = "[a-z0-9]+"
_SEARCH = f"""{_UNDERSTOOD}, p AS ({_ARTICLES}),
t AS (SELECT q_id, depth, unnest(terms) AS term, generate_subscripts(terms, 1)::INT - 1 AS term_pos FROM u),
tok AS (SELECT article_id, unnest(list_distinct(regexp_extract_all(name, '{_WORD}'))) AS token FROM p),
ask AS (SELECT q_id, term_pos, unnest(list_distinct(regexp_extract_all(lower(term), '{_WORD}'))) AS token FROM t),
h AS (SELECT q_id, term_pos, article_id, count(*) AS words FROM ask JOIN tok USING (token) GROUP BY q_id, term_pos, article_id),
x AS (SELECT h.q_id, h.term_pos, h.article_id, title, url, depth,
  (CASE WHEN name = {_norm("term")} THEN 1000 ELSE 0 END + CASE WHEN starts_with(name, {_norm("term")}) THEN 100 ELSE 0 END + 10 * words)::INT AS search_score
  FROM h JOIN t ON t.q_id = h.q_id AND t.term_pos = h.term_pos JOIN p ON p.article_id = h.article_id),
s AS (SELECT *, row_number() OVER (PARTITION BY q_id, term_pos ORDER BY search_score DESC, length(title), article_id)::INT AS "rank" FROM x QUALIFY "rank" <= depth)"""
_FIRST = _SEARCH + """, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q_id, lower(title) ORDER BY term_pos, "rank") = 1)"""


def _articles(spark, d):
    literal = _titles(spark).select((F.col("title_id") + LITERAL).cast("long").alias("article_id"), "title", F.lit("lit").alias("url"))
    return _pages(spark, d).unionByName(literal)


def _found(spark, d):
    understood = U.understand(_asked(spark, d))
    return retrieve.search(retrieve.explode_terms(understood), corpus.title_index(_articles(spark, d)))


@query(_SEARCH + ' SELECT q_id, term_pos, "rank", article_id, title, url, search_score FROM s')
def search_topk_per_term(spark, d):
    return _found(spark, d)


_BODY = _SEARCH[: _SEARCH.index(", p AS (")] + f""", p AS (SELECT article_id, title, '' AS url, {_norm('title')} AS name FROM ({_PLAIN})),
t AS (SELECT q_id, depth, unnest(terms) AS term, generate_subscripts(terms, 1)::INT - 1 AS term_pos FROM u),
tok AS (SELECT article_id, 10 AS points, unnest(list_distinct(regexp_extract_all(name, '{_WORD}'))) AS token FROM p
  UNION ALL SELECT doc_id, 1, unnest(list_distinct(regexp_extract_all(lower(text), '{_WORD}'))) FROM documents),
ask AS (SELECT q_id, term_pos, unnest(list_distinct(regexp_extract_all(lower(term), '{_WORD}'))) AS token FROM t),
h AS (SELECT q_id, term_pos, article_id, sum(points) AS points FROM ask JOIN tok USING (token) GROUP BY q_id, term_pos, article_id),
x AS (SELECT h.q_id, h.term_pos, h.article_id, title, depth,
  (CASE WHEN name = {_norm("term")} THEN 1000 ELSE 0 END + CASE WHEN starts_with(name, {_norm("term")}) THEN 100 ELSE 0 END + points)::INT AS search_score
  FROM h JOIN t ON t.q_id = h.q_id AND t.term_pos = h.term_pos JOIN p ON p.article_id = h.article_id)
SELECT q_id, term_pos, row_number() OVER (PARTITION BY q_id, term_pos ORDER BY search_score DESC, length(title), article_id)::INT AS "rank", article_id, search_score FROM x QUALIFY "rank" <= depth"""


@query(_BODY)
def search_with_bodies(spark, d):
    documents = corpus.table(spark, d, "documents")
    articles = corpus.plain_articles(documents).withColumn("url", F.lit(""))
    bodies = corpus.body_index(documents.select(F.col("doc_id").alias("article_id"), "text"), articles)
    terms = corpus.settle(retrieve.explode_terms(U.understand(_asked(spark, d))))
    return retrieve.search(terms, corpus.title_index(articles), bodies=bodies).select("q_id", "term_pos", "rank", "article_id", "search_score")


@query(_FIRST + ' SELECT q_id, term_pos, "rank", article_id FROM f')
def dedup_first_wins(spark, d):
    return retrieve.first_wins(_found(spark, d)).select("q_id", "term_pos", "rank", "article_id")


@query(_FIRST + ' , c AS (SELECT *, (SELECT count(*) FROM f g WHERE g.q_id = f.q_id AND g.term_pos < f.term_pos) AS b FROM f) SELECT q_id, term_pos, "rank", article_id FROM c WHERE b < 3')
def soft_cap(spark, d):
    return retrieve.soft_cap(retrieve.first_wins(_found(spark, d)), 3).select("q_id", "term_pos", "rank", "article_id")


_LOOKUP_TERMS = [(1, 0, "Dune"), (1, 1, "The Expanse"), (2, 0, "Photosynthesis"), (2, 1, "NASA"), (3, 3, "NASA"), (4, 0, "Nowhere")]


def _lookup(spark):
    terms = X.frame(spark, _LOOKUP_TERMS, "q_id int, term_pos int, term string")
    articles = _titles(spark).select(F.col("title_id").alias("article_id"), "title", F.lit("u").alias("url"))
    seen = X.frame(spark, [(2, "nasa"), (5, "Dune (film)")], "q_id int, title string")
    return terms, articles, seen


_LOOKUP = f"WITH t AS (SELECT * FROM {X.sql(_LOOKUP_TERMS, 'q_id, term_pos, term')}), a AS (SELECT * FROM {X.sql(X.TITLES, 'article_id, title')}), seen AS (SELECT * FROM (VALUES (2, 'nasa'), (5, 'dune (film)')) AS s(q_id, low))"


@query(_LOOKUP + " SELECT t.q_id, term_pos, article_id FROM t JOIN a ON a.title = t.term WHERE term_pos < 3 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.q_id = t.q_id AND low = lower(a.title))")
def direct_lookup(spark, d):
    return retrieve.direct_lookup(*_lookup(spark)).select("q_id", "term_pos", "article_id")


@query(
    _LOOKUP + ", x(s, k) AS (VALUES (' (TV series)', 0), (' (film)', 1), (' (TV show)', 2), (' (television)', 3)) SELECT t.q_id, term_pos, article_id FROM t CROSS JOIN x JOIN a ON a.title = term || s "
    "WHERE term_pos < 3 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.q_id = t.q_id AND low = lower(a.title)) QUALIFY row_number() OVER (PARTITION BY t.q_id, term_pos ORDER BY k) = 1"
)
def media_lookup(spark, d):
    return retrieve.media_lookup(*_lookup(spark)).select("q_id", "term_pos", "article_id")


@query(f"SELECT article_id FROM ({_PAGE}) p WHERE NOT EXISTS (SELECT 1 FROM ({_PLAIN}) q WHERE lower(q.title) = lower(p.title))")
def unseen_anti_join(spark, d):
    low = _plain(spark, d).select(F.lower("title").alias("low")).distinct()
    return _pages(spark, d).join(low, F.lower("title") == F.col("low"), "left_anti").select("article_id")


# ordered and ranked candidates share one SQL chain; five terms of at most six articles never reach the soft cap of a hundred
_HITS = f"len(list_filter(keywords, lambda k: {_norm('k')} <> '' AND contains({_norm('title')}, {_norm('k')})))"
_MATCH = f"(len(keywords) = 0 OR {_HITS} >= CASE WHEN len(keywords) >= 3 THEN 2 ELSE 1 END)"
_PHRASE = f"(len(list_filter(phrases, lambda k: {_norm('k')} <> '' AND regexp_matches({_norm('title')}, '(^| )' || replace({_norm('k')}, ' ', '( .*)? ') || '( |$)'))) > 0)"
_ORDER = _FIRST + f""", sx(suffix, suffix_pos) AS (VALUES (' (TV series)', 0), (' (film)', 1), (' (TV show)', 2), (' (television)', 3)),
media AS (SELECT t.q_id, term_pos, article_id, title, url FROM t CROSS JOIN sx JOIN p ON p.title = t.term || suffix WHERE term_pos < 3
  AND NOT EXISTS (SELECT 1 FROM f WHERE f.q_id = t.q_id AND lower(f.title) = lower(p.title)) QUALIFY row_number() OVER (PARTITION BY t.q_id, term_pos ORDER BY suffix_pos, article_id) = 1),
direct AS (SELECT t.q_id, term_pos, article_id, title, url FROM t JOIN p ON p.title = t.term WHERE term_pos < 3
  AND NOT EXISTS (SELECT 1 FROM f WHERE f.q_id = t.q_id AND lower(f.title) = lower(p.title)) AND NOT EXISTS (SELECT 1 FROM media m WHERE m.q_id = t.q_id AND lower(m.title) = lower(p.title))),
sides AS (SELECT q_id, 0 AS side, -term_pos AS a, 0 AS b, article_id, title, url FROM direct UNION ALL SELECT q_id, 1, -term_pos, 0, article_id, title, url FROM media
  UNION ALL SELECT q_id, 2, term_pos, "rank", article_id, title, url FROM f),
merged AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY q_id, lower(title) ORDER BY side, a, b, article_id) = 1),
m AS (SELECT merged.*, keywords, phrases, depth, {_MATCH} AS kw, {_PHRASE} AS ph, row_number() OVER (PARTITION BY merged.q_id ORDER BY side, a, b, article_id) AS p0 FROM merged JOIN u ON u.q_id = merged.q_id),
o AS (SELECT *, (row_number() OVER (PARTITION BY q_id ORDER BY ph DESC, CASE WHEN len(keywords) > 0 AND kw THEN 1 ELSE 0 END DESC, p0) - 1)::INT AS pos FROM m)"""


def _ordered(spark, d):
    articles = _articles(spark, d)
    return retrieve.candidates(corpus.settle(U.understand(_asked(spark, d))), articles, corpus.title_index(articles))


@query(_ORDER + " SELECT q_id, pos, article_id FROM o")
def priority_order(spark, d):
    return _ordered(spark, d).select("q_id", "pos", "article_id")


@query(_ORDER + " SELECT q_id, article_id, ph AS phrase_hit, kw AS keyword_hit FROM m")
def candidate_flags(spark, d):
    title = F.col("title")
    return _ordered(spark, d).select("q_id", "article_id", M.matches_phrase(title, F.col("phrases")).alias("phrase_hit"), M.matches_keywords(title, F.col("keywords")).alias("keyword_hit"))


_MEDIA = " OR ".join(f"contains(lower(title), '{x}')" for x in (" (tv series)", " (film)", " (tv show)", " (television)"))
_SCORE = _ORDER + f""", sc AS (SELECT o.*, text AS abstract, (CASE WHEN {_MEDIA} THEN 100 ELSE 0 END
  + CASE WHEN bool_or(ph) OVER (PARTITION BY q_id) THEN CASE WHEN ph THEN 200 ELSE -90 END ELSE 0 END
  + CASE WHEN length(coalesce(text, '')) > 200 THEN 20 WHEN length(coalesce(text, '')) > 100 THEN 10 ELSE 0 END
  + CASE WHEN len(keywords) > 0 AND len(list_filter(keywords, lambda w: contains(lower(coalesce(text, '')), w))) > 0 THEN 25 ELSE 0 END
  + CASE WHEN length(title) < 30 THEN 5 ELSE 0 END + CASE WHEN len(keywords) > 0 THEN CASE WHEN kw THEN 80 ELSE -60 END ELSE 0 END
  - CASE WHEN lower(title) LIKE 'list of%' OR lower(title) LIKE 'lists of%' THEN 50 ELSE 0 END
  - CASE WHEN contains(lower(title), 'disambiguation') OR contains(lower(title), 'index of') THEN 40 ELSE 0 END)::INT AS score
  FROM o LEFT JOIN (SELECT doc_id, substring(text, 1, 500) AS text FROM documents) ON doc_id = article_id),
rk AS (SELECT *, count(*) OVER (PARTITION BY q_id) <= depth AS bypass FROM sc),
rr AS (SELECT *, (CASE WHEN bypass THEN row_number() OVER (PARTITION BY q_id ORDER BY pos) ELSE row_number() OVER (PARTITION BY q_id ORDER BY score DESC, pos) END)::INT AS "rank" FROM rk)"""


def _ranked(spark, d):
    """Pages have no plain abstract, so the document of the same number lends its beginning."""
    abstracts = corpus.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), T.truncate(F.col("text")).alias("abstract"))
    return rank.rank(rank.score(corpus.settle(_ordered(spark, d)).join(abstracts, "article_id", "left")))


@query(_SCORE + " SELECT q_id, article_id, score FROM rr")
def relevance_score(spark, d):
    return _ranked(spark, d).select("q_id", "article_id", "score")


@query(_SCORE + ' SELECT q_id, article_id, title, score, pos, "rank" FROM rr')
def rank_candidates(spark, d):
    return _ranked(spark, d).select("q_id", "article_id", "title", "score", "pos", "rank")


@query(_SCORE + " SELECT q_id, count(*) AS n FROM rr WHERE bypass GROUP BY q_id")
def bypass_small(spark, d):
    return _ranked(spark, d).filter("bypass").groupBy("q_id").agg(F.count("*").alias("n"))


@query(
    _SCORE + """, l AS (SELECT *, CASE WHEN length(coalesce(abstract, '')) > 30 THEN title || ' - ' || CASE WHEN length(abstract) > 200 THEN substring(abstract, 1, 200) || '...' ELSE abstract END
  WHEN NOT (lower(title) LIKE 'list of%' OR lower(title) LIKE 'lists of%') THEN title || ' (main article)' END AS line FROM rr WHERE "rank" <= 30)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY "rank")::INT AS display_no, "rank", title, line FROM l WHERE line IS NOT NULL"""
)
def shortlist_numbering(spark, d):
    return rank.shortlist(_ranked(spark, d))


@query(
    f"WITH s AS (SELECT q_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT q_id, regexp_extract_all(answer, '\\d+') AS xs FROM {X.sql(X.ANSWERS, 'q_id, answer')})), "
    "n AS (SELECT q_id, TRY_CAST(x AS INTEGER) AS no, min(i) AS i FROM s WHERE TRY_CAST(x AS INTEGER) BETWEEN 1 AND 5 GROUP BY 1, 2) "
    'SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY i)::INT AS pick, (no + 10)::INT AS "rank" FROM n QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY i) <= 3'
)
def parse_selection(spark, d):
    answers = X.frame(spark, X.ANSWERS, "q_id int, answer string")
    shown = answers.select("q_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("display_no")).withColumn("rank", F.col("display_no") + 10)
    return rank.parse_selection(answers, shown, F.lit(3))


@query(
    _SCORE + """, g AS (SELECT *, NOT (lower(title) LIKE 'list of%' OR lower(title) LIKE 'lists of%' OR regexp_matches(title, '\\b(19|20)\\d{2}\\b') OR contains(lower(title), 'disambiguation')) AS clean FROM rr),
a AS (SELECT *, CASE WHEN len(keywords) = 0 THEN clean WHEN bool_or(clean AND kw) OVER own THEN clean AND kw WHEN bool_or(kw) OVER own THEN kw ELSE clean END AS a1 FROM g WINDOW own AS (PARTITION BY q_id)),
a2 AS (SELECT *, CASE WHEN len(phrases) > 0 AND bool_or(a1 AND ph) OVER (PARTITION BY q_id) THEN a1 AND ph ELSE a1 END AS a3 FROM a),
a4 AS (SELECT *, bool_or(a3) OVER (PARTITION BY q_id) AS any_left FROM a2),
c AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY "rank")::INT AS pick FROM a4 WHERE bypass OR a3 OR NOT any_left)
SELECT q_id, article_id, "rank", pick FROM c WHERE bypass OR pick <= depth"""
)
def fallback_select(spark, d):
    return rank.fallback_select(_ranked(spark, d)).select("q_id", "article_id", "rank", "pick")


@query("SELECT n::INT AS n, (CASE n WHEN 3 THEN 20 WHEN 4 THEN 15 WHEN 5 THEN 12 WHEN 6 THEN 10 WHEN 7 THEN 8 ELSE 15 END)::INT AS paragraphs FROM range(1, 10) AS r(n)")
def depth_lookup(spark, d):
    return spark.range(1, 10).select(F.col("id").cast("int").alias("n"), rank.depth_of(F.col("id")).alias("paragraphs"))


# --- contents -----------------------------------------------------------------

_PARA = "SELECT doc_id AS article_id, unnest(string_split(text, chr(10))) AS paragraph, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_pos FROM documents"
_BUDGET = f"SELECT * FROM (SELECT *, sum(length(paragraph)) OVER (PARTITION BY article_id ORDER BY para_pos)::BIGINT AS running FROM ({_PARA}) WHERE para_pos < 15 AND length(paragraph) > 50) WHERE running <= 8000"


def _budget(spark, d):
    return content.budget(content.plain_paragraphs(corpus.table(spark, d, "documents")), 15)


@query(f"SELECT article_id, para_pos::INT AS para_pos, paragraph FROM ({_PARA})")
def plain_paragraphs(spark, d):
    return content.plain_paragraphs(corpus.table(spark, d, "documents"))


@query(f"SELECT article_id, para_pos::INT AS para_pos, running FROM ({_BUDGET})")
def para_budget(spark, d):
    return _budget(spark, d).select("article_id", "para_pos", "running")


@query(
    f"SELECT article_id, regexp_replace(regexp_replace(string_agg(paragraph, chr(10) || chr(10) ORDER BY para_pos), '\\[\\d+\\]', '', 'g'), '\\s+', ' ', 'g') AS content FROM ({_BUDGET}) GROUP BY article_id"
)
def article_content(spark, d):
    return content.contents(_budget(spark, d))


@query(f"SELECT article_id, substring(arg_min(paragraph, para_pos), 1, 500) AS abstract FROM ({_PARA}) WHERE length(paragraph) > 100 GROUP BY article_id")
def plain_abstract(spark, d):
    return content.abstracts(content.plain_paragraphs(corpus.table(spark, d, "documents")))


@query()
def html_paragraphs(spark, d):
    return html.explode_paragraphs(corpus.table(spark, d, "pages"))


@query()
def html_abstract(spark, d):
    return content.abstracts(html.explode_paragraphs(corpus.table(spark, d, "pages")))


@query()
def html_content(spark, d):
    return content.contents(content.budget(html.explode_paragraphs(corpus.table(spark, d, "pages")), 15))


# --- assembly -----------------------------------------------------------------

_SELECTED = _SQL["fallback_select"].replace('SELECT q_id, article_id, "rank", pick FROM c WHERE bypass OR pick <= depth', ", sel AS (SELECT * FROM c WHERE bypass OR pick <= depth)").replace(")\n, sel", "), sel")
_CITED = _SELECTED + f""", ct AS ({_SQL['article_content']}),
nu AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY pick)::INT AS cite_no, sel.article_id, title, url, content FROM sel JOIN ct ON ct.article_id = sel.article_id WHERE content <> '')"""


def _sources(spark, d):
    return content.number_sources(rank.fallback_select(_ranked(spark, d)), article_content(spark, d))


@query(_CITED + " SELECT q_id, cite_no, article_id, title FROM nu")
def number_sources(spark, d):
    return _sources(spark, d).select("q_id", "cite_no", "article_id", "title")


@query(
    _CITED + """ SELECT q_id, string_agg('[Article ' || cite_no || '] **' || title || '**:' || chr(10) || content, chr(10) || chr(10) ORDER BY cite_no) AS context,
string_agg('[' || cite_no || '] ' || title, chr(10) ORDER BY cite_no) AS source_list, count(*) AS n_sources FROM nu GROUP BY q_id"""
)
def build_context(spark, d):
    return assemble.contexts(_sources(spark, d))


_LISTED = _SQL["shortlist_numbering"].replace("SELECT q_id, row_number()", ", sl AS (SELECT q_id, row_number()").replace("\n, sl", ", sl") + ")"


@query(
    _LISTED + """, li AS (SELECT q_id, string_agg(display_no || '. ' || line, chr(10) ORDER BY display_no) AS lines FROM sl GROUP BY q_id)
SELECT li.q_id, 'Choose up to ' || depth || ' articles that answer the question.' || chr(10) || 'Question: ' || question
  || CASE WHEN len(keywords) > 0 THEN chr(10) || 'Keywords: ' || array_to_string(keywords[1:4], ', ') ELSE '' END
  || CASE WHEN len(phrases) > 0 THEN chr(10) || 'Topic: ' || array_to_string(phrases[1:2], '; ') ELSE '' END
  || chr(10) || 'Articles:' || chr(10) || lines || chr(10) || 'Reply with their numbers only, separated by commas.' AS prompt FROM li JOIN u ON u.q_id = li.q_id"""
)
def build_prompt(spark, d):
    return assemble.selection_prompts(rank.shortlist(_ranked(spark, d)), U.understand(_asked(spark, d)))


@query(
    _CITED + """, cx AS (SELECT q_id, string_agg('[Article ' || cite_no || '] **' || title || '**:' || chr(10) || content, chr(10) || chr(10) ORDER BY cite_no) AS context,
  string_agg('[' || cite_no || '] ' || title, chr(10) ORDER BY cite_no) AS source_list FROM nu GROUP BY q_id)
SELECT cx.q_id, md5('Answer from the articles below. Begin with a direct verdict, cite [n] after each fact, and add no list of references.' || chr(10) || 'Question: ' || question
  || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Articles:' || chr(10) || source_list) AS digest FROM cx JOIN u ON u.q_id = cx.q_id"""
)
def build_answer_prompt(spark, d):
    context = assemble.contexts(_sources(spark, d)).join(_asked(spark, d), "q_id")
    return context.select("q_id", F.md5(assemble.answer_prompt(F.col("question"), F.col("context"), F.col("source_list"))).alias("digest"))


@query(_CITED + " SELECT q_id, string_agg(split_part(content, '.', 1) || '. [' || cite_no || ']', ' ' ORDER BY cite_no) AS answer FROM nu GROUP BY q_id")
def answer_extractive(spark, d):
    return assemble.extractive_answer(_sources(spark, d))


@query(
    f"SELECT q_id, CASE WHEN len(xs) > 0 THEN 'No article content was found. Try spelling out: ' || array_to_string(list_transform(xs[1:3], lambda x: '''' || x || ''''), ', ') "
    "ELSE 'No article content was found. Try other words.' END AS message FROM (SELECT q_id, list_filter(regexp_split_to_array(translate(question, '?,.', ''), '\\s+'), "
    f"lambda w: regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]') AND length(w) BETWEEN 2 AND 5) AS xs FROM {X.sql(X.QUESTIONS, 'q_id, question')})"
)
def missing_content_help(spark, d):
    return _questions(spark).select("q_id", assemble.missing_content(F.col("question")).alias("message"))


def _model_sql(preferences: list[str], avoid: bool) -> str:
    prefs = X.sql([(i, n, n.split(":")[0]) for i, n in enumerate(preferences)], "r, wanted, family")
    usable = "WHERE NOT contains(lower(name), 'r1') AND NOT contains(lower(name), 'deepseek')" if avoid else ""
    return (
        f"WITH a AS (SELECT * FROM {X.sql(X.MODELS, 'case_id, pos, name')}), b AS (SELECT case_id, name FROM a JOIN (SELECT * FROM {prefs}) ON starts_with(name, family) "
        "QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY r, name <> wanted, pos) = 1), "
        f"l AS (SELECT case_id, arg_min(name, pos) AS name FROM a {usable} GROUP BY case_id) "
        "SELECT case_id, coalesce(b.name, l.name) AS name FROM b FULL JOIN l USING (case_id)"
    )


@query(_model_sql(SELECTION_MODELS, True))
def select_model(spark, d):
    return models.preferred(X.frame(spark, X.MODELS, "case_id int, pos int, name string"), SELECTION_MODELS, ["r1", "deepseek"])


@query(_model_sql(SYNTHESIS_MODELS, False))
def synth_model(spark, d):
    return models.preferred(X.frame(spark, X.MODELS, "case_id int, pos int, name string"), SYNTHESIS_MODELS)


# --- measures and checks --------------------------------------------------------


@query("SELECT role, count(*) AS n_turns, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS tokens FROM conversations GROUP BY role")
def tokens_per_role(spark, d):
    turns = corpus.table(spark, d, "conversations")
    return turns.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(F.size(T.words(F.col("text")))).alias("tokens"))


@query(
    "SELECT event_type AS model, count(*)::BIGINT AS tokens, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds, "
    "round(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 6) AS tokens_per_s FROM events GROUP BY event_type"
)
def token_rate(spark, d):
    chunks = corpus.table(spark, d, "events").select(F.col("event_type").alias("model"), "ts", F.lit("token").alias("text"))
    return models.token_rate(chunks).select("model", "tokens", F.round("seconds", 3).alias("seconds"), F.round("tokens_per_s", 6).alias("tokens_per_s"))


@query(f"SELECT CASE WHEN ok THEN 'PASS' WHEN NOT ok THEN 'FAIL' ELSE 'SKIP' END AS status, count(*) AS n FROM {X.sql(X.OUTCOMES, 'id, ok')} GROUP BY 1")
def status_summary(spark, d):
    status = F.when(F.col("ok"), "PASS").when(~F.col("ok"), "FAIL").otherwise("SKIP")
    return X.frame(spark, X.OUTCOMES, "id int, ok boolean").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT 83::BIGINT AS n_stop, 48::BIGINT AS n_skip, 127::BIGINT AS n_union, 4::BIGINT AS n_both")
def lexicon_invariants(spark, d):
    stop, skip = (spark.createDataFrame([(w,) for w in ws], "w string") for ws in (STOPWORDS, SKIP_WORDS))
    row = F.lit(1).alias("one")
    parts = [stop.agg(F.count("*").alias("n_stop")), skip.agg(F.count("*").alias("n_skip")), stop.union(skip).distinct().agg(F.count("*").alias("n_union")), stop.intersect(skip).agg(F.count("*").alias("n_both"))]
    out = parts[0].select("*", row)
    for p in parts[1:]:
        out = out.join(p.select("*", row), "one")
    return out.drop("one")


@query()
def ask_end_to_end(spark, d):
    pages = corpus.table(spark, d, "pages")
    return A.ask(_bench(spark, d), pages, bodies=A.page_bodies(pages))
