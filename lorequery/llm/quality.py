"""Quality rules, line first: lines that fail go, then documents that lose too much of their text.

A line fails for its marks (symbols in the place of punctuation), as navigation (cells,
menus, short links without a sentence) or as boilerplate (notices, policy lines, lines
that repeat an earlier one). Base rules on the whole text come first.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import map_text

#: Base rules: fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: A line fails with more symbols, or exclamation marks, a word; a document with more of its word characters lost.
SYMBOLS_A_WORD, SHOUTS_A_WORD, MAX_LOST = 0.3, 0.3, 0.5
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = re.compile(r"[#*$%&|<>]").findall
_END = r"""[.!?…。！？:;]["'»”’)\]]*$"""
_MENU = r"home|menu|login|log in|sign (?:in|up)|next|previous|back(?: to top)?|read more|skip to content|share|search|contact(?: us)?|about(?: us)?|sitemap"
_NOTICE = r"all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|uses? cookies|javascript|subscribe to our|click here|powered by|lorem ipsum|copyright"
_CELLS = ("|", "»", "›", ">", "·", "•", "/")
_END_MARK = re.compile(_END)
_NAVIGATION = re.compile(rf"(?i)^(?:{_MENU})\b")
_BOILERPLATE = re.compile(rf"(?i)\b(?:{_NOTICE})\b|©")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in windows of three found twice or more)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORDS(text)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = -1  # the last word counted
        for i, window in enumerate(windows):
            if window in often:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    lines, again = set(), 0
    for line in text.split("\n"):
        if line in lines:
            again += 1
        elif WORDS(line):
            lines.add(line)
    return len(words), sum(map(len, words)), len(SYMBOLS(text)), again, repeated


def line_fails(line: str, words: list[str], seen: bool) -> bool:
    """Whether a line with words goes. A short line without an end mark counts as navigation only by its words."""
    n = len(words)
    return bool(
        seen
        or len(SYMBOLS(line)) > SYMBOLS_A_WORD * n
        or (n > 2 and line.count("!") > SHOUTS_A_WORD * n)
        or (n > 3 and sum(w in _CELLS for w in words) > 0.2 * n)
        or (n <= 6 and not _END_MARK.search(line.rstrip()) and _NAVIGATION.match(line.strip()))
        or (n <= 20 and _BOILERPLATE.search(line))
    )


def clean(text: str | None) -> tuple[str, int]:
    """The lines that stay, and the code points of words in those that go. Lines without a word stay."""
    kept, lost, seen = [], 0, set()
    for line in (text or "").split("\n"):
        words = WORDS(line)
        if words and line_fails(line, words, line in seen):
            lost += sum(map(len, words))
        else:
            kept.append(line)
        if words:
            seen.add(line)
    return "\n".join(kept), lost


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars[, cleaned]).

    Null texts have no words, hence fail the base rules, as empty ones do; repeated rows
    get equal results; empty input none; other columns are ignored. kept: the base
    rules hold and at most MAX_LOST of the word characters are lost with failing lines.
    """
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"

    def start():
        def apply(texts):
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "cleaned"]
            rows = []
            for text in texts:
                n, chars, symbols, again, repeated = counts(text)
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT * n
                cleaned, lost = clean(text)
                rows.append((n, chars, symbols, again, repeated, failed, not failed and lost <= MAX_LOST * chars, lost, cleaned if with_text else None))
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        return apply

    return map_text(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text", start, schema + (", cleaned string" if with_text else ""))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for judge() of a table."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    word, edge = quote(r"[^\x20\x09-\x0D]+"), r"[^\p{L}\p{N}_]"
    end, menu, notice = quote(_END), quote(rf"(?i)^(?:{_MENU})(?:$|{edge})"), quote(rf"(?i)(?:^|{edge})(?:{_NOTICE})(?:$|{edge})|©")
    space = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
    strip = quote(rf"^{space}|{space}$")
    symbols = lambda s: f"length(regexp_replace({s}, '[^#*$%&|<>]', '', 'g'))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {table}),
split AS (SELECT r, regexp_extract_all(text, {word}) AS ws FROM docs),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
totals AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
triples AS (SELECT r, i, w AS a, lead(w) OVER own AS b, lead(w, 2) OVER own AS c FROM words WINDOW own AS (PARTITION BY r ORDER BY i)),
often AS (SELECT r, i FROM triples WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM often, unnest([0, 1, 2]) AS t(k) GROUP BY r),
cut AS (SELECT r, string_split(text, chr(10)) AS ls FROM docs),
spread AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
lines AS (
  SELECT r, line, regexp_replace(line, {strip}, '', 'g') AS bare, regexp_extract_all(line, {word}) AS ws,
    row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS seen
  FROM spread WHERE regexp_matches(line, {word})),
sized AS (
  SELECT *, len(ws) AS n, list_sum(list_transform(ws, lambda w: length(w))) AS chars, {symbols("line")} AS marks, length(line) - length(replace(line, '!', '')) AS shouts,
    len(list_filter(ws, lambda w: list_contains([{", ".join(map(quote, _CELLS))}], w))) AS cells
  FROM lines),
judged AS (
  SELECT r, seen, CASE WHEN seen OR marks > {SYMBOLS_A_WORD}::DOUBLE * n OR (n > 2 AND shouts > {SHOUTS_A_WORD}::DOUBLE * n) OR (n > 3 AND cells > 0.2::DOUBLE * n)
    OR (n <= 6 AND NOT regexp_matches(bare, {end}) AND regexp_matches(bare, {menu})) OR (n <= 20 AND regexp_matches(line, {notice})) THEN chars ELSE 0 END AS lost
  FROM sized),
losses AS (SELECT r, sum(lost) AS lost_chars, count(*) FILTER (WHERE seen) AS n_dup_lines FROM judged GROUP BY r),
counted AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, {symbols("text")}::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM docs LEFT JOIN totals USING (r) LEFT JOIN repeats USING (r) LEFT JOIN losses USING (r)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND lost_chars <= {MAX_LOST}::DOUBLE * word_chars AS kept FROM based"""
