"""Pieces of DuckDB SQL that say the same as the column functions; only the oracles use them."""

from __future__ import annotations

from functools import reduce

from leafwright.functions.text import ABBREVIATIONS, CREDIT_TITLE, END_MARKER, HEADINGS, LANGUAGE_NAMES, START_MARKER
from leafwright.operators.planning import STOPWORDS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"


def blank(x: str) -> str:
    return f"({strip(f'coalesce({x}, {quoted(chr(0x20))})')} = '')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '[\s\pZ]+', ' ', 'g')")


def sentences(x: str) -> str:
    masked = reduce(lambda y, a: f"replace({y}, {quoted(a)}, {quoted(a.replace('.', chr(1)))})", ABBREVIATIONS, x)
    cut = rf"""regexp_replace({masked}, '([.!?])[\s\pZ]+([A-Z"''\[(])', '\1' || chr(2) || '\2', 'g')"""
    cut = rf"regexp_replace({cut}, '([。！？])[\s\pZ]*', '\1' || chr(2), 'g')"
    parts = f"list_filter(list_transform(string_split({cut}, chr(2)), lambda p: {strip('replace(p, chr(1), ' + quoted('.') + ')')}), lambda p: length(p) > 2)"
    return f"(CASE WHEN len({parts}) > 0 THEN {parts} ELSE [{x}] END)"


def heading(x: str) -> str:
    return f"regexp_matches({x}, {quoted(r'^\s*(?:' + '|'.join(HEADINGS) + r')\s*$')})"


def language_base(x: str) -> str:
    return f"lower(split_part(coalesce(nullif({x}, ''), 'en'), '-', 1))"


def language_name(x: str) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in LANGUAGE_NAMES.items()) + f" ELSE {x} END)"


START, END, CREDIT = quoted(rf"(?is)\A.*?{START_MARKER}"), quoted(rf"(?is){END_MARKER}.*\z"), quoted(CREDIT_TITLE)
COMMON = "[" + ", ".join(map(quoted, STOPWORDS)) + "]"

#: Lines of documents as paragraphs: (book, doc_id, line_no, text).
LINES = f"""lines AS (SELECT book, doc_id, line_no, {collapse('raw')} AS text FROM (
  SELECT source AS book, doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE length({collapse('raw')}) > 1)"""
#: Books with a heading before every fifth document: (book, para_no, text).
PARAS = (
    LINES
    + """, paras AS (SELECT book, doc_id * 1000000000 + line_no AS para_no, text FROM lines UNION ALL
  SELECT source, doc_id * 1000000000, 'CHAPTER ' || CAST(doc_id // 100 + 1 AS VARCHAR) FROM documents WHERE (doc_id // 20) % 5 = 0)"""
)
BUCKETS = (
    PARAS
    + f""", flagged AS (SELECT *, {heading('text')} AS heading FROM paras),
  numbered AS (SELECT *, sum(CAST(heading AS BIGINT)) OVER (PARTITION BY book ORDER BY para_no) AS chapter_no FROM flagged),
  buckets AS (SELECT book, chapter_no, substr(max(CASE WHEN heading THEN text END) OVER (PARTITION BY book, chapter_no), 1, 200) AS title, para_no, text, heading FROM numbered),
  chapters AS (SELECT book, CAST(chapter_no AS BIGINT) AS chapter_no, title, para_no, text FROM buckets WHERE NOT heading AND chapter_no >= 1)"""
)
UNITS = (
    BUCKETS
    + f""", raw_units AS (SELECT book, chapter_no, title, para_no, unnest({sentences('text')}) AS unit, generate_subscripts({sentences('text')}, 1) AS s FROM chapters),
  units AS (SELECT book, chapter_no, title, row_number() OVER (PARTITION BY book, chapter_no ORDER BY para_no, s) AS unit_no, unit FROM raw_units)"""
)
MERGED = (
    UNITS
    + f""", sizes AS (SELECT book, chapter_no, count(*) AS n, any_value(title) AS title FROM units GROUP BY 1, 2),
  totals AS (SELECT *, sum(n) OVER (PARTITION BY book ORDER BY chapter_no) AS total FROM sizes),
  stops AS (SELECT book, coalesce(min(CASE WHEN NOT regexp_matches(title, {CREDIT}) AND total > 8 THEN chapter_no END), max(chapter_no)) AS stop FROM totals GROUP BY 1),
  named AS (SELECT stops.book, stop, title AS stop_title FROM stops JOIN sizes ON stops.book = sizes.book AND stops.stop = sizes.chapter_no),
  merged AS (SELECT u.book, greatest(chapter_no, stop) AS chapter_no, CASE WHEN chapter_no <= stop THEN stop_title ELSE title END AS title,
    row_number() OVER (PARTITION BY u.book, greatest(chapter_no, stop) ORDER BY chapter_no, unit_no) AS unit_no, unit FROM units u JOIN named USING (book))"""
)
FINAL = (
    MERGED
    + """, parted AS (SELECT *, (unit_no - 1) // 80 AS part, CAST(ceil(count(*) OVER (PARTITION BY book, chapter_no) / 80.0) AS BIGINT) AS parts FROM merged),
  final AS (SELECT book, dense_rank() OVER (PARTITION BY book ORDER BY chapter_no, part) AS chapter_no,
    CASE WHEN parts = 1 THEN title ELSE title || ' (Part ' || CAST(part + 1 AS VARCHAR) || '/' || CAST(parts AS VARCHAR) || ')' END AS title, unit_no - part * 80 AS unit_no, unit FROM parted)"""
)
#: Translated pairs with gaps at fixed places: the translation is the unit with a mark.
PAIRS = FINAL + """, pairs AS (SELECT *, CASE WHEN (chapter_no * 31 + unit_no) % 7 = 0 THEN ' ' ELSE 'ko: ' || unit END AS translation FROM final)"""
#: Greedy packing as a recursion over a chapter's units.
WINDOWS = (
    FINAL
    + """, packed AS (
  SELECT book, chapter_no, unit_no, unit_no AS start, 1 AS n_units, length(unit) AS n_chars FROM final WHERE unit_no = 1
  UNION ALL SELECT f.book, f.chapter_no, f.unit_no, CASE WHEN p.n_units >= 20 OR p.n_chars + length(f.unit) > 2200 THEN f.unit_no ELSE p.start END,
    CASE WHEN p.n_units >= 20 OR p.n_chars + length(f.unit) > 2200 THEN 1 ELSE p.n_units + 1 END, CASE WHEN p.n_units >= 20 OR p.n_chars + length(f.unit) > 2200 THEN length(f.unit) ELSE p.n_chars + length(f.unit) END
  FROM packed p JOIN final f ON f.book = p.book AND f.chapter_no = p.chapter_no AND f.unit_no = p.unit_no + 1),
  windows AS (SELECT book, chapter_no, start, max(n_units) AS n_units, max(n_chars) AS n_chars FROM packed GROUP BY 1, 2, 3)"""
)
