"""Full-text views as SQL: words of every field, stems of the English ones, and the index."""

from __future__ import annotations

from ..functions import stemming as st
from ..functions import text
from .registry import shared_view

_V, _O = st.VOWEL, st.OTHER


def _case(pairs: dict[str, str]) -> str:
    return "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _step(source: str, suffixes, changed: str) -> str:
    """A step over (word, done, w, r1, r2): `x` is the longest ending, `b` what stands before it."""
    return f"""SELECT word, done, r1, r2, CASE WHEN x = '' THEN w ELSE coalesce({changed}, w) END AS w FROM (
    SELECT *, left(w, length(w) - length(x)) AS b FROM (SELECT *, regexp_extract(w, '{st.ending(suffixes)}', 1) AS x FROM {source}) q) q"""


def _stems(words: str) -> str:
    return f"""
WITH s0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({_V})y', '\\1Y', 'g') AS w FROM ({words}) q),
s1 AS (SELECT word, w, regexp_extract(w, '^({"|".join(st.REGION_STARTS)}|.*?{_V}{_O})', 1) AS h FROM s0),
s2 AS (SELECT word, w, CASE WHEN h = '' THEN length(w) ELSE length(h) END AS r1 FROM s1),
s3 AS (SELECT word, w, r1, regexp_extract(substr(w, r1 + 1), '^(.*?{_V}{_O})', 1) AS h FROM s2),
s4 AS (SELECT word, w, r1, CASE WHEN h = '' THEN length(w) ELSE r1 + length(h) END AS r2 FROM s3),
s5 AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
    WHEN regexp_matches(w, 'ie[sd]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '{_V}.+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM s4),
s6 AS (SELECT word, r1, r2, w, CASE WHEN w IN ({_list(st.INVARIANT)}) THEN w END AS done FROM s5),
s7 AS ({_step("s6", ["eedly", "ingly", "edly", "eed", "ing", "ed"], f'''CASE WHEN x LIKE 'eed%' THEN CASE WHEN length(b) >= r1 THEN b || 'ee' END
    WHEN regexp_matches(b, '{_V}') THEN CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
      WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - 1)
      WHEN r1 >= length(b) AND regexp_matches(b, '{st.SHORT_END}') THEN b || 'e' ELSE b END END''')}),
s8 AS (SELECT word, done, r1, r2, regexp_replace(w, '(.{_O})[yY]$', '\\1i') AS w FROM s7),
s9 AS ({_step("s8", st.STEP2, f"CASE WHEN length(b) >= r1 AND (x <> 'ogi' OR b LIKE '%l') AND (x <> 'li' OR regexp_matches(b, '[cdeghkmnrt]$')) THEN b || {_case(st.STEP2)} END")}),
s10 AS ({_step("s9", st.STEP3, f"CASE WHEN length(b) >= CASE WHEN x = 'ative' THEN r2 ELSE r1 END THEN b || {_case(st.STEP3)} END")}),
s11 AS ({_step("s10", st.STEP4, "CASE WHEN length(b) >= r2 AND (x <> 'ion' OR regexp_matches(b, '[st]$')) THEN b END")}),
s12 AS (SELECT word, done, CASE
    WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{st.SHORT_END}'))) THEN left(w, length(w) - 1)
    WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM s11)
SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE coalesce(CASE word {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in st.SPECIAL.items())} END, done, lower(w)) END AS stem FROM s12"""


shared_view("m_text", """
SELECT id AS product_id, 'name' AS field, name AS text FROM m_product UNION ALL SELECT id, 'model_code', model_code FROM m_product
UNION ALL SELECT id, 'summary', summary FROM m_product UNION ALL SELECT doc_id, 'description', text FROM documents JOIN part ON p_partkey = doc_id""")
shared_view("m_word", f"""
SELECT * FROM (SELECT DISTINCT product_id, field, unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM m_text) q
WHERE word <> '' AND (field IN ('name', 'model_code') OR word NOT IN ({_list(text.STOP_WORDS)}))""")
shared_view("m_stem", _stems("SELECT DISTINCT word FROM m_word WHERE field IN ('summary', 'description')"))
shared_view("m_text_index", """
SELECT lexeme, product_id, min(weight) AS weight FROM (
  SELECT CASE WHEN field IN ('summary', 'description') THEN stem ELSE word END AS lexeme, product_id,
    CASE field WHEN 'summary' THEN 'B' WHEN 'description' THEN 'C' ELSE 'A' END AS weight FROM m_word LEFT JOIN m_stem USING (word)) q GROUP BY ALL""")


def holds(*lexemes: str) -> str:
    """Condition on `p.id`: the product holds every lexeme."""
    return " AND ".join(f"EXISTS (SELECT 1 FROM m_text_index t WHERE t.product_id = p.id AND t.lexeme = '{x}')" for x in lexemes)
