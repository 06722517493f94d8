"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from larkspur.llm.bpe import op8_bpe
from larkspur.llm.chat import CHAT_SQL, op4_chat_formatting
from larkspur.llm.jaccard import op7_jaccard_join
from larkspur.llm.media import op2_media_columns
from larkspur.llm.packing import op3_best_fit_packing
from larkspur.llm.rules import op9_quality
from larkspur.llm.session import ready
from larkspur.llm.substring import op1_substring_dedup
from larkspur.llm.suffix import op10_suffix_dedup
from larkspur.llm.topk import TOPK_SQL, op5_exact_topk
from larkspur.llm.toxicity import op6_toxicity

_ALL = [op1_substring_dedup, op2_media_columns, op3_best_fit_packing, op4_chat_formatting, op5_exact_topk, op6_toxicity, op7_jaccard_join, op8_bpe, op9_quality, op10_suffix_dedup]

#: Words and windows in plain SQL over the whole table; n_words, n_removed and the kept text's digest.
SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM w, unnest(range(1, len(words) - 33)) AS r(i)
), again AS (
  SELECT h FROM p GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM p JOIN again USING (h), unnest(range(0, 35)) AS s(k)
), kept AS (
  SELECT w.doc_id, u.i, w.words[u.i] AS word, g.i IS NOT NULL AS removed
  FROM w, unnest(range(1, len(words) + 1)) AS u(i) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = u.i
), d AS (
  SELECT doc_id, count(*) AS n_words, sum(removed::INT) AS n_removed, string_agg(CASE WHEN NOT removed THEN word END, ' ' ORDER BY i) AS t FROM kept GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN d USING (doc_id)
"""

#: Sets of shingles, links by an equi-join on them, and the components of the links.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(v[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(v) - 4, 1) + 1)) AS r(i) WHERE len(v) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (g) JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))
), c AS (
  SELECT doc_id AS d, doc_id AS reached FROM w UNION SELECT c.d, l.y FROM c JOIN l ON l.x = c.reached
), m AS (
  SELECT d, min(reached) AS component_id FROM c GROUP BY d
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.d = w.doc_id
"""


def _prepared(f):
    return lambda spark, sf_dir: f(ready(spark), sf_dir)


QUERIES = {f.__name__: _prepared(f) for f in _ALL}
ORACLE: dict[str, str] = {"op1_substring_dedup": SUBSTRING_SQL, "op4_chat_formatting": CHAT_SQL, "op5_exact_topk": TOPK_SQL, "op7_jaccard_join": JACCARD_SQL}
