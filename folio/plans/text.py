"""Text search queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators.search import search
from folio.tables import table

TERM = "the"


def k1_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, TERM, key="doc_id", fields={"caption": F.left(F.col("text"), F.lit(40)), "text": F.col("text")}, order=[])


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


K1_SQL = f"""
WITH hit AS (
  SELECT doc_id, text, CASE WHEN contains(left(text, 40), '{TERM}') THEN 0 ELSE 1 END AS match_rank,
         instr(text, '{TERM}') AS p, length(text) AS n
  FROM documents WHERE contains(text, '{TERM}')
), win AS (
  SELECT *, greatest(1, p - 73) AS a, least(n + 1, p + 3 + 73) AS b FROM hit
)
SELECT doc_id, CASE WHEN match_rank = 0 THEN 'caption' ELSE 'text' END AS match_source, match_rank::INT AS match_rank,
  (CASE WHEN a > 1 THEN '…' ELSE '' END) || {_esc('substr(text, a, p - a)')} || '<mark>' || {_esc('substr(text, p, 3)')} || '</mark>'
  || {_esc('substr(text, p + 3, b - p - 3)')} || (CASE WHEN b <= n THEN '…' ELSE '' END) AS snippet
FROM win ORDER BY match_rank, doc_id LIMIT 20"""

QUERIES = {"k1_search": k1_search}
ORACLES = {"k1_search": K1_SQL}
