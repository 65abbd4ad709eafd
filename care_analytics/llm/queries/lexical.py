"""op13: the ten best documents for every ``benchmark`` item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from care_analytics.llm.ball_tree import search


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


QUERIES = {"op13_lexical_search": op13_lexical_search}

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = {"op13_lexical_search": f"""
WITH asked AS (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
docs AS (SELECT doc_id, {_TERMS.format('text')} AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM wanted) GROUP BY term, nn),
parts AS (
  SELECT item_id, tf.doc_id, times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))) AS part
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN sizes ON sizes.doc_id = tf.doc_id, total),
scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, row_number() OVER best::INTEGER AS rank, doc_id, score FROM scored
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER best <= 10
"""}
