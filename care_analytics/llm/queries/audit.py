"""op12: how five filters of ``documents`` interact in every order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from care_analytics.llm.audit import audit


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op12_filter_audit": op12_filter_audit}

SQL = {"op12_filter_audit": r"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT t AS ft, min(doc_id) AS first_id FROM base GROUP BY t),
marks AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(m.toxic, false) AS toxic,
         (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
       + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
       + (CASE WHEN base.doc_id > first_id THEN 16 ELSE 0 END) AS bits
  FROM base JOIN firsts ON t = ft LEFT JOIN marks m ON m.doc_id = base.doc_id),
counted AS (SELECT part, bits, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, bits),
letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
chains AS (
  SELECT '' AS o, 0 AS used, 0 AS step, 0 AS before, 0 AS bit
  UNION ALL
  SELECT o || l, used + letters.bit, step + 1, used, letters.bit FROM chains JOIN letters ON (used & letters.bit) = 0),
perms AS (SELECT o AS filter_order FROM chains WHERE step = 5),
steps AS (SELECT filter_order, step, before, bit FROM perms JOIN chains ON step >= 1 AND filter_order[1:step] = o),
pairs AS (
  SELECT part, s.before, s.bit,
         sum(CASE WHEN (bits & (s.before | s.bit)) = 0 THEN docs ELSE 0 END) AS kept,
         sum(CASE WHEN (bits & s.before) = 0 AND (bits & s.bit) <> 0 THEN docs ELSE 0 END) AS removed,
         sum(CASE WHEN (bits & s.before) <> 0 AND (bits & s.bit) <> 0 THEN docs ELSE 0 END) AS redundant,
         sum(CASE WHEN bits = s.bit THEN docs ELSE 0 END) AS unique_fails,
         sum(CASE WHEN (bits & s.before) = 0 AND (bits & s.bit) <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN (bits & s.before) = 0 AND (bits & s.bit) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted CROSS JOIN (SELECT DISTINCT before, bit FROM steps) s GROUP BY part, s.before, s.bit),
shap AS (SELECT part AS sp, pairs.bit AS sb, sum(removed) AS shapley FROM pairs JOIN steps ON steps.before = pairs.before AND steps.bit = pairs.bit GROUP BY 1, 2)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM pairs JOIN steps ON steps.before = pairs.before AND steps.bit = pairs.bit JOIN shap ON sp = part AND sb = pairs.bit
"""}
