"""The jobs as queries: each runs its job twice into a new folder of the shared one, and returns the output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftgauge.functions.numerals import CUES
from driftgauge.session import scratch

from . import collect_shards, mark_answers


def job1_mark_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "job1")
    for _ in range(2):
        mark_answers.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint", mark_answers.read_config())
    return mark_answers.read_back(spark, f"{folder}/out")


def job2_collect_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "job2")
    for _ in range(2):
        collect_shards.run(spark, f"{sf_dir}/events.parquet", f"{folder}/out", collect_shards.read_config())
    return collect_shards.read_back(spark, f"{folder}/out")


QUERIES = {f.__name__: f for f in (job1_mark_answers, job2_collect_shards)}

_CUES = ", ".join(f"'{c}'" for c in CUES)
#: Blanks of any script, and a numeral, for DuckDB's regular expressions.
_BLANK = r"\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}"
_NUMERAL = rf"[-+]?[0-9][0-9.,{_BLANK}]*"
#: Texts of the tables hold ASCII digits only. Behind the last place of the first cue that has a digit behind it, else in the whole text, the last numeral; then its separators.
SQL = {
    "job1_mark_answers": rf"""WITH t AS (SELECT doc_id, lang, source AS model, coalesce(text, '') AS text FROM documents),
  r AS (SELECT *, coalesce(list_filter(list_transform([{_CUES}], lambda c: CASE WHEN contains(lower(text), c) THEN string_split(lower(text), c)[-1] END), lambda x: regexp_matches(coalesce(x, ''), '[0-9]'))[1], text) AS rest FROM t),
  m AS (SELECT *, regexp_replace(regexp_replace(trim(regexp_extract_all(rest, '{_NUMERAL}')[-1]), '[ \x{{A0}}\x{{202F}}]', '', 'g'), '[.,{_BLANK}]+$', '') AS bare FROM r),
  c AS (SELECT *, len(bare) - len(replace(bare, '.', '')) AS dots, len(bare) - len(replace(bare, ',', '')) AS commas, len(regexp_extract(bare, '[.,]([^.,]*)$', 1)) AS behind, replace(replace(bare, '.', ''), ',', '.') AS pointed, replace(bare, ',', '') AS whole FROM m),
  v AS (SELECT *, CASE WHEN dots = 0 AND commas = 0 THEN bare WHEN dots > 1 THEN pointed WHEN commas > 1 THEN whole WHEN dots = 1 AND commas = 1 THEN CASE WHEN strpos(bare, '.') > strpos(bare, ',') THEN whole ELSE pointed END WHEN behind = 3 THEN replace(whole, '.', '') ELSE replace(bare, ',', '.') END AS plain FROM c),
  a AS (SELECT doc_id, lang, model, CASE WHEN regexp_full_match(plain, '[-+]?[0-9]*\.?[0-9]+|[-+]?[0-9]+\.') THEN try_cast(plain AS DOUBLE) END AS number, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, length(text)::BIGINT AS n_chars, octet_length(encode(text))::BIGINT AS n_bytes FROM v),
  g AS (SELECT lang, model, count(*) AS n_answers, avg(CASE WHEN number IS NULL THEN 1.0 ELSE 0.0 END) AS unparseable, avg(n_words) AS mean_words, avg(n_chars) AS mean_chars, avg(n_bytes) AS mean_bytes FROM a GROUP BY 1, 2),
  l AS (SELECT lang, avg(n_chars) / (SELECT avg(n_chars) FROM a WHERE lang = 'en') AS chars_ratio FROM a GROUP BY 1)
  SELECT a.*, n_answers, unparseable, unparseable > 0.15 AS flag_unparseable, mean_words, mean_chars, mean_bytes, chars_ratio FROM a JOIN g ON a.lang IS NOT DISTINCT FROM g.lang AND a.model IS NOT DISTINCT FROM g.model JOIN l ON a.lang IS NOT DISTINCT FROM l.lang""",
    "job2_collect_shards": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id % 19, event_type, event_id // 50 ORDER BY ts DESC, event_id DESC) AS back FROM events),
  r AS (SELECT 'events' AS benchmark, 'letter' AS mode, (user_id % 19)::VARCHAR AS model, event_type AS language, (event_id // 50)::VARCHAR AS item_id, (CASE WHEN event_id % 11 = 0 THEN -1 WHEN user_id % 19 % 6 = 5 THEN 2 ELSE (event_id * 7 + user_id) % 4 END)::SMALLINT AS predicted, floor(value)::BIGINT % 4 AS answer FROM e WHERE back = 1),
  k AS (SELECT item_id FROM r GROUP BY 1 HAVING count(DISTINCT language) = (SELECT count(DISTINCT language) FROM r)),
  w AS (SELECT * EXCLUDE (answer), coalesce((predicted = answer)::TINYINT, 0::TINYINT) AS correct FROM r),
  s AS (SELECT * FROM w SEMI JOIN k USING (item_id)),
  c AS (SELECT model, language, count(*) AS n FROM s WHERE predicted >= 0 GROUP BY model, language, predicted),
  o AS (SELECT model, language, max(n) / sum(n) AS top FROM c GROUP BY 1, 2),
  a AS (SELECT model, language, count(*) AS n_items, avg(correct) AS accuracy, avg((predicted < 0)::INT) AS unparseable FROM s GROUP BY 1, 2)
  SELECT w.*, a.n_items, a.accuracy, b.accuracy - a.accuracy AS gap, a.unparseable, CASE WHEN a.n_items > 0 THEN coalesce(top, 1.0) END AS mode_share, a.unparseable > 0.15 AS flag_unparseable, CASE WHEN a.n_items > 0 THEN coalesce(top, 1.0) > 0.9 END AS flag_degenerate
  FROM w LEFT JOIN a USING (model, language) LEFT JOIN o USING (model, language) LEFT JOIN (SELECT model, accuracy FROM a WHERE language = 'view') b USING (model)""",
}
