"""Queries over texts and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.functions import text as fn
from reelquery.plans.registry import registry
from reelquery.sources.adapters import table
from reelquery.sources.files import frame_time, name_times, sampled, stripped_names

QUERIES, ORACLES, query = registry()


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\s\x{00a0}\x{3000}]', '', 'g')) AS bare, length(regexp_replace(text, '[\s\x{00a0}\x{3000}]', '', 'g'))::INT AS n FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = fn.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(bare).alias("bare"), F.length(bare).alias("n"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\s\x{00a0}\x{3000}。，！？、；：“”‘’「」【】《》（）.,!?;:''"()\[\]{}…—～~-]', '', 'g'), '[0-9零一二两三四五六七八九十百千万亿]+', '#', 'g')) AS norm FROM documents""")
def text_normalize_for_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fn.normalize_for_cer(F.col("text"))).alias("norm"))


_PAIRS_SQL = "p AS (SELECT conv_id, turn, substr(text, 1, 40) AS a, substr(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 1, 40) AS b, text FROM conversations), q AS (SELECT * FROM p WHERE b IS NOT NULL AND regexp_matches(a || b, '^[\\x00-\\x7f]*$'))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = c.select("conv_id", "turn", F.substring("text", 1, 40).alias("a"), F.substring(after, 1, 40).alias("b"), "text")
    return p.filter(F.col("b").isNotNull() & F.concat("a", "b").rlike(r"^[\x00-\x7f]*$"))


@query(f"WITH {_PAIRS_SQL} SELECT conv_id, turn, levenshtein(a, b)::INT AS distance, levenshtein(a, b) / greatest(length(a), 1) AS cer FROM q")
def text_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", fn.edit_distance(F.col("a"), F.col("b")).alias("distance"), fn.character_error_rate(F.col("a"), F.col("b")).alias("cer"))


@query(f"WITH {_PAIRS_SQL} SELECT conv_id, turn, CASE WHEN strlen(a) IN (0, strlen(text)) THEN false ELSE contains(text, a) END AS head, CASE WHEN strlen(a) = strlen(b) OR a = '' OR b = '' THEN false WHEN strlen(a) < strlen(b) THEN contains(b, a) ELSE contains(a, b) END AS next FROM q")
def text_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", fn.is_substring_of(F.col("a"), F.col("text")).alias("head"), fn.is_substring_of(F.col("a"), F.col("b")).alias("next"))


@query("""SELECT page_id, url_decode(replace(url, '/', '%2F') || '+a%20b') AS plain, url || '%zz' AS broken, url || ' b%zz%4 c%' AS mixed, url || ' 图' AS wide FROM pages""")
def text_url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    escaped = F.concat(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("+a%20b"))
    return p.select("page_id", fn.url_decode(escaped).alias("plain"), fn.url_decode(F.concat("url", F.lit("%zz"))).alias("broken"), fn.url_decode(F.concat("url", F.lit("%20b%zz%4%20c%"))).alias("mixed"), fn.url_decode(F.concat("url", F.lit("%20%E5%9b%BE"))).alias("wide"))


@query("""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN o_orderkey || '_' || (o_orderkey + 40) WHEN 2 THEN o_orderkey || '_' WHEN 3 THEN 'a' || o_orderkey ELSE o_orderkey || '_1_2' END AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(s, '^[0-9]+(_[0-9]+)?$') THEN split_part(s, '_', 1)::BIGINT END AS first, CASE WHEN regexp_matches(s, '^[0-9]+_[0-9]+$') THEN split_part(s, '_', 2)::BIGINT END AS second FROM n""")
def name_to_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 5 == 0, k).when(F.col("o_orderkey") % 5 == 1, F.concat(k, F.lit("_"), (F.col("o_orderkey") + 40).cast("string"))).when(F.col("o_orderkey") % 5 == 2, F.concat(k, F.lit("_"))).when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("a"), k)).otherwise(F.concat(k, F.lit("_1_2")))
    t = name_times(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(t, F.lit(0)).alias("first"), F.get(t, F.lit(1)).alias("second"))


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'shot_' || (p_partkey % 60) ELSE (p_partkey % 90)::VARCHAR END AS name FROM part), d AS (SELECT DISTINCT name FROM n)
SELECT min(name) AS name, substr(name, 6) AS new_name FROM d WHERE name LIKE 'shot\\_%' ESCAPE '\\' AND substr(name, 6) NOT IN (SELECT name FROM d) GROUP BY substr(name, 6) HAVING count(*) = 1""")
def names_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, F.concat(F.lit("shot_"), (k % 60).cast("string"))).otherwise((k % 90).cast("string")).alias("name")).distinct()
    return stripped_names(names, "shot_")


@query("SELECT event_id, round(event_id / 25.0::DOUBLE * 1000)::BIGINT AS timestamp, CASE WHEN event_id % 3 = 0 THEN round(event_id * 1.5) WHEN event_id % 3 = 1 THEN round(event_id * 1000 / 24.0::DOUBLE) ELSE floor(event_id * 1000 / 30) END::BIGINT AS shown FROM events WHERE event_id % 13 = 0")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    n = F.col("n")
    shown = frame_time(n, F.when(n % 3 == 0, n * 1.5).otherwise(F.lit(0.0)), F.when(n % 3 == 1, F.lit(24.0)).otherwise(F.lit(0.0)))
    return sampled(e, 25.0, 2.0).select("event_id", "timestamp", shown.alias("shown"))


@query("""SELECT event_id, t AS timestamp FROM (SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN [0] WHEN 1 THEN [event_id * 10] ELSE [event_id * 10, event_id * 10 + 40] END) AS t FROM events)""")
def times_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquery.operators.boxes import expand_times

    i = F.col("event_id")
    times = F.when(i % 3 == 0, F.array().cast("array<bigint>")).when(i % 3 == 1, F.array(i * 10)).otherwise(F.array(i * 10, i * 10 + 40))
    return expand_times(table(spark, sf_dir, "events").select("event_id", times.alias("times"), F.lit(0).alias("timestamp")))
