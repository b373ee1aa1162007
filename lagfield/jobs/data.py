"""The driver tables in the roles of the library's inputs, each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagfield.operators.expand import Buffer

#: Events: hours since 2024-01-01, 4 samples an hour, 30 days. Orders: days since 1995-01-01, one sample a day.
EVENT_HOURS, EVENT_RATE, N_EVENTS, N_DAYS = 720, 4, 2880, 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, element_id, t, feature, sentence_id, position, vec): four recordings, a sentence to a day."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    t = micros / F.lit(3600000000.0)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("recording"), F.col("event_id").alias("element_id"), t.alias("t"), F.col("event_type").alias("feature"), F.floor(t / 24).cast("int").alias("sentence_id"), F.array("value", F.get_json_object("props", "$.k").cast("double")).alias("vec"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("recording", "sentence_id").orderBy("element_id")) - 1)


EVENTS = """ev AS (SELECT user_id % 4 AS recording, event_id AS element_id, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS t, event_type AS feature,
    CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0 / 24) AS INTEGER) AS sentence_id, value AS v0, CAST(regexp_extract(props, '[0-9.]+') AS DOUBLE) AS v1 FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY recording, sentence_id ORDER BY element_id) - 1 AS position FROM ev)"""

#: Past and future taps of one sample, two-sample taps, and a two-hour window with three slots.
TAP = Buffer(frequency=EVENT_RATE, duration=EVENT_HOURS, dim=2, period=0.25, nb_buffer=4)
WIDE = Buffer(frequency=EVENT_RATE, duration=EVENT_HOURS, dim=2, period=0.5, nb_buffer=3)
WINDOW = Buffer(frequency=EVENT_RATE, duration=EVENT_HOURS, dim=2, prediction_end=0.75, nb_buffer=3, buffer_duration=0.75)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(F.lit(0).alias("recording"), F.col("o_orderkey").alias("element_id"), t.alias("t"), F.array(F.col("o_totalprice") / 1e5, F.lit(1.0)).alias("vec"))


ORDERS = "o AS (SELECT 0 AS recording, o_orderkey AS element_id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS t, o_totalprice / 1e5 AS v0, 1.0 AS v1 FROM orders)"
LAGS = Buffer(frequency=1, duration=N_DAYS, dim=2, period=1.0, nb_buffer=30)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, t_idx, target, value): revenue shipped on a day by the supplier's nation, 0 on days without; days by targets are a fixed grid."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("t_idx"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e5).alias("v"))
    daily = lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target")), "l_suppkey").groupBy("t_idx", "target").agg(F.sum("v").alias("value"))
    grid = daily.select("target").distinct().withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.lit(N_DAYS - 1))))
    return grid.join(daily, ["t_idx", "target"], "left").select(F.lit(0).alias("recording"), "t_idx", "target", F.coalesce("value", F.lit(0.0)).alias("value"))


SIGNAL = f"""dy AS (SELECT date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS t_idx, s_nationkey AS target, sum(l_extendedprice * (1 - l_discount) / 1e5) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
y AS (SELECT 0 AS recording, CAST(g.t_idx AS INTEGER) AS t_idx, k.target, coalesce(dy.value, 0.0) AS value FROM (SELECT DISTINCT target FROM dy) k CROSS JOIN range({N_DAYS}) g(t_idx) LEFT JOIN dy ON dy.t_idx = g.t_idx AND dy.target = k.target)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript out of conversations: two words to a start, punctuation where a word ends in a full stop."""
    pieces = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("recording"), F.col("turn").alias("sentence_id"), F.posexplode(F.split("text", " ")).alias("at", "word"))
    start = (F.col("at") - F.col("at") % 2) / F.lit(2.0)
    pos = F.when(F.col("word").endswith("."), "punct").when(F.col("at") % 5 != 0, "x")
    return pieces.select("recording", "sentence_id", (F.col("sentence_id") * 1_000_000 + F.col("at")).alias("row_id"), "word", (F.col("sentence_id") * 1000 + start).alias("start"), (F.col("sentence_id") * 1000 + start + F.lit(0.5)).alias("end"), pos.alias("pos"))


WORDS = """ws AS (SELECT conv_id, turn, string_split(text, ' ') AS parts FROM conversations WHERE text IS NOT NULL),
wp AS (SELECT conv_id AS recording, turn AS sentence_id, unnest(parts) AS word, generate_subscripts(parts, 1) - 1 AS n FROM ws),
w AS (SELECT recording, sentence_id, sentence_id * 1000000 + n AS row_id, word, sentence_id * 1000 + (n - n % 2) / 2.0 AS start, sentence_id * 1000 + (n - n % 2) / 2.0 + 0.5 AS stop,
    CASE WHEN word LIKE '%.' THEN 'punct' WHEN n % 5 <> 0 THEN 'x' END AS pos FROM wp)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as channels: names by key, bad where the balance is negative, electrodes are their nations."""
    k = F.col("s_suppkey")
    name = F.when(k % 11 == 0, F.concat(F.lit("DC"), k)).when(k % 13 == 0, F.concat(F.lit("EKG"), k)).when(k % 17 == 0, "Pulse Rate").otherwise(F.concat(F.lit("G"), k))
    return table(spark, sf_dir, "supplier").select(name.alias("name"), F.when(F.col("s_acctbal") < 0, "bad").otherwise("good").alias("status"), k.alias("ord"), F.col("s_nationkey").alias("nation"))


CHANNELS = """c AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'DC' || s_suppkey WHEN s_suppkey % 13 = 0 THEN 'EKG' || s_suppkey WHEN s_suppkey % 17 = 0 THEN 'Pulse Rate' ELSE 'G' || s_suppkey END AS name,
    CASE WHEN s_acctbal < 0 THEN 'bad' ELSE 'good' END AS status, s_suppkey AS ord, s_nationkey AS nation FROM supplier)"""
