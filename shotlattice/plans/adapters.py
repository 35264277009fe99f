"""The driver's tables as engine tables: a user is a video, a day a segment, a second of the month a frame, an event type a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, video, segment, frame, label, value, k."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    frame = day * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return e.select("event_id", F.col("user_id").alias("video"), day.alias("segment"), frame.cast("long").alias("frame"), F.col("event_type").alias("label"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


#: The same table for DuckDB.
EVENTS_SQL = """e AS (SELECT event_id, user_id AS video, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS segment,
  (date_diff('day', DATE '2024-01-01', ts::DATE) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS frame,
  event_type AS label, value, (props->>'k')::INT AS k FROM events)"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Fractions to ``places``: sums over partitions may differ in the last bits."""
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rounded_sql(sql: str, doubles: str, places: int = 6) -> str:
    """``sql`` with the named columns rounded."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {places}) + 0.0 AS {c}' for c in doubles.split())}) FROM ({sql})"
