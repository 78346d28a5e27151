"""Queries over event time: speed, direction, ring buffer, cadence, queue."""

from __future__ import annotations

from quadrille.plans.base import shared

# the window is an hour: events stand minutes apart
_POS = "(SELECT event_type AS track, event_id, CAST({us} AS BIGINT) AS us, CAST(event_id % 97 AS DOUBLE) AS frame FROM events)"
_WINDOW = "OVER (PARTITION BY track ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)"
_SPEED = """SELECT track, event_id, round(CASE WHEN n < 2 THEN 1e0 WHEN last_us - first_us < 100 THEN 0e0 ELSE (last_frame - first_frame) / ((last_us - first_us) / 1e6) / (44100e0 / 1024e0) END, 9) AS speed FROM
  (SELECT track, event_id, count(*) {w} AS n, first_value(us) {w} AS first_us, us AS last_us, first_value(frame) {w} AS first_frame, frame AS last_frame FROM {p} p) v"""


def _both(name: str, sql: str) -> None:
    from quadrille import catalog
    from quadrille.plans import base, dialect

    def make(spark, sf_dir):
        spark_sql = dialect.spark(sql.replace("{us}", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
        return spark.sql(spark_sql.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))

    catalog.QUERIES[name] = make
    catalog.ORACLES[name] = base.dialect.duck(sql.replace("{us}", "epoch_us(ts)"))


_SPEEDS = _SPEED.replace("{w}", _WINDOW).replace("{p}", _POS)
_both("speed_estimate", _SPEEDS)
_both("direction_deadband", f"SELECT track, event_id, CASE WHEN speed > 0.02e0 THEN 1 WHEN speed < -0.02e0 THEN -1 ELSE 0 END AS direction FROM ({_SPEEDS}) s")
_both("ring_buffer", f"SELECT track, event_id, CAST(k AS INT) AS place FROM (SELECT track, event_id, row_number() OVER (PARTITION BY track ORDER BY us DESC, event_id DESC) AS k FROM {_POS} p) v WHERE k <= 20")
_both("display_cadence", f"SELECT track, event_id FROM (SELECT track, event_id, row_number() OVER (PARTITION BY track ORDER BY us, event_id) - 1 AS k FROM {_POS} p) v WHERE k % greatest(1, CAST(floor(44100e0 / 1024e0 / 15e0) AS INT)) = 0")
_both("seek_reset", f"SELECT track, event_id, CASE WHEN abs(frame - before) > 1e0 THEN 1 ELSE 0 END AS reset FROM (SELECT track, event_id, frame, coalesce(lag(frame) OVER (PARTITION BY track ORDER BY us, event_id), frame) AS before FROM {_POS} p) v")
_both("hourly_positions", f"SELECT track, us // 3600000000 AS hour, count(*) AS events, round(avg(frame), 6) AS mean_frame FROM {_POS} p GROUP BY track, us // 3600000000")
shared("clamped_lookup", "SELECT i AS asked, least(99, greatest(0, i)) AS frame FROM RANGE(-5, 120) t")


# streams: the same answers from Structured Streaming, all that is there in one go
def _streamed(spark, stream, name):
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quadrille-")
    import uuid

    at = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _positions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return stream.selectExpr("event_type AS track", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS us", "CAST(event_id % 97 AS DOUBLE) AS frame")


def _register_streams() -> None:
    from pyspark.sql import functions as F

    from quadrille import catalog
    from quadrille.plans import dialect
    from quadrille.streaming import live

    speeds = dialect.duck(_SPEEDS.replace("{us}", "epoch_us(ts)").replace("SELECT track, event_id, round(", "SELECT track, last_us AS us, last_frame AS frame, round("))

    def stream_speed(spark, sf_dir):
        return _streamed(spark, live.stream_speed(_positions(spark, sf_dir), 3_600_000_000), "speed").select("track", "us", "frame", F.round("speed", 9).alias("speed"), "direction")

    catalog.QUERIES["stream_speed"] = stream_speed
    catalog.ORACLES["stream_speed"] = f"SELECT track, us, frame, speed, CASE WHEN speed > 0.02e0 THEN 1 WHEN speed < -0.02e0 THEN -1 ELSE 0 END AS direction FROM ({speeds}) s"

    def stream_windows(spark, sf_dir):
        """Tumbling hours with a watermark, by Structured Streaming's own aggregation."""
        stream = _positions(spark, sf_dir).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "1 hour")
        counts = stream.groupBy("track", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events"))
        return _streamed(spark, counts.select("track", F.unix_micros("w.start").alias("hour_us"), "events"), "windows")

    catalog.QUERIES["stream_windows"] = stream_windows
    # an hour is given out once the watermark, an hour behind the latest event, has passed its end
    catalog.ORACLES["stream_windows"] = """SELECT event_type AS track, epoch_us(ts) // 3600000000 * 3600000000 AS hour_us, count(*) AS events FROM events
      GROUP BY event_type, epoch_us(ts) // 3600000000 HAVING (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000"""


_register_streams()
