"""Queries that run as streams over the event table and end when it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetlake.plans import fixtures as X
from facetlake.plans.scenes import SQL as SCENE_SQL
from facetlake.plans.scenes import merged, r6, scored_runs
from facetlake.storage import shared_dir
from facetlake.streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = X.sql(sql, *names)
        return f

    return add


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of log records."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern: the table may be one file or a folder
    return e.select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), "value", F.col("ts").cast("timestamp").alias("ts"), "event_id")


def finished(rows: DataFrame, schema: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there; its rows come back from a table in the shared folder, of each of ``keys`` the row of the last batch.

    A batch that runs again after a failure writes its own folder again, so no row comes twice.
    """
    out = shared_dir(rows.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    ended(rows, keep, mode)
    x = rows.sparkSession.read.schema(f"{schema}, batch long").parquet(out)
    if keys:
        x = x.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in x.columns if c not in (*keys, "batch")]), "batch").alias("last")).select(*keys, "last.*")
    return x.drop("batch")


def ended(rows: DataFrame, keep, mode: str = "append") -> StreamingQuery:
    """Runs a stream to the end of what is there with a ``foreachBatch`` function."""
    spark = rows.sparkSession
    with logs.with_state_store(spark):
        query = rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", shared_dir(spark, "stream-state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


@query(
    """SELECT date_trunc('hour', ts) AS start, user_id AS run, event_type AS key, count(*) AS n, round(avg(value), 6) AS mean, round(arg_max(value, (ts, event_id)), 6) AS latest FROM events GROUP BY ALL""")
def stream_log_metrics(spark, d):
    """All windows as they stand when the stream ends, those still open too: a window comes out again with each batch that adds to it, and its last row counts."""
    x = finished(logs.log_metrics(event_stream(spark, d), "1 hour"), "start timestamp, run long, key string, n long, mean double, latest double", mode="update", keys=["start", "run", "key"])
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "run", "key", "n", r6("mean", "mean"), r6("latest", "latest"))


@query(
    """SELECT user_id AS run, ts AS since, CASE WHEN next > ts + INTERVAL 2 HOUR THEN next END AS until FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next,
    (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events) AS mark FROM events) WHERE next > ts + INTERVAL 2 HOUR OR next IS NULL AND ts + INTERVAL 2 HOUR <= mark""")
def stream_stalls(spark, d):
    """Every pause of over two hours, and the runs that hang at the end."""
    x = finished(logs.stall_alerts(event_stream(spark, d), 7200), logs.STALL)
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return x.select("run", at("since"), at("until"))


@query(
    """SELECT run, arg_min(event_id, iter) AS first_event, 2::BIGINT AS length FROM (SELECT *, iter - row_number() OVER (PARTITION BY run ORDER BY iter) AS island FROM log WHERE key = 'error')
    GROUP BY run, island HAVING count(*) >= 2""", "log")
def stream_zero_streak(spark, d):
    return finished(logs.zero_streaks(event_stream(spark, d), 2), logs.STREAK)


@query("SELECT event_id, user_id AS run, value FROM events WHERE value >= 5")
def stream_detections(spark, d):
    x = event_stream(spark, d).withColumn("score", F.col("value"))
    return finished(logs.new_detections(x, ["event_id"], 5.0).select("event_id", "run", "value"), "event_id long, run long, value double")


@query(
    """SELECT event_id, CASE WHEN bool_and(coalesce(CASE WHEN e.event_type = t.metric THEN 80 + e.value END, CASE WHEN t.metric = 'floor' THEN e.value END, 0) >= t.least) THEN 'promoted' ELSE 'rejected' END AS status
    FROM events e, (SELECT DISTINCT event_type AS metric, CASE WHEN length(event_type) > 4 THEN 0.0 ELSE -1.0 END AS least FROM events UNION ALL SELECT 'floor', 5.0) t GROUP BY event_id""")
def stream_kpi_gate(spark, d):
    """Records gated by a thresholds table that lies beside the stream."""
    events, limits, out = X.table(spark, d, "events"), shared_dir(spark, "thresholds"), shared_dir(spark, "gated")
    own = events.select(F.col("event_type").alias("metric")).distinct().withColumn("least", F.when(F.length("metric") > 4, 0.0).otherwise(-1.0))
    own.unionByName(spark.sql("SELECT 'floor' AS metric, 5.0D AS least")).write.parquet(limits)
    x = event_stream(spark, d).select("event_id", F.create_map(F.col("key"), 80 + F.col("value"), F.lit("floor"), F.col("value")).alias("metrics"))
    ended(x, logs.gate_writer(limits, out))
    return spark.read.schema("event_id long, status string").parquet(out).drop("batch")


@query()
def stream_scene_merge(spark, d):
    """Scenes merged as their detections arrive in three batches, a scene's in more than one of them."""
    # scenes are kept in 64 parts, not in a folder each, so files do not grow with them
    part = F.pmod(F.xxhash64("scene"), F.lit(64)).cast("int")
    runs, source, out = scored_runs(spark, d).withColumn("part", part), shared_dir(spark, "detections"), shared_dir(spark, "scenes")
    files = []
    for k in range(3):  # one after the other, so that the stream, which goes by time, has a third in each batch; each is as many files as it takes tasks
        runs.where(F.pmod("inst", F.lit(3)) == k).write.mode("append").parquet(source)
        files.append(len(spark.read.parquet(source).inputFiles()) - sum(files))
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", max(1, *files)).parquet(source)
    ended(stream, logs.scene_merger(out, "part", ["part", "scene", "label"], method="score", threshold=0.5))
    return merged(spark.read.parquet(f"{out}/merged"))


SQL["stream_scene_merge"] = SCENE_SQL["merge_tiles_score"]
