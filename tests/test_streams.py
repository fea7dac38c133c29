"""Streaming forms against the batch forms."""

from pyspark.sql import functions as F

from tests.conftest import SF
from webloom.plans.store import CDP
from webloom.plans.tables import sql
from webloom.streaming import events as T


def test_streamed_requests_match_batch(spark, tmp_path):
    rows = T.captured(sql(spark, SF, CDP, "events")).where("request_id in ('r0', 'r1', 'r4', 'r5', 'r8')").drop("ts")
    rows = rows.withColumn("status_code", F.col("status_code").cast("long"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.streamed_requests(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    got = {(r["request_id"], r["seq"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["completed"]}
    own = rows.groupBy("request_id").agg(F.count(F.lit(1))).count()
    assert own and got
    opened = {}
    for r in rows.orderBy("seq").collect():  # the same machine, by hand
        k = r["request_id"]
        if r["kind"] == "redirect" and k in opened:
            assert got[(k, opened[k])]["redirect_to"] == r["url"]
            opened[k] = r["seq"]
        elif r["kind"] in ("sent", "redirect"):
            opened[k] = r["seq"]
        elif r["kind"] in ("finished", "failed") and k in opened:
            assert got[(k, opened.pop(k))]["failed"] == (r["kind"] == "failed")


def test_streamed_sessions_match_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.streamed_sessions(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "10 minutes", "4 days", ("user_id",))
    run = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    batch = T.sessions(rows, "10 minutes", ("user_id",))
    assert sorted(spark.table("sessions").where("user_id >= 0").collect()) == sorted(batch.collect())


def test_streamed_idle_matches_batch(spark, tmp_path):
    rows = [("p", "a", "start", 0.0), ("p", "a", "end", 1.0), ("p", "b", "start", 1.5), ("p", "c", "start", 30.0), ("p", "c", "end", 30.1), ("q", "a", "start", 0.2), ("q", "b", "start", 0.3), ("q", "b", "end", 0.9), ("q", "a", "end", 2.0)]
    made = lambda part: spark.createDataFrame(part, "page string, request_id string, kind string, t double").select("page", "request_id", "kind", F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts"))
    for part in (rows[:3] + rows[5:], rows[3:5], [("z", "z", "start", 500.0)], [("z", "y", "start", 900.0)]):
        made(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(made(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "60 seconds")
    run = T.streamed_idle(events, "page").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = sorted((r["page"], r["ms"]) for r in spark.read.parquet(str(tmp_path / "out")).where("page <> 'z'").select("page", F.unix_millis("idle_from").alias("ms")).collect())
    batch = T.idle_points(made(rows), "page").select("page", F.unix_millis("idle_from").alias("ms"))
    assert got == sorted((r["page"], r["ms"]) for r in batch.collect()) and len(got) == 3


def test_streamed_late_bodies(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    found = spark.range(4).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit("u").alias("url"), F.timestamp_seconds(F.col("id") * 10 + 1000).alias("ts"), (F.col("id") != 3).alias("newest"))
    bodies = spark.range(4).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit("u").alias("url"), F.timestamp_seconds(F.col("id") * 10 + 1000 + F.when(F.col("id") == 2, 60).otherwise(2)).alias("ts"), F.concat(F.lit("body"), "id").alias("body"))
    ends = spark.range(1).select(F.lit("end").alias("request_id"), F.lit("u").alias("url"), at(9000).alias("ts"))
    for name, df, end in (("found", found, ends.withColumn("newest", F.lit(True))), ("bodies", bodies, ends.withColumn("body", F.lit("x")))):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        end.write.mode("append").parquet(str(tmp_path / name))
        end.withColumn("ts", at(19000)).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)).withWatermark("ts", "100 seconds")
    out = T.streamed_late_bodies(read("found", found), read("bodies", bodies), "30 seconds")
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted((r["request_id"], r["body"]) for r in spark.read.parquet(str(tmp_path / "out")).where("request_id <> 'end'").collect()) == [("r0", "body0"), ("r1", "body1"), ("r2", None), ("r3", None)]


def test_late_bodies_and_idle(spark):
    found = spark.createDataFrame([("r", 0, "u"), ("r", 1, "u")], "request_id string, redirect_index int, url string")
    bodies = spark.createDataFrame([("r", "u", 9, "late"), ("r", "u", 3, "early")], "request_id string, url string, seq long, body string")
    assert sorted((r["redirect_index"], r["body"]) for r in T.with_late_bodies(found, bodies).collect()) == [(0, None), (1, "late")]
    events = spark.createDataFrame([("p", "a", "start", 0.0), ("p", "a", "end", 1.0), ("p", "b", "start", 1.5), ("p", "c", "start", 30.0), ("p", "c", "end", 30.1)], "page string, request_id string, kind string, t double")
    idle = T.idle_points(events.withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long"))), "page")
    assert [r["ms"] for r in idle.select(F.unix_millis("idle_from").alias("ms")).orderBy("ms").collect()] == [6500, 30100]
