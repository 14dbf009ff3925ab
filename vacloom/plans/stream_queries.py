"""Events read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import role, table, with_roles
from ..streaming import feed as op
from ..streaming import stateful
from .catalog import query


def events(spark, sf_dir):
    stream = op.event_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    kind = F.col("event_type")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "change_type", F.when(kind.isin("signup", "purchase"), "job_opened").when(kind == "error", "job_closed").otherwise("job_updated")
    )


@query("stream_deduplicated_feed", "SELECT event_id, user_id FROM events")
def stream_deduplicated_feed(spark, sf_dir):
    return op.append_new(events(spark, sf_dir).select("event_id", "user_id"), "event_id", op.run_folder(spark))


@query("stream_day_movements", """
  SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS opened,
    count(*) FILTER (WHERE event_type = 'error') AS closed FROM events
  WHERE date_trunc('day', ts) + INTERVAL '1' DAY <= (SELECT max(ts) FROM events) - INTERVAL '1' DAY GROUP BY 1, 2""")
def stream_day_movements(spark, sf_dir):
    moved = op.run_available(op.day_movements(events(spark, sf_dir), ["user_id"], "ts"))
    return moved.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_trailing_deltas", """
  WITH e AS (SELECT user_id, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS net FROM events),
  d AS (SELECT day FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL '8' DAY, INTERVAL '1' DAY)) AS day FROM events)
    WHERE day <= (SELECT max(ts) FROM events) - INTERVAL '1' DAY)
  SELECT strftime(day, '%Y-%m-%d') AS until, user_id, CAST(sum(net) AS BIGINT) AS delta FROM d JOIN e ON ts >= day - INTERVAL '7' DAY AND ts < day GROUP BY 1, 2""")
def stream_trailing_deltas(spark, sf_dir):
    moved = op.run_available(op.trailing_deltas(events(spark, sf_dir), ["user_id"], "ts", days=7))
    return moved.select(F.date_format("until", "yyyy-MM-dd").alias("until"), "user_id", "delta")


@query("stream_enriched_events", with_roles("company", "job", then="""
  SELECT event_id, j.company_id, c.name, c.sector FROM events LEFT JOIN job_role j ON j.job_id = event_id LEFT JOIN company_role c USING (company_id)"""))
def stream_enriched_events(spark, sf_dir):
    stream = events(spark, sf_dir).select("event_id", F.col("event_id").alias("job_id"))
    return op.run_available(op.enriched(stream, role(spark, sf_dir, "job"), role(spark, sf_dir, "company")).select("event_id", "company_id", "name", "sector"))


@query("stream_fragile_closures", """
  WITH e AS (SELECT user_id, epoch_ms(ts) AS ms, event_type IN ('purchase', 'signup') AS seen, event_id FROM events
    WHERE date_trunc('millisecond', ts) < date_trunc('millisecond', (SELECT max(ts) FROM events) - INTERVAL '1' DAY)),
  l AS (SELECT user_id, list_prepend({'ms': 0::BIGINT, 'seen': true, 'first': NULL::BIGINT, 'closed': 0::BIGINT},
      list({'ms': ms, 'seen': seen, 'first': NULL::BIGINT, 'closed': 0::BIGINT} ORDER BY ms, event_id)) AS steps FROM e GROUP BY user_id),
  r AS (SELECT user_id, list_reduce(steps, lambda a, x: {'ms': x.ms, 'seen': x.seen,
      'first': CASE WHEN x.seen THEN NULL WHEN a.first IS NULL OR x.ms - a.first > 172800000 THEN x.ms WHEN x.ms - a.first < 86400000 THEN a.first END,
      'closed': a.closed + CASE WHEN NOT x.seen AND x.ms - a.first BETWEEN 86400000 AND 172800000 THEN 1 ELSE 0 END}) AS s FROM l)
  SELECT user_id, s.closed AS closures FROM r WHERE s.closed > 0""")
def stream_fragile_closures(spark, sf_dir):
    stream = events(spark, sf_dir).select("user_id", "ts", "event_id", F.col("event_type").isin("purchase", "signup").alias("seen"))
    closed = op.run_available(stateful.closed_after_misses(stream, ["user_id"], "ts", "event_id", "seen"))
    return closed.groupBy("user_id").agg(F.count(F.lit(1)).alias("closures"))


@query("stream_expired_signals", """
  SELECT event_id, strftime(ts + INTERVAL '5' DAY, '%Y-%m-%d %H:%M:%S') AS expired FROM events
  WHERE date_trunc('millisecond', ts + INTERVAL '5' DAY) < date_trunc('millisecond', (SELECT max(ts) FROM events) - INTERVAL '1' DAY)""")
def stream_expired_signals(spark, sf_dir):
    stream = events(spark, sf_dir).select("event_id", "ts", (F.col("ts") + F.expr("INTERVAL '5' DAY")).alias("expires_at"))
    expired = op.run_available(stateful.expired_signals(stream, "event_id", "ts", "expires_at"))
    return expired.select("event_id", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss").alias("expired"))


@query("stream_snapshot_intake", "SELECT user_id AS source_id, strftime(ts, '%Y-%m-%d') AS run_id, event_id AS external_id FROM events")
def stream_snapshot_intake(spark, sf_dir):
    stream = events(spark, sf_dir).select(
        F.col("user_id").alias("source_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_id").alias("external_id"))
    return stateful.take_in_snapshots(stream, ["run_id", "source_id"], op.run_folder(spark))


@query("stream_saved_searches", """
  SELECT CAST(event_type AS VARCHAR) || CAST(band AS VARCHAR) AS search_id, user_id, 'enter' AS change
  FROM (SELECT user_id, arg_max(event_type, ts) AS event_type, CAST(floor(arg_max(value, ts) / 20) AS BIGINT) AS band FROM events GROUP BY user_id) WHERE event_type <> 'error' AND band < 3""")
def stream_saved_searches(spark, sf_dir):
    band = F.floor(F.col("value") / 20).cast("long")
    stream = events(spark, sf_dir).select("user_id", "ts", "event_type", band.alias("band"))
    kinds = table(spark, sf_dir, "events").select("event_type", band.alias("band")).filter("band < 3").distinct()
    searches = kinds.withColumn("search_id", F.concat("event_type", F.col("band").cast("string")))
    return stateful.watch_searches(stream, searches, ["event_type", "band"], "user_id", "ts", F.col("event_type") != "error", op.run_folder(spark))
