"""The streaming quality monitor over the events table."""

from pyspark.sql import functions as F

from tablewright.plans.inputs import SPIKY_SQL, spiky_events
from tablewright.plans.registry import day, query, rounded
from tablewright.session import scratch_path
from tablewright.streaming import monitor

_FACTS = f"""WITH e AS ({SPIKY_SQL}), b AS (SELECT avg(value) AS bm, stddev_samp(value) AS bs FROM e),
 w AS (SELECT date_trunc('day', ts) AS d, count(*) AS n, count(*) - count(value) AS gaps, avg(value) AS m FROM e GROUP BY 1),
 l AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e),
 j AS (SELECT d, n, gaps * 100.0 / n AS p, (m - bm) / bs AS z, (m - bm) / abs(bm) * 100 AS pct FROM w, b, l WHERE d + INTERVAL 1 DAY <= mark)
 SELECT strftime(d, '%Y-%m-%d') AS window_start, 'value' AS metric, n, round(p, 4) AS missing_pct, CASE WHEN p < 5 THEN 'Pass' WHEN p < 20 THEN 'Warning' ELSE 'Fail' END AS missing_status,
 round(z, 6) AS z_shift, CASE WHEN abs(z) >= 1.5 THEN 'High drift' WHEN abs(pct) >= 20 THEN 'Moderate drift' ELSE 'Stable' END AS drift_status FROM j"""


@query("stream_quality_monitor", _FACTS)
def stream_quality_monitor(spark, sf):
    events = spiky_events(spark, sf).select("event_id", "ts", "value")
    folder = scratch_path(spark, "arriving")
    events.repartitionByRange("ts").write.parquet(folder)
    stream = monitor.read_files(spark, folder, events.schema, 1_000)
    out = scratch_path(spark, "judged")
    run = monitor.start_monitor(stream, monitor.baseline(events, ["value"]), "ts", ["value"], out, scratch_path(spark, "state"))
    run.awaitTermination()
    judged = spark.read.parquet(out).drop("batch").withColumn("window_start", day("window_start"))
    return rounded(rounded(judged, 4, ("z_shift",)), 6)
