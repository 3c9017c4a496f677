"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from tidegauge import Engine
from tidegauge import queries as core
from tidegauge.sources.line_protocol import parsed

NAMES = (
    "agg_by_time_tag_whole", "agg_basic_global", "agg_by_time", "agg_by_tag", "agg_group_all", "raw_desc_limit_offset", "raw_star_limit", "where_field_ops", "where_regex",
    "first_last", "percentile", "mode", "derivative_whole", "moving_average", "cumulative_sum", "top_by_tag", "fill_linear_whole", "subquery_tags", "lww_merge", "show_series",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in NAMES:
        run = core.QUERIES[name]
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles code, fills the page cache
        begin = time.time()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begin, 4)

    # Ingest: ten times the points of ``events`` as text, parsed, and written and committed.
    once = core.engine(spark, sf_dir).export_lines(core.DB, "events").repartition(int(cpus))
    lines = once.selectExpr("value", "explode(sequence(1, 10)) as copy").selectExpr("value", "monotonically_increasing_id() as line").cache()
    n = lines.count()
    parsed(lines.limit(1000)).write.format("noop").mode("overwrite").save()  # starts the workers
    begin = time.time()
    parsed(lines).write.format("noop").mode("overwrite").save()
    rate = n / (time.time() - begin)
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        store = Engine(spark, f"file://{folder}")
        begin = time.time()
        store.write_lines(lines, core.DB)
        written = n / (time.time() - begin)
        for name, ready in (("stored_merged", lambda: None), ("stored_compacted", lambda: store.compact(core.DB, "events"))):
            ready()
            for _ in range(2):  # the second run counts
                begin = time.time()
                store.query("SELECT mean(value), count(value) FROM events GROUP BY time(1d), event_type", core.DB).write.format("noop").mode("overwrite").save()
                took[name] = round(time.time() - begin, 4)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    rates = {"line_protocol_points_per_sec": round(rate), "line_protocol_points_written_per_sec": round(written)}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")} | rates))


if __name__ == "__main__":
    main()
