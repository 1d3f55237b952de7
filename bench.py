"""Times the market queries on $BENCH_SF_DIR with $BENCH_CPUS threads; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.operators import gate_queries, ledger_queries, model_queries, panel_queries, report_queries, research_queries, study_queries
from tessera.operators.queries import queries

sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
took = {}
headline = queries() | panel_queries.queries() | study_queries.queries() | ledger_queries.queries() | research_queries.queries() | gate_queries.queries() | model_queries.queries() | report_queries.queries()
headline["bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the JVM warms up once
for name, query in headline.items():
    began = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took[name] = round(time.time() - began, 3)
print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
