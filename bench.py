"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cmdlake.functions import entropy
from cmdlake.operators import anomaly, policy
from cmdlake.plans import queries as plans

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
#: The three workloads: 200 literal rules, 100 path rules and 100 value rules; so many commands of each.
RULES = [f"cmd{i} arg" for i in range(200)] + [f"svc{i} #path" for i in range(100)] + [f"opt{i} #val" for i in range(100)] + ["dd #size.MiB"]
ROWS = 100_000


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rules = policy.antichain(policy.parse(spark.createDataFrame([(p,) for p in RULES], "pattern string"))).cache()
    rules.count()
    ids = spark.range(0, ROWS, 1, int(CPUS)).withColumnRenamed("id", "cmd_id")
    texts = {
        "literal_match": F.concat(F.lit("cmd"), (F.col("cmd_id") % 200).cast("string"), F.lit(" arg")),
        "literal_miss": F.concat(F.lit("nonexist"), F.col("cmd_id").cast("string"), F.lit(" baz")),
        "wildcard_match": F.concat(F.lit("svc"), (F.col("cmd_id") % 100).cast("string"), F.lit(" /etc/hosts")),
    }
    runs = {k: (lambda c=c: policy.match_all(ids.withColumn("command", c), rules)) for k, c in texts.items()}
    events = plans._events(spark, DIR)
    runs["ngram_4"] = lambda: anomaly.ngram_counts(events, 4)
    runs["kn_score"] = lambda: anomaly.scores(events, anomaly.model(events))
    runs["shannon_entropy"] = lambda: plans._env(spark, DIR).select("id", entropy.shannon_entropy(F.col("value")).alias("h"))
    runs["secret_posterior"] = lambda: entropy.secret_scores(plans._env(spark, DIR))
    took = {}
    for name, run in runs.items():
        run().write.format("noop").mode("overwrite").save()  # compiled and warm
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    rate = {k: round(ROWS / took[k]) for k in texts}
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "commands_per_sec": rate, "rows": ROWS, "sf": DIR.rsplit("sf", 1)[-1], "spark": spark.version, "local": CPUS}))


if __name__ == "__main__":
    main()
