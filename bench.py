"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from volley.plans.queries import QUERIES

HEADLINE = [
    "unit_firing_stats", "quality_flags", "rule2_high_rate", "remove_ifr_outliers", "auto_edit", "rate_of_agreement",
    "assign_roles", "inst_discharge_rate", "cumulative_spike_train", "recruitment_gain", "spike_triggered_average",
    "peel_off", "apply_unit_filter", "rms_envelope", "channel_covariance", "port_properties", "inherited_masks",
    "concat_recordings", "fold_edit_log",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
