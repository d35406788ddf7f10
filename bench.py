"""Times of the curve queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arcwright import nn
from arcwright.operators.neighbors import knn
from arcwright.operators.walk import order
from arcwright.plans.queries import QUERIES
from arcwright.spec import Spec

NAMES = ["metric_full", "knn", "severed_edges", "walk_spatial", "walk_aligned", "walk_full", "walk_both", "interp_ordered", "standard_scaler_transform", "kde_weights", "running_mean", "mst_order", "fill_gaps"]


#: Points of a sine curve to train on, and epochs of the three phases.
POINTS, EPOCHS = 50, (50, 100, 50)


def training(spark):
    x = "10.0D * id / 49"
    points = spark.range(POINTS).selectExpr("'0' as stream_id", "id as idx", f"{x} as x", f"0.5D * sin({x}) as y", "1.0D as vx", f"0.5D * cos({x}) as vy")
    config = nn.TrainingConfig(nn.EncoderConfig(n_epochs=EPOCHS[0]), nn.DecoderConfig(n_epochs=EPOCHS[1]), n_epochs_both=EPOCHS[2])
    return nn.train(points, order(points, Spec()), Spec(), config=config)


#: Points of which half lie in a millionth of the extent: neighbours over leaves.
DENSE_POINTS = 80_000


def dense_neighbours(spark):
    at = lambda seed: F.rand(seed) * F.when(F.col("id") % 2 == 0, 1e-6).otherwise(1.0)
    points = spark.range(DENSE_POINTS).select(F.lit("s").alias("stream_id"), F.col("id").alias("idx"), at(1).alias("x"), at(2).alias("y"), F.lit(1.0).alias("vx"), F.lit(1.0).alias("vy"))
    return knn(points, Spec(), 10)


#: What isn't a registered query.
OTHERS = {"train_50_points": training, "knn_80000_half_dense": dense_neighbours}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in [*NAMES, *OTHERS]:
        begin = time.perf_counter()
        (OTHERS[name](spark) if name in OTHERS else QUERIES[name](spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "curve_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
