"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON.

Besides, an archive's commands over the documents' bytes by themselves, with blocks of 4096 and of 256 bytes: the first pack, a second one
of which all is known, unpacking and verifying, also in MB (10^6 bytes) a second."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = ("pack_roundtrip_cdc", "incremental_archive", "dedup_stats", "dedup_first_seen", "dedup_incremental", "recipe_rle", "delta_overlay", "run_iter", "dual_iter", "snapshot_diff", "provisioned_count")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lamina.catalog import QUERIES as known

    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds = {}
    for name in QUERIES:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    from pyspark.sql import functions as F

    from lamina.plans.archive import Archive
    from lamina.session import shared_folder
    from lamina.sources import payloads

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    streams = payloads.texts(docs, "doc_id")
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    rates = {}
    for block in (4096, 256):
        archive = Archive(spark, shared_folder(spark)).create(block_size=block)
        again = payloads.texts(docs, F.concat(F.lit("again-"), F.col("doc_id").cast("string")))
        for name, run in {"pack": lambda: archive.pack(streams), "pack_known": lambda: archive.pack(again), "unpack": lambda: done(archive.unpack()), "verify": lambda: done(archive.verify(streams))}.items():
            began = time.time()
            run()
            took = time.time() - began
            seconds[f"{name}_{block}"] = round(took, 3)
            rates[f"{name}_{block}"] = round(size * (2 if name == "unpack" else 1) / 1e6 / took, 2)  # both streams are unpacked
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "mb_per_s": rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
