"""Command line: ``domain|subdomain|path rootUrl pages=<table> [key=value ...]`` and ``dataset domain lang yearMonth folder=<in> out=<out>``."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.plans import crawl, pipeline
from corpusloom.sources.files import CrawlParams


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("domain", "subdomain", "path", "dataset"):
        print(__doc__)
        return 2
    options = dict(a.split("=", 1) for a in args if a.startswith(("pages=", "folder=", "out=")))
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if args[0] == "dataset":
        card = pipeline.build_dataset(spark, options["folder"], options["out"], *args[1:4])
        print(card)
        return 0
    params = CrawlParams.parse([f"scope={args[0]}", f"rootUrl={args[1]}", *(a for a in args[2:] if a.split("=")[0] not in options)])
    pages = spark.read.parquet(options["pages"])
    if "ts" not in pages.columns:
        pages = pages.withColumn("ts", F.current_timestamp())
    roots = spark.createDataFrame([(params.rootUrl,)], "root string")

    def allowed(found):
        from corpusloom.functions import robots

        target = U.path(F.col("url"))
        none = spark.createDataFrame([], "host string, kind string, value string")
        return robots.allowed(found, none, U.host(F.col("url")), target, list(params.excludeUrls)).where("robots_allowed")

    done = crawl.breadth_first(pages, roots, params.scope, allowed=allowed if params.excludeUrls else None).crawled
    own = pages.join(done.select("page_id").distinct(), "page_id", "left_semi")
    pipeline.write_extraction(pipeline.extract(own, params.scope), options.get("out", params.storageDir), preview=True)
    params.append_to(str(Path(options.get("out", params.storageDir), "config.txt")))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
