"""Scanning a growing directory of pages: summaries are appended as pages arrive, the site roll-up is a batch view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the scan keeps of each page and batch, and what a batch changes of each site.
PAGES = "url string, site string, findings long, high long, acts long, batch long, bucket int"
SITES = "site string, pages long, findings long, high long, acts long, batch long"
BUCKETS = 64
COUNTS = ("findings", "high", "acts")


def summarise(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site"))


def scan(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Takes in all pages that are at `source` (Parquet files or directories of them) and returns the roll-up by site.

    State and summaries are under `target`, a folder that all executors share: a stream that is run again there goes on where
    it ended, and takes each file once.
    """
    schema = spark.read.parquet(source).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    # A stream watches a folder; of one file's folder it takes that file only.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else path.getName()).parquet(source if folder else path.getParent().toString())
    query = summarise(stream).writeStream.format("parquet").option("path", f"{target}/summaries").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{target}/summaries")
    return done.groupBy("site").agg(F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"))


def audited(pages: DataFrame) -> DataFrame:
    """page_id, url, findings, high and acts (1 if a link offers an action) of pages, by the whole audit."""
    from pagewright.operators import audit

    return audit.page_summaries(pages).select("page_id", "url", "findings", "high", F.col("has_action").cast("long").alias("acts"))


def take_in(batch: DataFrame, batch_id: int, target: str, summarise: Callable[[DataFrame], DataFrame]) -> None:
    """One micro-batch: audits its pages and writes their summaries, and the change of each site's counts.

    A page is known by its url: one seen before replaces its earlier summary, so that a site changes by the difference. Of a
    url's rows within the batch the one of the greatest page_id counts. Earlier summaries are looked up in the buckets of the
    batch's urls only. Both writes overwrite the batch's own folder and read batches before it, so that a batch that is run
    again after a failure comes to the same.
    """
    spark = batch.sparkSession
    own = Window.partitionBy("url").orderBy(F.desc_nulls_last("page_id"))
    once = batch.where("url IS NOT NULL").withColumn("_nth", F.row_number().over(own)).where("_nth = 1").drop("_nth")
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    rows = summarise(once).select("url", F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site"), *[F.col(c).cast("long").alias(c) for c in COUNTS])
    rows = rows.withColumns({"batch": F.lit(batch_id).cast("long"), "bucket": F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int")})
    rows.drop("batch").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/pages/batch={batch_id}")
    every = spark.read.schema(PAGES).parquet(f"{target}/pages")
    new = every.where(F.col("batch") == batch_id)
    touched = new.select("bucket").distinct()
    earlier = every.where(F.col("batch") < batch_id).join(F.broadcast(touched), "bucket", "left_semi").join(new.select("url"), "url", "left_semi")  # at most BUCKETS rows
    last = earlier.groupBy("url").agg(F.max_by(F.struct("site", *COUNTS), "batch").alias("x")).select("x.*")
    signed = new.select("site", *COUNTS, F.lit(1).alias("sign")).unionByName(last.withColumn("sign", F.lit(-1)))
    delta = signed.groupBy("site").agg(F.sum("sign").alias("pages"), *[F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS])
    delta.write.mode("overwrite").parquet(f"{target}/sites/batch={batch_id}")


def audit_scan(spark: SparkSession, source: str, target: str, summarise: Callable[[DataFrame], DataFrame] = audited, files: int = 100) -> DataFrame:
    """Audits all pages that are at `source` (a folder of Parquet files) and that earlier calls haven't taken in, `files` files
    at a time, and returns the roll-up by site: site, pages, findings, high, acts. See take_in().

    Everything is under `target`, a folder that all executors share; a scan that was stopped goes on where it ended. The
    roll-up adds up the changes of sites and reads no page.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, k: take_in(batch, k, target, summarise)).option("checkpointLocation", f"{target}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return site_counts(spark, target)


def site_counts(spark: SparkSession, target: str) -> DataFrame:
    changes = spark.read.schema(SITES).parquet(f"{target}/sites")
    summed = changes.groupBy("site").agg(*[F.sum(c).alias(c) for c in ("pages", *COUNTS)])
    return summed.where("pages > 0")
