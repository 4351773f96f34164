"""Intermediate tables that are written once and read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; on one machine, where it's unset, one in the warehouse."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"{spark.conf.get('spark.sql.warehouse.dir')}/held"
    return place


def held(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again; the files go when the session ends.

    For what is dear to make and is read several times: each reader takes the columns that it needs, none makes df again,
    and nothing stays in the executors' memory."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
