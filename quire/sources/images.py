"""Covers from image files: Spark's image source, scaled by areas, as a table of pixels. Native: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width and height of a thumbnail.
WIDTH, HEIGHT = 100, 150


def overlaps(place: Column, size: Column, cells: int) -> Column:
    """An array of (cell, part): the cells of a side that a pixel of a picture of that size meets, and how much of them, in whole numbers."""
    first, last = F.floor(place * cells / size), F.ceil((place + 1) * cells / size) - 1
    part = lambda t: F.least((t + 1) * size, (place + 1) * cells) - F.greatest(t * size, place * cells)
    return F.filter(F.transform(F.sequence(first, last), lambda t: F.struct(t.cast("int").alias("cell"), part(t).cast("long").alias("part"))), lambda o: o.part > 0)


def thumbnails(spark: SparkSession, path: str, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(path, x, y, r, g, b): pictures (jpeg, png, gif, bmp) scaled to width by height, each pixel the mean of the area that it covers.

    Grey pictures have three equal colours; transparency counts for nothing; files that are no picture give no rows. A picture's
    pixels are rows that are summed up in each task; at most width * height of a picture are shuffled.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").withColumnRenamed("nChannels", "n")
    row = F.decode(F.substring("data", F.col("sy") * F.col("width") * F.col("n") + 1, F.col("width") * F.col("n")), "ISO-8859-1")
    lines = raw.withColumn("sy", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).select("origin", "width", "height", "n", "sy", row.alias("row"))
    pixels = lines.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("sx"))
    value = lambda k: F.ascii(F.substring(F.col("row"), F.col("sx") * F.col("n") + F.when(F.col("n") == 1, 1).otherwise(k), F.lit(1)))
    told = pixels.select(  # colours stand in the order blue, green, red
        "origin", value(3).alias("r"), value(2).alias("g"), value(1).alias("b"),
        F.explode(overlaps(F.col("sx"), F.col("width"), width)).alias("ox"), overlaps(F.col("sy"), F.col("height"), height).alias("oys"),
    ).select("*", F.explode("oys").alias("oy"))
    area = F.col("ox.part") * F.col("oy.part")
    mean = lambda c: F.floor(F.sum(F.col(c) * area) / F.sum(area) + 0.5).cast("int").alias(c)
    return told.groupBy(F.col("origin").alias("path"), F.col("ox.cell").alias("x"), F.col("oy.cell").alias("y")).agg(mean("r"), mean("g"), mean("b"))


def covers(spark: SparkSession, path: str) -> DataFrame:
    """(gid, x, y, r, g, b): thumbnails of files that are named as covers are."""
    number = F.regexp_extract("path", r"(?:^|/)pg(\d+)\.cover\.\w+\.\w+$", 1)
    return thumbnails(spark, path).withColumn("gid", F.nullif(number, F.lit("")).cast("long")).filter("gid IS NOT NULL").drop("path")
