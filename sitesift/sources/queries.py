"""Query sources: files, explicit lists, and the generator of cities by keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms

KEYWORDS = {
    "kitchen_en": terms.QUERY_KITCHEN_EN, "kitchen_ar": terms.QUERY_KITCHEN_AR, "fitout_en": terms.QUERY_FITOUT_EN,
    "fitout_ar": terms.QUERY_FITOUT_AR, "architect_en": terms.QUERY_ARCHITECT_EN, "architect_ar": terms.QUERY_ARCHITECT_AR,
}
SCHEMA = "seq long, q string, tag string, city string"


def _missing(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """seq, line: stripped lines of a text file, without blank ones and comments; a missing file has none."""
    if _missing(spark, path):
        return spark.createDataFrame([], "seq long, line string")
    # a hand-written list: one file, read whole to keep its order
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("seq", "line"))
    return rows.select(F.col("seq").cast("long"), F.trim("line").alias("line")).filter("line <> '' and not startswith(line, '#')")


def query_file(spark: SparkSession, path: str) -> DataFrame | None:
    """Queries of a file, or None if it is missing or empty, so that the caller may generate some."""
    rows = lines(spark, path).select("seq", F.col("line").alias("q"), F.lit("file").alias("tag"), F.lit("").alias("city"))
    return rows if rows.limit(1).count() else None


def url_file(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select("seq", F.col("line").alias("url"))


def generate(spark: SparkSession, cities: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """A query for each city and keyword, city outermost, in order."""
    towns = spark.createDataFrame(list(enumerate(cities or terms.QUERY_CITIES)), "c long, city string")
    words = [(t, w) for t in (tags or KEYWORDS) for w in KEYWORDS[t]]
    keys = spark.createDataFrame([(k, t, w) for k, (t, w) in enumerate(words)], "k long, tag string, word string")
    return towns.crossJoin(keys).select((F.col("c") * len(words) + F.col("k")).alias("seq"), F.concat_ws(" ", "word", "city").alias("q"), "tag", "city")


def for_run(spark: SparkSession, queries: list[str], cities: list[str] | None = None) -> DataFrame:
    """A run's explicit queries, or generated ones for its cities."""
    if queries:
        return spark.createDataFrame([(i, q, "manual", "") for i, q in enumerate(queries)], SCHEMA)
    return generate(spark, cities)


def export(queries: DataFrame, path: str) -> None:
    queries.orderBy("seq").select("q").coalesce(1).write.mode("overwrite").text(path)
