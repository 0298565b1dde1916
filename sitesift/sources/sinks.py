"""Outputs: JSON lines, a JSON index that is switched as a whole, and wide CSV."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns of the CSV output, in order.
CSV_COLUMNS = (
    "lead_id lead_type category name country city email phone website source relevance_score decision discovered_at domain confidence empty_content"
).split()


def write_candidates(candidates: DataFrame, path: str) -> None:
    """JSON lines sorted by domain."""
    candidates.orderBy("domain").write.mode("overwrite").json(path)


def wide_signals(leads: DataFrame) -> DataFrame:
    """The CSV columns, a column signal_<key> for each distinct key in order, and all signals as JSON; what is missing is empty."""
    keys = [r[0] for r in leads.select(F.explode(F.map_keys("signals")).alias("k")).distinct().orderBy("k").collect()]  # a few dozen names
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    base = [text(F.col(c)).alias(c) if c in leads.columns else F.lit("").alias(c) for c in CSV_COLUMNS]
    return leads.select(*base, *[text(F.try_element_at("signals", F.lit(k))).alias(f"signal_{k}") for k in keys], F.to_json("signals").alias("signals_json"))


def write_csv(leads: DataFrame, path: str) -> None:
    wide_signals(leads).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


class Snapshot:
    """A table in versions. A version is written beside the others, then a pointer of the next number is put there by one rename; the pointer with the highest
    number holds, so whatever stops half-way leaves the old version in force. The last two versions are kept, for readers.

    With a key, rows are dealt to buckets by its hash, and `merge` writes anew only the buckets that new rows touch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str | None = None, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets if key else 1

    def _name(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._name().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs().exists(self._name()):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(self._name())]
        return sorted(int(n[len("CURRENT-") :]) for n in names if re.fullmatch(r"CURRENT-\d+", n))

    def _folders(self, number: int) -> dict[int, str]:
        return {int(k): v for k, v in json.loads(self.spark.read.text(f"{self.path}/CURRENT-{number}").first()[0]).items()}

    def current(self) -> dict[int, str]:
        """Each bucket's folder."""
        numbers = self._numbers()
        return self._folders(numbers[-1]) if numbers else {}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The current version, or some of its buckets; empty if there is none."""
        folders = [f"{self.path}/{v}" for k, v in sorted(self.current().items()) if buckets is None or k in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def _write(self, rows: DataFrame) -> dict[int, str]:
        version = f"v-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        names = [f.getPath().getName() for f in self._fs().listStatus(self._name(version)) if f.isDirectory()]
        return {int(n.split("=")[1]): f"{version}/{n}" for n in names if n.startswith("bucket=")}

    def _point(self, folders: dict[int, str]) -> None:
        fs, numbers = self._fs(), self._numbers()
        number = numbers[-1] + 1 if numbers else 0
        before = self.current()
        out = fs.create(self._name("next"), True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not fs.rename(self._name("next"), self._name(f"CURRENT-{number}")):
            raise OSError(f"{self.path}/CURRENT-{number} could not be put in place")
        used = {v.split("/")[0] for v in (*folders.values(), *before.values())}
        for f in fs.listStatus(self._name()):
            name = f.getPath().getName()
            if name.startswith("v-") and name not in used or name in {f"CURRENT-{n}" for n in numbers[:-1]}:
                fs.delete(f.getPath(), True)

    def replace(self, rows: DataFrame) -> None:
        self._point(self._write(rows))

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """how(old rows, new rows) in place of the buckets that new rows fall into."""
        touched = [r[0] for r in new.select(self._bucket().alias("bucket")).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        kept = {k: v for k, v in self.current().items() if k not in touched}
        self._point({**kept, **self._write(how(self.read(touched), new))})


def read_index(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of leads or candidates; corrupt lines are dropped, a missing folder is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where driver and executors are one process."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sitesift-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that several steps read it without making it anew. The folder goes when the driver ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
