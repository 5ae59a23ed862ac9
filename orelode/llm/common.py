"""What the operators share: reading tables, the shared folder, and materialised steps."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of this machine if all runs in this process (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all its machines share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='orelode-')}")
            atexit.register(shutil.rmtree, _OWN[0].removeprefix("file://"), ignore_errors=True)
        folder = _OWN[0]
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and lost executors cost no more than a stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/orelode-{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd", dictionary: bool = True, append: bool = False) -> DataFrame:
        """df, written (append: to what is there) and read again. dictionary: whether columns may be coded by dictionary (a waste for large unlike values)."""
        path = f"{self.base}/{name}"
        df.write.mode("append" if append else "errorifexists").option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Shuffle files of steps that are written go now, not when the driver next happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._drop(name)

    def _drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, all else as it is: lower() where the text is ASCII, translate() elsewhere."""
    return F.when(F.length(column) == F.octet_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def workers(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def without_spans(text: Column, spans: Column) -> Column:
    """text less the code points of spans, an array of (start, end) in order of start; overlapping ones count once."""
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))

    def step(state, cut):
        kept = F.concat(state["kept"], F.substr(text, state["at"].cast("int") + 1, F.greatest(cut["start"] - state["at"], F.lit(0)).cast("int")))
        return F.struct(F.greatest(state["at"], cut["end"]).alias("at"), kept.alias("kept"))

    return F.aggregate(spans, first, step, lambda s: F.concat(s["kept"], F.substr(text, s["at"].cast("int") + 1)))
