"""The Spark session that the engine expects, and working tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
import zipfile
from itertools import count, islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Rows that Spark hands to a Python worker at once, unless the session says otherwise.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; shuffle partitions stay with the cluster, as adaptive execution coalesces them."""
    builder = SparkSession.builder.appName("plainlake").config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_plainlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="plainlake-ship-")) / "plainlake.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("plainlake") / f.relative_to(root))
    sc.addPyFile(str(to))
    # Texts are long: smaller batches keep what a worker and its executor hold of a table small.
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "2000")
    sc._plainlake_shipped = True


def let_go(spark: SparkSession) -> None:
    """The driver drops what its queries left: plans that Python objects still name, and the broadcasts and shuffle files
    that Spark cleans up when it finds them unused, which without a collection may be never."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ease(spark: SparkSession) -> None:
    """let_go once the driver's heap takes over half of its limit and more than the last collection left of it. A heap
    gives nothing back by itself, and a stage of many queries fills it with what is no longer used."""
    sc = spark.sparkContext
    heap = sc._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > max(heap.maxMemory() // 2, getattr(sc, "_plainlake_heap", 0)):
        let_go(spark)
        sc._plainlake_heap = heap.totalMemory()


SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may fall back to a folder of its own."""
    conf = spark.sparkContext.getConf()
    if root := conf.get(SETTING):
        return root
    if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
        raise ValueError(f"{SETTING} must name a shared folder on a cluster")
    made = spark.conf.get("plainlake.local.root", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="plainlake-")
        spark.conf.set("plainlake.local.root", made)
        spark.sparkContext.setCheckpointDir(made)
    return made


class Workspace:
    """Parquet tables below the shared folder; they cut lineage, survive lost executors and go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/plainlake-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        ease(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        try:
            jvm, hadoop = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(hadoop).delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may have ended before Python
            pass


def free_names(df: DataFrame, n: int) -> list[str]:
    """`n` column names that `df` doesn't have, whatever its own are called."""
    taken = {c.lower() for c in df.columns}
    return list(islice((x for k in count() if (x := f"_pl{k}") not in taken), n))
