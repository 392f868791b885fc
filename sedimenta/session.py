"""Session helpers: sessions for tests and benches, shipping the package to executors, shared scratch folders."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "sedimenta", **conf: str) -> SparkSession:
    """A local[cores] session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of an Arrow batch between the JVM and Python. By number of rows alone (10,000), a batch of documents takes tens of MB
#: of direct memory, heap and worker, several times over in each task.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers: zip it and hand it to Spark, once a context; bound Arrow batches."""
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_KEY) and sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    if getattr(sc, "_sedimenta_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # an import from a zip is already on the workers' path
        folder = tempfile.mkdtemp(prefix="sedimenta-")
        target = os.path.join(folder, "sedimenta_pkg.zip")
        with zipfile.ZipFile(target, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, f"{root.name}/{file.relative_to(root)}")
        sc.addPyFile(target)
    sc._sedimenta_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder that spark.checkpoint.dir names.

    Only where that setting is unset (tests, one machine) a temporary folder is used instead, and set.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sedimenta.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sedimenta-scratch-")
        spark.conf.set("spark.sedimenta.scratch", base)
    folder = f"{base.rstrip('/')}/sedimenta/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read from there with the schema that is known: no job has to look for it in a file's footer.

    Each job leaves broadcasts on the driver's heap until its garbage is collected, so many small ones fill it.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that this process has freed to the system: after many arrays of a few MB the C library keeps it, over 100 MB."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: Scratch folders by application, in the order in which they were made.
_made: dict[str, list[str]] = {}


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch folders there have been: release() from here removes those made later."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete folders that no result reads any more; missing ones are ignored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession, mark: int = 0) -> None:
    """Delete the scratch folders made since mark (all, if none is given); results that read them are gone after it."""
    made = _made.get(spark.sparkContext.applicationId, [])
    discard(spark, *(f for f in made[mark:] if f))
    made[mark:] = [""] * len(made[mark:])
