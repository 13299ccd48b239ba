"""Session settings and table access shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "coppice", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of this application, once: they need not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(), "coppice.zip")
    with zipfile.ZipFile(out, "w") as z:
        for root, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(root, n), os.path.relpath(os.path.join(root, n), os.path.dirname(package)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints. The cluster's setting wins; only where there is none (tests), a local one is made."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "coppice-checkpoints"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, for tables of this run."""
    return f"{checkpoint_dir(spark)}/coppice-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str, append: bool = False) -> None:
    """A small file on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = read_text(spark, path) if append and fs.exists(at) else ""
    out = fs.create(at, True)
    try:
        out.write(bytearray((before + text).encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read again: survives lost executors, lineage ends here."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
