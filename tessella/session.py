"""Sessions and the few settings that the library reads or sets."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every query here assumes; ``conf`` keys use ``__`` for a dot."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``, or a temporary one where that is unset in local mode (tests); an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set; a cluster needs a folder that all its executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parallelism(df: DataFrame) -> int:
    """Shuffle width of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application: they needn't have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella.zip")  # on the driver, read by Spark's file server
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("tessella", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._tessella_shipped = True
