"""Session factory for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", **extra: str) -> SparkSession:
    """A UTC session on ``local[cores]``. The checkpoint folder is set only where none is named."""
    conf = {
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName("oddsmill")
    if "spark.checkpoint.dir" not in conf:
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="oddsmill-")
    for key, value in conf.items():
        builder = builder.config(key, value)
    os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all machines share. A local session without one gets a folder of its own; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="oddsmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
