"""Session defaults for local work and tests; on a cluster the session given by the caller is used as it is."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tabsieve")
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), "tabsieve-checkpoints"),
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
