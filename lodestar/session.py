"""The session settings every plan here assumes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "lodestar", **extra: str) -> SparkSession:
    """A session with UTC time and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed and kept in the shared checkpoint folder, so that its plan ends here.

    The folder is the session's spark.checkpoint.dir; where that is unset, a temporary
    one on a local master, and an error on a cluster.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            base = f"file://{tempfile.mkdtemp(prefix='lodestar-checkpoint-')}"
        context.setCheckpointDir(base)
    return df.checkpoint()
