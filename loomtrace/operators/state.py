"""State of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder that spark.checkpoint.dir names.

    Only where that is unset and the master is local (tests, notebooks) a folder of this machine is used.
    """
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to and read from that folder in columns, which takes less room than a checkpoint."""
    path = fresh(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame) -> str:
    """A name in that folder that nothing has yet."""
    return f"{_shared(df)}/stored-{uuid.uuid4().hex}"


def _shared(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or f"file://{tempfile.mkdtemp(prefix='loomtrace-')}")
    return context.getCheckpointDir()
