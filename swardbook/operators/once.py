"""Rows that are computed once and read many times, with a plan that begins anew."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """The rows, checkpointed now in spark.checkpoint.dir, which driver and executors share.

    Where that is unset, local mode gets a temporary folder and a cluster an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="once-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return df.checkpoint()
