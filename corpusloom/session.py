"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder of ``spark.checkpoint.dir``: computed once, survives lost executors.

    Where that setting is absent, a session whose executors are threads of one process (``local[n]``) uses a folder of its own;
    on a cluster it is an error, since executors and driver would not see the same folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint()
