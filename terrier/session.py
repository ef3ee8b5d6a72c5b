"""The session's side of things: the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED = "spark.terrier.shipped"


def ship(spark: SparkSession) -> None:
    """Give the workers of a local master this package, once a session, unless their PYTHONPATH has it.

    On a cluster the package comes with the job (``--py-files`` or the executors' PYTHONPATH), and nothing is written here.
    """
    if not spark.sparkContext.master.startswith("local") or ROOT in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))) or spark.conf.get(_SHIPPED, None):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "terrier.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "terrier")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
        if os.path.exists(extra := os.path.join(ROOT, "corpus_pipeline.py")):
            z.write(extra, "corpus_pipeline.py")
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, "true")
