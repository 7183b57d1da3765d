"""Python workers on executors import this package, too."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def reach_package(spark: SparkSession) -> None:
    """Put this package on the path of Python workers that see the driver's folder.

    Where they do not, ship it as usual (``--py-files``, an image or an environment).
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
