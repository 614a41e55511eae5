"""quarry: product and passage retrieval, reranking and ranking-quality
evaluation as Spark DataFrame jobs."""

from __future__ import annotations

import os
import tempfile
import zipfile

__version__ = "0.1.0"


def ship(spark) -> None:
    """Make the package importable in Python workers (``addPyFile`` of a
    zip of this package, once per SparkContext) -- the programmatic form
    of ``--py-files``."""
    sc = spark.sparkContext
    if getattr(sc, "quarry_shipped", False):  # on the context itself: a new one has no mark
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="quarry-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc.quarry_shipped = True
