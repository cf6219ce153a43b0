"""Send this package to the executors.

Functions that run in Python workers are pickled by reference, so a worker must be able to import the package from
wherever its own process happens to start. The folder of the package is zipped once per Spark application and added
as a Python file; Spark's own file server carries it to every executor, also to those that join later.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable on every executor of this session's application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    folder = tempfile.mkdtemp(prefix="quotemill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quotemill_code.zip")
    root = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for inside, _, names in sorted(os.walk(_PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(inside, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _done.add(context.applicationId)
