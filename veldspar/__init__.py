"""veldspar: Spark-first analytics over scientific property tables."""

from __future__ import annotations

import os
import tempfile
import zipfile

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Send this package to the session's executors once (Spark's own file server carries it)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # The resolved path: the JVM may see the temp folder under another name.
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="veldspar-")), "veldspar.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("veldspar", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
