"""Python workers need this package too."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for an application, unless they find it by PYTHONPATH or in the working folder."""
    app = spark.sparkContext.applicationId
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or any(p and Path(p).resolve() == _ROOT for p in paths):
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="trawl-")) / "trawl.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((_ROOT / "trawl").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(target))
