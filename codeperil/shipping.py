"""This package on the Python workers, without a copy of it on every machine."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="codeperil-")) / f"{package.name}.zip"  # the driver serves it
        with zipfile.ZipFile(target, "w") as file:
            for path in sorted(package.rglob("*.py")):
                file.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
