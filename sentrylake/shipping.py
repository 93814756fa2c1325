"""Makes this package importable in Python workers."""

from __future__ import annotations

import io
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Once per application: hands the package to every executor as a zip file, so that tasks find it wherever the driver runs."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    if not root.is_dir():  # already from a zip file
        return
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = pathlib.Path(tempfile.mkdtemp(prefix="sentrylake-"), "sentrylake_package.zip")
    path.write_bytes(raw.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped[app] = str(path)
