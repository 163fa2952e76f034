"""Makes this repository's code importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session, once per application; Spark serves it to all executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="blockloom-code-")) / "blockloom_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in [*sorted((ROOT / "blockloom").rglob("*.py")), *ROOT.glob("corpus_*.py")]:
            archive.write(file, file.relative_to(ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
