"""Sending the package to executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> str:
    """Add this package, as a zip, to the Python path of all executors; the zip's path. Calling it again changes nothing.

    Functions that run on executors import their modules by name, so a path known to the driver alone is not enough. A cluster whose image has the package installed needs no call.
    """
    known = getattr(spark, "_shotlattice_zip", None)
    if known is None:
        here = Path(__file__).resolve().parent
        known = str(Path(tempfile.mkdtemp(prefix="shotlattice-")) / "shotlattice.zip")
        with zipfile.ZipFile(known, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(here.rglob("*")):
                if f.suffix in (".py", ".txt") and "__pycache__" not in f.parts:
                    z.write(f, f.relative_to(here.parent))
        spark.sparkContext.addPyFile(known)
        spark._shotlattice_zip = known
    return known
