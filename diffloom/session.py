"""Session for tests and local runs; a cluster brings its own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Functions that run in workers are found by their module's name, so workers need the
    package unless it is installed on all machines.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if package.suffix != ".zip" and package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="diffloom-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
            for source in sorted(package.rglob("*.py")):
                file.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)


def local_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("diffloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
