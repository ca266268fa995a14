"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session for tests and benchmarks: UTC, AQE, few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plenum")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Let the executors import this package, once per application, wherever the driver found it."""
    import tempfile
    import zipfile
    from pathlib import Path

    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId not in _shipped:
        target = Path(tempfile.mkdtemp(prefix="plenum-")) / "plenum.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for p in sorted(root.rglob("*.py")):
                archive.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


_shipped: set[str] = set()
