"""Sessions, table reading, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings this library assumes: UTC, AQE, Arrow."""
    b = SparkSession.builder.master(master).appName("matchloom")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this package importable by the executors' Python workers, once per context, and turns an unsound optimisation off.

    With it, the exchange over a union is left out where all sides are dealt by the same key, although adaptive
    execution may have merged the partitions of the sides differently; rows of one key then miss each other.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if getattr(sc, "_matchloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="matchloom-")) / "matchloom_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    sc.addPyFile(str(path))
    sc._matchloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
