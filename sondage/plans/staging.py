"""Cutting lineage and ordering rows at scale.

Everything here survives the loss of an executor: intermediate tables are
written as Parquet below the shared folder named in ``spark.checkpoint.dir``
(read from the session; a local folder is only chosen where it is unset, as in
tests), and sorted row numbers are only used after such a write.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``; a local one of our own only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _DIR:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = named or tempfile.mkdtemp(prefix="sondage-")
        if "://" not in base and not base.startswith("file:"):
            base = "file://" + base if base.startswith("/") and not named else base
        _DIR[app] = f"{base.rstrip('/')}/sondage-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _DIR[app])
    return _DIR[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a cut in the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_map(
    df: DataFrame,
    order: Sequence[str],
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: StructType | str,
    partition_on: Sequence[str] | None = None,
) -> DataFrame:
    """Range-sort ``df`` by ``order`` and run ``fn`` over each sorted partition.

    Rows that agree in ``partition_on`` (default: all of ``order``) meet in one
    partition. A hot leading key is split over many partitions, because the
    ranges are cut through all the given columns.
    """
    on = list(partition_on or order)
    ranged = df.repartitionByRange(*[F.col(c) for c in on]).sortWithinPartitions(*order)
    return ranged.mapInArrow(fn, schema)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, wherever they run; once per application."""
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():
        name = str(Path(tempfile.mkdtemp(prefix="sondage-code-")) / package.name)
        archive = shutil.make_archive(name, "zip", root_dir=package.parent, base_dir=package.name)
        spark.sparkContext.addPyFile(archive)  # the driver serves it to the executors
