"""Tables written to the folder that driver and executors share, to cut lineage and to reuse a result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session, as in tests, may do without: one is made then."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = tempfile.mkdtemp(prefix="notelattice-")
    return "file://" + _FOLDERS[app]


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder, and read from there: its partitions outlive lost executors.

    The table stays until `free` or the end of the driver's JVM, since later plans may read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)  # when the driver ends
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables have been written so far: what `free` starts from."""
    return len(_WRITTEN)


def free(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Deletes the tables written since then, but for the one that keep reads: nothing that is still to run may need them."""
    kept = [f.rsplit("/", 2)[-2] for f in keep.inputFiles()[:1]] if keep is not None else []
    left = [p for p in _WRITTEN[since:] if p.rsplit("/", 1)[-1] in kept]
    for path in _WRITTEN[since:]:
        if path not in left:
            place, files = _place(spark, path)
            files.delete(place, True)
    _WRITTEN[since:] = left


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
