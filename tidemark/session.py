"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go: the first of these settings that is set. The first can be set at run time.
SCRATCH_CONFS = ("spark.tidemark.scratch", "spark.checkpoint.dir")

_LOCAL: dict[str, str] = {}
_SCOPES: list[str] = []
_ON_DELETE: list[Callable[[str], None]] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and local benchmarks; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Small inputs keep all cores busy; the 1 MB default would fold them into one or two tasks.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, below the configured one.

    Only a session in local mode may go without a setting; it gets a temporary folder. Elsewhere such
    a folder would be a different one on each machine, so this is an error.
    """
    app = spark.sparkContext.applicationId
    for name in SCRATCH_CONFS:
        if root := spark.conf.get(name, None):
            return f"{root.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {' or '.join(SCRATCH_CONFS)} to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidemark-")
    return f"{_LOCAL[app]}/{app}"


def on_delete(act: Callable[[str], None]) -> None:
    """Have ``act(folder)`` called when a scratch folder is deleted, to forget frames that read it."""
    _ON_DELETE.append(act)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for act in _ON_DELETE:
        act(folder)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored; frames built on it can no longer be read."""
    _delete(spark, scratch_root(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Scope of intermediate tables: what is stored inside it is deleted at its end, save what :func:`kept` holds."""
    folder = f"{scratch_root(spark)}/scope-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        _delete(spark, folder)


@contextmanager
def kept() -> Iterator[None]:
    """Tables stored inside outlive any :func:`scratch` scope around it (index tables do)."""
    _SCOPES.append("")
    try:
        yield
    finally:
        _SCOPES.pop()


def new_table(spark: SparkSession) -> str:
    """Path for a new intermediate table in the running scope."""
    return f"{(_SCOPES and _SCOPES[-1]) or scratch_root(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch area and return a scan of it.

    A written table cuts the lineage and survives the loss of executors, and unlike a
    checkpointed RDD it keeps column pruning, predicate pushdown and file statistics. The write runs
    when this is called: operators that need one run it while their plan is built.
    """
    spark = df.sparkSession
    path = new_table(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
