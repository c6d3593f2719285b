"""Session helpers: a local session for tests and benchmarks, and the shared
folder used to cut lineage (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry; they are safe on a cluster too.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "seqflip") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The folder comes from ``spark.checkpoint.dir`` (or one already set on the
    context).  Only where the session names none - local runs and tests - a
    fresh scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative searches")
        configured = tempfile.mkdtemp(prefix="seqflip-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder, owned by the open :class:`Scope` if there is one."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.paths.append(path)
    return path


#: Without it shuffle files stay on the executors' disks until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries that run while it is open delete their shuffle files when they end.  Meant for the write of a table that is
    read back: nothing asks for its shuffles again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


_SCOPE: ContextVar[Scope | None] = ContextVar("seqflip_scope", default=None)


class Scope:
    """Owns the scratch folders and persisted tables that operators make while it is open.

    Results are lazy and read scratch tables, so nothing can be deleted when an operator returns; it can when the result
    is stored.  ``with Scope(spark):`` around building *and* storing a result releases all of it at the end, also after an
    error.  Scopes nest: an inner one owns what is made inside it.  Without a scope the folders stay until the
    checkpoint folder itself is removed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scope:
        self._token = _SCOPE.set(self)
        return self

    def __exit__(self, *error) -> None:
        _SCOPE.reset(self._token)
        self.release()

    def release(self) -> None:
        for table in self.tables:
            table.unpersist()
        for path in self.paths:
            remove_path(self.spark, path)
        self.tables, self.paths = [], []


def persisted(df: DataFrame) -> DataFrame:
    """Persist a table; the open :class:`Scope` releases it, or the caller does with ``unpersist``."""
    df = df.persist()
    scope = _SCOPE.get()
    if scope is not None:
        scope.tables.append(df)
    return df


def store_result(spark: SparkSession, build, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> DataFrame:
    """Build a result, write it to ``path``, release everything it was made from, and read it back."""
    with Scope(spark):
        df = build()
        schema = df.schema
        with shuffles_released(spark):
            df.write.mode(mode).format(fmt).save(path)
    return spark.read.schema(schema).format(fmt).load(path)
