"""Session defaults, lineage cutting and the lifetime of what it writes."""

import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here counts on. The skew join must also split a
# hot partition when a grouped step above it then needs one more exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trackloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in RUNTIME_CONF.items():
        builder = builder.config(name, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session that names
    none (a test) gets a temporary folder, which it then keeps."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    folder = named or spark.conf.get("trackloom.checkpoint.dir", None)
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("trackloom.checkpoint.dir", folder)
    return folder


def allow_checkpoints(spark: SparkSession) -> None:
    """Spark ML cuts the lineage of long fits only where a checkpoint folder is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


class Scope:
    """The tables that ``cut_lineage`` writes while the scope is the innermost one.

    They go when it ends, however it ends, but for those that were handed on with
    ``keep``: these then belong to the scope around it, if there is one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that outlives the scope."""
        path = _new_path(self.spark)
        df.write.parquet(path)
        outer = self._outer
        if outer is not None:
            outer.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scope that nothing will read again."""
        files = {f for t in tables for f in t.inputFiles()}
        gone = [p for p in self.paths if any(_below(f, p) for f in files)]
        self._delete(gone)
        self.paths = [p for p in self.paths if p not in gone]

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    def __enter__(self):
        self._outer = _scope.get()
        self._token = _scope.set(self)
        return self

    def __exit__(self, *_):
        _scope.reset(self._token)
        self._delete(self.paths)


_scope: contextvars.ContextVar = contextvars.ContextVar("trackloom_scope", default=None)


def _below(file: str, folder: str) -> bool:
    return folder.rsplit("/", 1)[1] in file.split("/")


def _new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def result_of(spark: SparkSession, build) -> DataFrame:
    """``build()`` as one written table; every table written on the way is deleted."""
    with Scope(spark) as scope:
        return scope.keep(build())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps then start from files that outlive any executor, read only the
    columns they use, and know the table's size when they pick a join.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    scope = _scope.get()
    if scope is not None:
        scope.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
