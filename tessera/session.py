"""Session helpers: builder defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """Session for tests and the bench.  On a cluster, pass the session you already have instead."""
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session.  Where nothing is configured, a session on one machine (tests, the
    bench) gets a fresh scratch folder; on a cluster that is an error, as executors would not
    see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once for each application), so that functions
    pickled by reference run whatever the workers' folder or path is."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera_package.zip")  # Spark copies it to the executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)
    sc._tessera_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the frame as parquet under the shared checkpoint folder
    and reading it back.

    Unlike ``DataFrame.checkpoint(eager=True)`` (which runs the plan once to count and again
    to write unless cached) the plan runs exactly once; the files survive executor loss and
    are columnar, so later scans prune columns and push filters.  The shuffles of the plan are
    removed as soon as it has run, the table by ``release`` or never."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.parquet(path)
    table.cut_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing lazy depends on any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_parts(df: DataFrame, part: str, parts) -> list[DataFrame]:
    """As ``cut_lineage``, with one table for each value of the column ``part`` (small whole
    numbers), so that a join sees each table's own size."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-cut-{uuid.uuid4().hex}"
    df.write.partitionBy(part).parquet(path)
    schema = df.drop(part).schema
    held = {r[part] for r in spark.read.schema(df.schema).parquet(path).select(part).distinct().collect()}
    return [spark.read.schema(schema).parquet(f"{path}/{part}={p}") if p in held else spark.createDataFrame([], schema) for p in parts]
