"""Session helpers shared by every operator: tables, cut lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the plain shuffled join is used.
BROADCAST_ROWS = 200_000
#: Bytes up to which it may.
BROADCAST_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that Python workers can import it wherever they run."""
    if getattr(spark, "_quire_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quirespark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = os.path.dirname(os.path.abspath(__file__))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/quirespark", "zip", os.path.dirname(root), os.path.basename(root)))
    spark._quire_shipped = True


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the master is local is a temporary folder made,
    as in tests; a cluster without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    made = getattr(spark, "_quire_tmp", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        made = tempfile.mkdtemp(prefix="quirespark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark._quire_tmp = made
    return f"file://{made}"


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Cut the lineage of ``df``: write it once to the shared folder and read it back.

    The table survives the loss of an executor. It is removed by :func:`release` or when the application ends, on
    whatever file system the folder is.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex}"
    if partitions:
        df = df.repartition(partitions)
    _delete_at_end(spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    except Exception:  # noqa: BLE001 - a file that stays is no reason to fail
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Removes the table with the session: when it stops, or else when Python ends, before the JVM is gone."""
    context = spark.sparkContext
    paths = getattr(context, "_quire_paths", None)
    if paths is None:
        paths = context._quire_paths = set()
        stop = context.stop

        def clear_and_stop() -> None:
            while paths:
                _delete(spark, paths.pop())
            stop()

        context.stop = clear_and_stop
        atexit.register(lambda: [_delete(spark, paths.pop()) for _ in range(len(paths))])
    paths.add(path)


def release(*tables: DataFrame) -> None:
    """Removes tables of :func:`written` that nothing will read any more."""
    for df in tables:
        path = getattr(df, "_quire_path", None)
        if path:
            getattr(df.sparkSession.sparkContext, "_quire_paths", set()).discard(path)
            _delete(df.sparkSession, path)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if at most ``rows`` rows of at most ``size`` bytes (as text) are counted; otherwise ``df`` itself,
    so that the join shuffles. ``df`` should be cheap to count (a written table)."""
    width = F.length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
