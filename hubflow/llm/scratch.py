"""Tables written between the steps of a job, in the folder that all executors share."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a session in one process gets a new folder; on a cluster, whose machines share none by themselves, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under shared_dir and read it back: a later failure restarts from the files, not from the input. What wasn't released before goes at the end of the application."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables that written gave, once nothing that is still to run reads them."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(next((p for p in _written if path.endswith(p)), ""))


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001, the application's JVM has gone: its folder is all there is left to remove
            return
