"""Sessions set up as the operators expect them."""

import atexit
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "hubflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides or adds settings (dots as underscores are not translated)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Folders that cut_lineage wrote and nobody has released, by application.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a session in one process gets a new folder; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """df written in shared_dir and read again. release removes it; what nobody released goes at the end of the application."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables that cut_lineage gave, once nothing that is still to run reads them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(next((p for p in _written if folder.endswith(p.split(":", 1)[-1].lstrip("/"))), ""))


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
        except Exception:  # noqa: BLE001, the application's JVM has gone, and with it the way to the folder
            print(f"left behind: {path}", file=sys.stderr)
