"""Session and shared-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster, use the one that is there."""
    conf = {"spark.python.sql.dataFrameDebugging.enabled": "false", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"}
    return SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows, by the usual width of their types, that one task sorts and groups.
TASK_BYTES = 24 << 20


def tasks_for(df: DataFrame) -> int:
    """How many tasks df's rows are dealt to, so that what a task sorts and groups doesn't grow with the table: one for each TASK_BYTES,
    but no fewer than cores; 1 for a table that is no larger. Rows are counted (Parquet tells from its footers), as the bytes of files
    depend on their encoding."""
    n = -(-df.count() * df._jdf.schema().defaultSize() // TASK_BYTES)
    return max(n, df.sparkSession.sparkContext.defaultParallelism) if n > 1 else 1


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """df in n partitions by a key, whatever spark.sql.shuffle.partitions is: a number given here isn't merged by adaptive execution.
    Tables dealt alike are joined and grouped by that key without another shuffle. Where n is 1, df is left to adaptive execution."""
    return df.repartition(n, key) if n > 1 else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local one is set in local mode, and elsewhere it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/mdloom/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they need no path of the driver's."""
    context = spark.sparkContext
    if getattr(context, "_mdloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="mdloom-")) / "mdloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._mdloom_shipped = True
