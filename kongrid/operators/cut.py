"""Cutting lineage with a written table in the shared folder the session names."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local session without it."""
    global _local_dir
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    _local_dir = _local_dir or tempfile.mkdtemp(prefix="kongrid-")
    return _local_dir


_LIMIT, _NONE = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)


def _in_python(df: DataFrame, first: int = 0) -> bool:
    """Whether a step of the plan runs in Python, from line `first` of its tree on."""
    steps = df._jdf.queryExecution().optimizedPlan().toString().split("\n")[first:]
    return any(word in step for step in steps for word in ("InArrow", "InPandas", "ArrowEval", "BatchEval", "PythonUDF"))


@contextmanager
def narrow_rows(df: DataFrame):
    """While `df` runs, rows handed to Python are counted and not weighed: Spark takes the weight of a batch anew at every row, which
    costs several times what handing over a narrow row does. Only for plans that make their rows without Python, as those that
    do may hand over wide ones; batches stay within their number of rows."""
    conf = df.sparkSession.conf
    # the plan's own step into Python is the first line of the tree
    if _in_python(df, 1):
        yield
        return
    before = conf.get(_LIMIT)
    conf.set(_LIMIT, _NONE)
    try:
        yield
    finally:
        conf.set(_LIMIT, before)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back: no recomputation, safe when executors are lost, and of known size."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kongrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote and that nothing reads any more, and let Spark remove the shuffle files of finished steps.

    Spark frees shuffle files once the driver's garbage collector has dropped their plans, so it is asked to run.
    """
    for table in tables:
        spark = table.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """`df`, written if it is made in Python: what is read more than once is not made more than once."""
    return cut(df) if _in_python(df) else df
