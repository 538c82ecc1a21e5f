"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tableward", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the checks rely on.

    Adaptive execution turns hot shuffle partitions into several tasks and small build sides
    into broadcasts once their real size is known, so neither is hand-scheduled here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def undefined_as_null(spark: SparkSession) -> Iterator[None]:
    """What is analysed inside gives null where a row has no value: a division by zero, text that is
    no number, an element that is not there.  Outside, one such row would end the job.

    Only analysis depends on it: a DataFrame made inside keeps this reading wherever it runs.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def work_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and temporary tables: the session's ``spark.checkpoint.dir``.

    Only a session on one machine may do without: it gets a folder of this process, removed when
    the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tableward-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the work folder, so that later plans see
    fixed partitions and a lost executor costs no recomputation of what lies before."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)
