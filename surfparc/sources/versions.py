"""Small tables that several runs may change at once.

Each state of a table is a Parquet folder of its own, and never changes. A log of
numbered files names the folder of each version. A version counts from the moment
its log file is there, and the file system lets only one writer make it, so
readers see whole states, a broken write leaves the last one in force, and of two
writers the later one works on what the earlier one left. (Needs a file system that
makes a file only once, such as HDFS.)
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surfparc.sources import files

# A log file without its closing line end is still being written, or was left by a lost run after so long.
PATIENCE_SECONDS = 10.0
# States before the current one that stay for readers who have begun on them.
KEPT = 3


def _log(project: str, artifact: str) -> str:
    return f"{project}/{artifact}/_log"


def _latest(spark: SparkSession, project: str, artifact: str) -> tuple[int, str | None]:
    """The highest version number taken, and the folder of the highest one that is whole."""
    log, until = _log(project, artifact), time.monotonic() + PATIENCE_SECONDS
    while True:
        numbers = [n for n in files.names(spark, log) if n.isdigit()]
        whole = None
        for n in reversed(numbers):
            text = files.read_text(spark, f"{log}/{n}")
            if text.endswith("\n"):
                whole = n, text.strip()
                break
        if not numbers or (whole and whole[0] == numbers[-1]) or time.monotonic() > until:
            return int(numbers[-1]) if numbers else 0, f"{project}/{artifact}/{whole[1]}" if whole else None
        time.sleep(0.2)


def current(spark: SparkSession, project: str, artifact: str) -> str:
    """Folder of the state in force."""
    folder = _latest(spark, project, artifact)[1]
    if folder is None:
        raise FileNotFoundError(f"{project} has no {artifact}")
    return folder


def commit(spark: SparkSession, project: str, artifact: str, change: Callable[[DataFrame | None], DataFrame]) -> int:
    """Put ``change(state in force, or None)`` in force; returns its version.

    If another run commits first, the change is applied anew to what that run left.
    """
    while True:
        taken, folder = _latest(spark, project, artifact)
        old = None if folder is None else spark.read.parquet(folder)
        name = f"state-{uuid.uuid4().hex}"
        change(old).write.parquet(f"{project}/{artifact}/{name}")
        if files.create(spark, f"{_log(project, artifact)}/{taken + 1:012d}", name + "\n"):
            _drop_old(spark, project, artifact)
            return taken + 1
        files.delete(spark, f"{project}/{artifact}/{name}")


def _drop_old(spark: SparkSession, project: str, artifact: str) -> None:
    """Delete states further back than ``KEPT``; log files first, so that a state the log names is there."""
    log = _log(project, artifact)
    for n in [n for n in files.names(spark, log) if n.isdigit()][: -KEPT - 1]:
        name = files.read_text(spark, f"{log}/{n}").strip()
        files.delete(spark, f"{log}/{n}")
        if name:
            files.delete(spark, f"{project}/{artifact}/{name}")
