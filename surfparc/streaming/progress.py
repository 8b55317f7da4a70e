"""Progress events: an append-only log the driver writes and anyone may follow."""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EVENTS = "type string, ts double, step string, sub_id string, state string, error string, iter_inter int, iter_intra int, entries array<struct<step: string, sub_id: string>>"
COHORT = "cohort"


def plan_entries(subjects: list[str], train: bool) -> list[dict[str, str]]:
    """Every slot a run goes through, in order."""
    each = lambda step: [{"step": step, "sub_id": str(s)} for s in subjects]
    shared = ["step1_avg", "step1_ini", "step1_mask"] + (["step2"] if train else [])
    return each("step0") + each("step1") + [{"step": s, "sub_id": COHORT} for s in shared] + each("step3")


class Progress:
    """Writes one JSON line per event. A plan starts the log over; failures never reach the run."""

    def __init__(self, path: str | None):
        self.path, self.warned = path, False

    def _emit(self, mode: str, **event) -> None:
        if self.path is None:
            return
        try:
            with open(self.path, mode, encoding="utf-8") as f:
                f.write(json.dumps({**event, "ts": time.time()}) + "\n")
        except OSError as e:
            if not self.warned:
                print(f"progress log unavailable: {e}", file=sys.stderr)
            self.warned = True

    def plan(self, entries: list[dict[str, str]]) -> None:
        self._emit("w", type="plan", entries=entries)

    def state(self, step: str, sub_id: str, state: str, error: str | None = None) -> None:
        self._emit("a", type="state", step=step, sub_id=str(sub_id), state=state, error=error)

    def iteration(self, step: str, iter_inter: int, iter_intra: int | None = None) -> None:
        self._emit("a", type="iter", step=step, iter_inter=iter_inter, iter_intra=iter_intra)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)


def latest_states(events: DataFrame) -> DataFrame:
    """Last state of every planned slot; slots without an event are pending."""
    slots = events.filter("type = 'plan'").select(F.explode("entries").alias("_e")).select("_e.step", "_e.sub_id")
    order = W.partitionBy("step", "sub_id").orderBy(F.desc("ts"))
    last = events.filter("type = 'state'").withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("step", "sub_id", "state")
    return slots.join(last, ["step", "sub_id"], "left").withColumn("state", F.coalesce("state", F.lit("pending")))
