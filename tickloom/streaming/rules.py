"""Training-log rules on a stream: each run's state is kept by Spark and restored from its checkpoint.

The rules are those of ``operators/monitor.py`` (``early_stopping``, ``overfit_flags``, ``health_flags``), epoch by epoch: what
they need of earlier epochs is a few numbers per run, held as one state value keyed by run. A stream that is stopped and
started again from its checkpoint goes on where it was, and gives the rows a batch over the whole log gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG = "run string, epoch long, train_loss double, val_loss double, accuracy double"
FLAGS = f"{LOG}, improved boolean, best double, waited int, stop boolean, overfit boolean, stagnant boolean, diverged boolean, weak boolean"
HELD = "epoch long, best double, waited int, stop boolean, train1 double, train2 double, val1 double, val2 double, first double, top double, top_epoch long"


def known(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


class LogRules(StatefulProcessor):
    """Flags of each epoch as it arrives. Epochs of a run come in order; one that is not above the last seen is a repeat and
    left out, so a sender may send again what it is not sure of."""

    def __init__(self, patience: int = 3, min_delta: float = 0.0, stagnation: int = 5, blowup: float = 2.0, poor: float = 0.35):
        self.patience, self.min_delta, self.stagnation, self.blowup, self.poor = patience, min_delta, stagnation, blowup, poor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", HELD)

    def step(self, held: dict, row: dict) -> dict:
        """The flags of ``row``; ``held`` becomes the state after it."""
        train, val, score, epoch = known(row["train_loss"]), known(row["val_loss"]), known(row["accuracy"]), int(row["epoch"])
        better = val is not None and math.isfinite(val) and (held["best"] is None or val < held["best"] - self.min_delta)
        held["waited"] = 0 if better else held["waited"] + 1
        held["best"] = val if better else held["best"]
        held["stop"] = held["stop"] or held["waited"] >= self.patience
        t2, t1, v2, v1 = held["train2"], held["train1"], held["val2"], held["val1"]
        overfit = None not in (t2, t1, train, v2, v1, val) and t2 >= t1 >= train and v2 <= v1 <= val
        if held["epoch"] is None:
            held["first"] = val
        if score is not None and (held["top"] is None or score > held["top"]):
            held["top"], held["top_epoch"] = score, epoch
        held.update(train2=t1, train1=train, val2=v1, val1=val, epoch=epoch)
        return row | {
            "improved": better, "best": held["best"], "waited": held["waited"], "stop": held["stop"], "overfit": overfit,
            "stagnant": None if held["top_epoch"] is None else epoch - held["top_epoch"] >= self.stagnation,
            "diverged": None if val is None or held["first"] is None else val > self.blowup * held["first"],
            "weak": False if epoch <= 3 else None if score is None else score < self.poor,
        }

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in HELD.split(", ")]
        if self.state.exists():
            held = {name: None if value is None or value != value else value for name, value in zip(names, self.state.get())}
        else:
            held = dict.fromkeys(names) | {"waited": 0, "stop": False}
        log = pd.concat(list(rows)).sort_values("epoch", kind="stable")  # a run's epochs of one micro-batch
        out = []
        for row in log.to_dict("records"):
            if held["epoch"] is None or row["epoch"] > held["epoch"]:
                out.append(self.step(held, row))
        self.state.update(tuple(held[name] for name in names))
        if out:
            yield pd.DataFrame(out, columns=[part.split()[0] for part in FLAGS.split(", ")]).astype({"improved": bool, "stop": bool, "overfit": bool, "stagnant": object, "diverged": object, "weak": object})

    def close(self) -> None:
        pass


def stream_rules(log: DataFrame, **options) -> DataFrame:
    """The columns of ``LOG`` and all flags for each row of a streaming ``log``. Needs the RocksDB state store."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [part.split()[0] for part in LOG.split(", ")]
    return log.select(*columns).groupBy("run").transformWithStateInPandas(LogRules(**options), FLAGS, "append", "None")


def write_rules(log: DataFrame, path: str, checkpoint: str, **options):
    """A query that appends the flags of all that has arrived to ``path`` (Parquet, each micro-batch once) and ends."""
    return stream_rules(log, **options).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
