"""Suspect samples as they arrive: a stateful stream that flags each sample and corrects its neighbours' flags when later ones show them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

#: What both sides of a coherent sample add up to, and the jump of an isolated one.
LEAST_SUM, MOST_SUM, JUMP = 80, 120, 15
STATE = StructType([*(StructField(name, ArrayType(kind)) for name, kind in (("at", LongType()), ("own", DoubleType()), ("other", DoubleType()), ("told", IntegerType()))), StructField("version", LongType())])
OUT = "source string, at timestamp, own double, other double, suspect boolean, version bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def suspect(before: float | None, own: float | None, other: float | None, after: float | None) -> bool:
    """Whether both sides do not add up, or the sample jumps from both its neighbours by over JUMP in opposite directions."""
    if own is not None and other is not None and not LEAST_SUM <= own + other <= MOST_SUM:
        return True
    if None in (before, own, after):
        return False
    up, down = own - before, after - own
    return (up > JUMP and down < -JUMP) or (up < -JUMP and down > JUMP)


class Samples(StatefulProcessor):
    """A source's samples since the watermark, and the last two before it: what a late sample can still change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getValueState("samples", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, own, other, told, version = self._kept.get() if self._kept.exists() else ([], [], [], [], 0)
        known = {a: [x, y, t] for a, x, y, t in zip(at, own, other, told, strict=True)}
        late = timerValues.getCurrentWatermarkInMs() * 1000
        new = pd.concat(list(rows)).sort_values("at", kind="stable")
        for a, x, y in zip(new["at"].astype("datetime64[us]").astype("int64"), new["own"], new["other"], strict=True):
            if a >= late and a not in known:  # the first sample of a time stays
                known[a] = [None if pd.isna(x) else float(x), None if pd.isna(y) else float(y), -1]
        order = sorted(known)
        out = []
        for i, a in enumerate(order):
            x, y, before = known[a]
            flag = suspect(known[order[i - 1]][0] if i else None, x, y, known[order[i + 1]][0] if i + 1 < len(order) else None)
            # The oldest kept sample was flagged when its predecessor was still here.
            if before != int(flag) and not (i == 0 and before >= 0):
                known[a][2] = int(flag)
                version += 1
                out.append((key[0], a, x, y, flag, version))
        old = [a for a in order if a < late]
        kept = old[-2:] + order[len(old) :]
        self._kept.update((kept, *([known[a][k] for a in kept] for k in range(3)), version))
        made = pd.DataFrame(out, columns=["source", "at", "own", "other", "suspect", "version"])
        made["at"] = pd.to_datetime(made["at"], unit="us")
        yield made

    def close(self) -> None:
        pass


def flagged(samples: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of (source, at, own, other, suspect, version) of a stream of samples (source, at, own, other): a row for each new flag and each that a later sample changes.

    Samples may arrive in any order within `late`; what comes later is dropped, as are rows without a source or time.  Needs the RocksDB state store (PROVIDER).
    Of several rows of a source and time the one of the largest version holds: see latest().
    """
    spark = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = samples.where("source is not null and at is not null").select(F.col("source").cast("string").alias("source"), F.col("at").cast("timestamp").alias("at"), F.col("own").cast("double").alias("own"), F.col("other").cast("double").alias("other"))
    rows = rows.withWatermark("at", late)
    return rows.groupBy("source").transformWithStateInPandas(Samples(), outputStructType=StructType.fromDDL(OUT), outputMode="Update", timeMode="EventTime")


def latest(told: DataFrame) -> DataFrame:
    """The standing flags (source, at, own, other, suspect) of what flagged() has told so far."""
    last = told.groupBy("source", "at").agg(F.max_by(F.struct("own", "other", "suspect"), "version").alias("v"))
    return last.select("source", "at", "v.*")
