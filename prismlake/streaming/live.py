"""Live counts that take back (R8, A1-A3, J1, J4): photos, and those with valid faces and texts, as changes come in any order.

Changes of photos, face scans and texts come as one stream of rows (``changes_of``). Keyed state holds each photo's newest
revision, or that it is gone, and the newest revision and model of its derived rows; of one revision a deletion wins, and
the greater model. So the state doesn't depend on the order of arrival, and late rows change nothing.

A photo counts in ``photos`` while it is there, in ``faces`` and ``texts`` while its derived row has its revision and the valid
model. When a change makes that untrue, a row of -1 goes out. ``counted`` adds the rows of each batch to the totals of the
batch before, in a folder of its own, so a batch that runs again writes the same totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from prismlake.schemas import FACE_MODEL, TEXT_MODEL

KINDS = ("photos", "faces", "texts")
CHANGES = "mediaId long, kind string, dateModified long, modelVersion string, gone boolean"
#: For each kind the newest revision and its model; for photos ``gone`` in place of the model.
STATE = T.StructType([T.StructField(f"{kind}{what}", t, True) for kind in KINDS for what, t in (("Revision", T.LongType()), ("Model", T.StringType()))])


def changes_of(kind: str, rows: DataFrame) -> DataFrame:
    """Rows of a feed of photos (with ``gone``, if there are deletions), faces or texts as changes."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of change {kind}")
    column = lambda name, t: (F.col(name) if name in rows.columns else F.lit(None)).cast(t).alias(name)
    return rows.select(F.col("mediaId").cast("long"), F.lit(kind).alias("kind"), F.col("dateModified").cast("long"), column("modelVersion", "string"), F.coalesce(column("gone", "boolean"), F.lit(False)).alias("gone"))


def newer(one: tuple, other: tuple) -> bool:
    """Whether (revision, model) comes after another; nothing comes before everything."""
    rank = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    return rank(one) > rank(other)


def standing(state: dict[str, tuple], models: dict[str, str]) -> dict[str, int]:
    """In which counts a photo is."""
    revision, gone = state["photos"]
    there = revision is not None and not gone
    return {"photos": int(there)} | {k: int(there and state[k] == (revision, models[k])) for k in models}


class Validity(StatefulProcessor):
    def __init__(self, models: dict[str, str]):
        self.models = models

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("photo", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.kept.get() if self.kept.exists() else (None,) * len(STATE)
        state = {kind: (held[2 * i], held[2 * i + 1]) for i, kind in enumerate(KINDS)}
        before = standing(state, self.models)
        for batch in rows:
            for kind, revision, model, gone in zip(batch["kind"], batch["dateModified"], batch["modelVersion"], batch["gone"], strict=True):
                if pd.isna(revision):
                    continue
                change = (int(revision), ("gone" if gone else None) if kind == "photos" else model)
                if newer(change, state[kind]):
                    state[kind] = change
        self.kept.update(tuple(x for kind in KINDS for x in state[kind]))
        after = standing(state, self.models)
        names = [n for n in before if after[n] != before[n]]
        if names:
            yield pd.DataFrame({"name": names, "change": [after[n] - before[n] for n in names]})

    def close(self) -> None:
        pass


def retracting(changes: DataFrame, face_model: str = FACE_MODEL, text_model: str = TEXT_MODEL) -> DataFrame:
    """name and change (1 or -1), for each photo that enters or leaves a count in a batch."""
    # keyed state of several values needs this provider
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = changes.where("mediaId is not null").groupBy("mediaId")
    return keyed.transformWithStateInPandas(Validity({"faces": face_model, "texts": text_model}), "name string, change long", "Update", "None")


def counted(changes: DataFrame, folder: str, face_model: str = FACE_MODEL, text_model: str = TEXT_MODEL) -> StreamingQuery:
    """Keeps the totals after each batch in ``folder``."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("name", F.col("change").alias("n"))
        if number:
            rows = rows.unionByName(totals(spark, folder, number - 1))
        rows.groupBy("name").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals/{number}")

    return retracting(changes, face_model, text_model).writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def totals(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """name and n after a batch."""
    return spark.read.schema("name string, n long").parquet(f"{folder}/totals/{batch}")


def batch_counts(changes: DataFrame, face_model: str = FACE_MODEL, text_model: str = TEXT_MODEL) -> DataFrame:
    """The same totals from all changes at once: newest rows of each kind, joined."""
    state = F.struct("dateModified", F.when(F.col("kind") == "photos", F.when(F.col("gone"), "gone").otherwise("")).otherwise(F.coalesce("modelVersion", F.lit(""))).alias("model"))
    newest = changes.where("mediaId is not null and dateModified is not null").groupBy("mediaId").agg(*(F.max(F.when(F.col("kind") == k, state)).alias(k) for k in KINDS))
    there = F.col("photos").isNotNull() & (F.col("photos.model") == "")

    def valid(kind: str, model: str):
        return there & (F.col(f"{kind}.dateModified") == F.col("photos.dateModified")) & (F.col(f"{kind}.model") == model)

    counts = newest.agg(F.count_if(there).alias("photos"), F.count_if(valid("faces", face_model)).alias("faces"), F.count_if(valid("texts", text_model)).alias("texts"))
    return counts.unpivot([], list(KINDS), "name", "n")
