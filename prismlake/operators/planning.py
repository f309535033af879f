"""What an indexing pass has to do."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prismlake.schemas import FACE_MODEL, TEXT_MODEL
from prismlake.sources.tables import scratch


def _differs(name: str) -> Column:
    """As values: a photo without a stored row differs."""
    return ~F.col(name).eqNullSafe(F.col(f"_{name}"))


def _with_state(current: DataFrame, stored: DataFrame) -> DataFrame:
    state = stored.select("mediaId", *(F.col(c).alias(f"_{c}") for c in ("dateModified", "embeddingDimension", "modelVersion") if c in stored.columns), F.lit(True).alias("_known"))
    return current.join(state, "mediaId", "left")


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Every photo with its work: new, changed, pending (no vector yet) or unchanged. One join for all."""
    rows = _with_state(current, stored)
    work = (
        F.when(F.col("_known").isNull(), "new").when(_differs("dateModified"), "changed")
        .when(F.col("_embeddingDimension") == 0, "pending").otherwise("unchanged")
    )
    return rows.select(*current.columns, work.alias("work"))


def whole_plan(current: DataFrame, stored: DataFrame, face_index: DataFrame, photo_text: DataFrame, face_model: str = FACE_MODEL, text_model: str = TEXT_MODEL) -> DataFrame:
    """R1, J1, J4-J6, P15 in one pass over co-located tables (``sources.colocated``), without an exchange.

    A row for each photo of the library or the store: work (new, changed, pending, unchanged or deleted), whether its face
    and text rows are valid, and whether they must be made; those of deleted photos need nothing.
    """

    def columns(df: DataFrame, prefix: str, *names: str) -> DataFrame:
        return df.select(F.col("mediaId").alias(f"{prefix}Id"), *(F.col(n).alias(f"{prefix}_{n}") for n in names))

    now, known = columns(current, "now", "dateModified"), columns(stored, "stored", "dateModified", "embeddingDimension")
    faces, texts = (columns(df, prefix, "dateModified", "modelVersion") for df, prefix in ((face_index, "face"), (photo_text, "text")))
    rows = now
    for side, prefix, how in ((faces, "face", "left"), (texts, "text", "left"), (known, "stored", "full")):
        rows = rows.join(side.hint("merge"), F.col("nowId") == F.col(f"{prefix}Id"), how)
    work = (
        F.when(F.col("nowId").isNull(), "deleted").when(F.col("storedId").isNull(), "new").when(~F.col("stored_dateModified").eqNullSafe(F.col("now_dateModified")), "changed")
        .when(F.col("stored_embeddingDimension") == 0, "pending").otherwise("unchanged")
    )
    there = F.col("nowId").isNotNull()

    def valid(prefix: str, model: str):
        return there & F.coalesce((F.col(f"{prefix}_dateModified") == F.col("now_dateModified")) & (F.col(f"{prefix}_modelVersion") == model), F.lit(False))

    face, text = valid("face", face_model), valid("text", text_model)
    return rows.select(
        F.coalesce("nowId", "storedId").alias("mediaId"), work.alias("work"), face.alias("faceValid"), text.alias("textValid"), (there & ~face).alias("facePending"), (there & ~text).alias("textPending")
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    """The numbers of a ``whole_plan``; only sums of each task move."""
    counted = {"total": F.col("work") != "deleted", **{w: F.col("work") == w for w in ("new", "changed", "pending", "deleted")}, "facesValid": F.col("faceValid"), "textsValid": F.col("textValid")}
    return plan.agg(*(F.count_if(c).alias(n) for n, c in counted.items()))


def to_embed(current: DataFrame, stored: DataFrame) -> DataFrame:
    return classify(current, stored).where("work <> 'unchanged'").drop("work")


def deleted(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids that the library no longer has. R6: the library must have been read; a failed read raises before."""
    return stored.join(current.select("mediaId"), "mediaId", "left_anti").select("mediaId")


def derived_pending(current: DataFrame, stored: DataFrame, model: str, changed: DataFrame | None = None) -> DataFrame:
    """Photos whose derived rows are missing, of another revision or of another model, or that are in ``changed``."""
    rows = _with_state(current, stored)
    pending = _differs("dateModified") | ~F.col("_modelVersion").eqNullSafe(F.lit(model))
    if changed is not None:
        rows = rows.join(changed.select("mediaId", F.lit(True).alias("_changed")), "mediaId", "left")
        pending = pending | F.col("_changed").isNotNull()
    return rows.where(pending).select(*current.columns)


def face_pending(current: DataFrame, stored: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    return derived_pending(current, stored, FACE_MODEL, changed)


def text_pending(current: DataFrame, stored: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    return derived_pending(current, stored, TEXT_MODEL, changed)


def visual_pass(current: DataFrame, semantic: DataFrame, faces: DataFrame) -> DataFrame:
    """Photos of either set, once."""
    ids = semantic.select("mediaId").union(faces.select("mediaId"))
    return current.join(ids, "mediaId", "left_semi")


def snapshot_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(mediaId, dateModified, side) of rows in one snapshot only; none means that no further pass is needed."""
    a, b = (x.select("mediaId", "dateModified") for x in (before, after))
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def snapshot_digests(snapshot: DataFrame, buckets: int) -> DataFrame:
    """For each bucket of photos the number of its rows and sums of four 32-bit parts of their hashes, which don't depend on
    their order; sums of each task are all that is shuffled."""
    hashes = [F.xxhash64(F.lit(seed), "mediaId", "dateModified") for seed in (1, 2)]
    parts = [F.shiftrightunsigned(h, shift).bitwiseAND(0xFFFFFFFF) for h in hashes for shift in (0, 32)]
    rows = snapshot.select(F.pmod(F.xxhash64("mediaId"), F.lit(buckets)).alias("bucket"), *(p.alias(f"h{i}") for i, p in enumerate(parts)))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(f"h{i}").alias(f"h{i}") for i in range(len(parts))))


def differing_buckets(before: DataFrame, after: DataFrame, buckets: int = 1024) -> list[int]:
    """The buckets in which two snapshots differ, at most ``buckets`` numbers; none if they are equal."""
    a, b = (snapshot_digests(x, buckets) for x in (before, after))
    return sorted(r["bucket"] for r in a.exceptAll(b).union(b.exceptAll(a)).select("bucket").distinct().collect())


def snapshot_changes(before: DataFrame, after: DataFrame, buckets: int = 1024) -> DataFrame:
    """``snapshot_difference``, sought only in buckets that differ: rows of the others are read and not shuffled."""
    some = differing_buckets(before, after, buckets)
    inside = F.pmod(F.xxhash64("mediaId"), F.lit(buckets)).isin(some) if some else F.lit(False)
    return snapshot_difference(before.where(inside), after.where(inside))


def split_errors(processed: DataFrame, result: str = "result") -> tuple[DataFrame, DataFrame]:
    """Good rows with their value, and bad ones with their error; bad ones stay pending."""
    good = processed.where(F.col(f"{result}.error").isNull()).withColumn("value", F.col(f"{result}.value")).drop(result)
    bad = processed.where(F.col(f"{result}.error").isNotNull()).withColumn("error", F.col(f"{result}.error")).drop(result)
    return good, bad


@dataclass(frozen=True)
class Stage:
    """A stage has its own pending rule and state, so each resumes by itself and none waits for another's success."""

    name: str
    pending: Callable[[DataFrame], DataFrame]
    process: Callable[[DataFrame], DataFrame]  # adds `result`: struct<value, error>
    counts_failures: bool  # R10: whether failures count as processed


PROGRESS = "step long, id int, name string, processed long, total long, failed long, status string, error string"


def progress_table(spark: SparkSession, path: str) -> Callable[[dict], None]:
    """A report that appends each row to a table, so that others can watch a pass while it runs."""
    steps = itertools.count()

    def report(row: dict) -> None:
        row = {"step": next(steps), **row}
        spark.createDataFrame([tuple(row[c.split(" ")[0]] for c in PROGRESS.split(", "))], PROGRESS).coalesce(1).write.mode("append").parquet(path)

    return report


def run_stages(current: DataFrame, stages: list[Stage], folder: str | None = None, report: Callable[[dict], None] | None = None, chunks: int = 1) -> tuple[dict[str, DataFrame], list[dict]]:
    """Each stage's good rows, and its last progress row; an unavailable model ends only its own stage.

    A stage's pending rows are dealt into ``chunks`` by photo and written once; each chunk is then read, processed and written
    once, to ``folder`` (a shared one). Its numbers are observed while it is written, so nothing is counted apart. ``report``
    gets every stage's QUEUED row, a RUNNING row when a stage begins and after each chunk, and the last row.
    """
    spark = current.sparkSession
    folder = folder or scratch(spark)
    total, good, last = current.count(), {}, []
    report = report or (lambda row: None)
    for i, stage in enumerate(stages, 1):
        report({"id": i, "name": stage.name, "processed": 0, "total": total, "failed": 0, "status": "QUEUED", "error": None})
    for i, stage in enumerate(stages, 1):
        pending, seen = stage.pending(current), Observation()
        dealt = pending.withColumn("_chunk", F.pmod(F.xxhash64("mediaId"), F.lit(chunks)).cast("int"))
        dealt.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("_chunk").parquet(f"{folder}/{stage.name}/pending")
        n = seen.get["n"]
        row = {"id": i, "name": stage.name, "processed": total - n, "total": total, "failed": 0, "status": "RUNNING", "error": None}
        report(dict(row))
        schema = None
        try:
            for chunk in range(chunks if n else 0):
                rows = spark.read.schema(dealt.schema).parquet(f"{folder}/{stage.name}/pending").where(F.col("_chunk") == chunk).drop("_chunk")
                made, seen = stage.process(rows), Observation()
                numbers = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("result.error").isNotNull()).alias("failed")]
                made.observe(seen, *numbers).write.mode("overwrite").parquet(f"{folder}/{stage.name}/done/chunk={chunk}")
                schema, failed = made.schema, seen.get["failed"]
                row["failed"] += failed
                row["processed"] += seen.get["n"] if stage.counts_failures else seen.get["n"] - failed
                report(dict(row))
            row["status"] = "INTERRUPTED" if row["failed"] else "COMPLETE"
            if schema is None:  # nothing was pending
                schema = stage.process(pending.where("false")).schema
        except RuntimeError as unavailable:
            row |= {"status": "UNAVAILABLE", "error": str(unavailable)}
        else:
            paths = [f"{folder}/{stage.name}/done/chunk={chunk}" for chunk in range(chunks if n else 0)]
            good[stage.name] = split_errors(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))[0]
        report(dict(row))
        last.append(row)
    return good, last


def overall_progress(indexed: Column, faces: Column) -> Column:
    """A14."""
    return F.least(indexed, faces)
