"""Progress of a pass while it runs."""

from pyspark.sql import functions as F

from prismlake.operators import planning


def processed(p):
    return p.withColumn("result", F.struct(F.lit("v").alias("value"), F.when(F.col("mediaId") % 4 == 0, "bad").alias("error")))


def stage(name, pending=lambda c: c, process=processed, counts=True):
    return planning.Stage(name, pending, process, counts)


def library(spark, n=40):
    return spark.range(n).select(F.col("id").alias("mediaId"), F.lit(1).alias("dateModified"))


def test_rows_of_a_run_come_in_order(spark, tmp_path):
    def missing(_):
        raise RuntimeError("no model")

    path = str(tmp_path / "progress")
    stages = [stage("visual"), stage("faces", process=missing), stage("text", pending=lambda c: c.where("mediaId >= 10"), counts=False), stage("none", pending=lambda c: c.where("false"))]
    good, last = planning.run_stages(library(spark), stages, str(tmp_path / "run"), planning.progress_table(spark, path), chunks=3)
    rows = spark.read.parquet(path).orderBy("step").collect()
    assert [(r.id, r.status) for r in rows[:4]] == [(i, "QUEUED") for i in (1, 2, 3, 4)] and [r.step for r in rows] == list(range(len(rows)))
    by_stage = {i: [(r.processed, r.failed, r.status) for r in rows[4:] if r.id == i] for i in (1, 2, 3, 4)}
    visual = by_stage[1]
    assert [s for *_, s in visual] == ["RUNNING"] * 4 + ["INTERRUPTED"]
    assert [p for p, *_ in visual] == sorted(p for p, *_ in visual) and visual[0][:2] == (0, 0) and visual[-1][:2] == (40, 10)
    assert by_stage[2] == [(0, 0, "RUNNING"), (0, 0, "UNAVAILABLE")] and rows[-3].error is None
    assert by_stage[3][0] == (10, 0, "RUNNING") and by_stage[3][-1] == (10 + 30 - 7, 7, "INTERRUPTED")
    assert by_stage[4] == [(40, 0, "RUNNING"), (40, 0, "COMPLETE")]
    assert [(p["processed"], p["status"]) for p in last] == [(40, "INTERRUPTED"), (0, "UNAVAILABLE"), (33, "INTERRUPTED"), (40, "COMPLETE")]
    assert good["visual"].count() == 30 and good["text"].count() == 23 and good["none"].count() == 0 and "faces" not in good


def test_each_stage_reads_its_rows_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def work(p):
        def one(i):
            read.add(1)
            return i

        return p.withColumn("result", F.struct(F.udf(one, "long")("mediaId").alias("value"), F.lit(None).cast("string").alias("error")))

    _, last = planning.run_stages(library(spark), [stage("visual", process=work)], str(tmp_path / "run"), chunks=2)
    assert read.value == 40 and last[0]["status"] == "COMPLETE" and last[0]["processed"] == 40
