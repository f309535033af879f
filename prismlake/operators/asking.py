"""Many typed queries at once: whom they mention, and whether that can be searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import text
from prismlake.schemas import FACE_MODEL


def asked_people(asked: DataFrame, people: DataFrame, model: str = FACE_MODEL) -> DataFrame:
    """``asked`` (id, query) with ``people``, the vectors of the mentioned persons in their order, and ``error``.

    A query with a handle that nobody has, or else with a person whose vector is of another model, has an error that names
    them and no vectors. A join by handle of all mentions of all queries; what is grouped again are the mentions of one query.
    """
    mentioned = asked.select("id", F.posexplode(text.mentions(F.col("query"))).alias("place", "handle"))
    known = people.select("handle", F.col("embedding").alias("vector"), F.col("embeddingModel").alias("_model"), F.lit(True).alias("_known"))
    rows = mentioned.join(known, "handle", "left").withColumns({"_unknown": F.col("_known").isNull(), "_old": ~F.col("_model").eqNullSafe(F.lit(model))})

    def names(which: str):
        found = F.sort_array(F.collect_list(F.when(F.col(which), F.struct("place", F.concat(F.lit("@"), F.col("handle")).alias("name")))))
        return F.array_join(F.transform(found, lambda x: x["name"]), ", ").alias(which)

    vectors = F.transform(F.sort_array(F.collect_list(F.struct("place", "vector"))), lambda x: x["vector"]).alias("people")
    answers = rows.groupBy("id").agg(names("_unknown"), names("_old"), vectors)
    error = F.when(F.col("_unknown") != "", F.concat(F.lit("unknown "), "_unknown")).when(F.col("_old") != "", F.concat(F.lit("update the face photo of "), "_old"))
    answers = answers.withColumn("error", error).select("id", F.when(F.col("error").isNull(), F.col("people")).alias("people"), "error")
    return asked.join(answers, "id", "left")


def checked(asked: DataFrame, people: DataFrame, model: str = FACE_MODEL) -> DataFrame:
    """``asked`` (id, query, mode, reference) with people, words, wantsVector (whether anything must be encoded) and error.

    The errors are those of ``plans.query.build`` in its order, told for all queries at once and before anything is encoded:
    how names are written, what text searches need, whom nobody knows, and whether anything is asked at all.
    """
    typed = F.coalesce(F.trim(text.nfc(F.col("query"))), F.lit(""))
    rows = asked_people(asked.withColumn("query", typed), people, model)
    bare, ocr = text.without_mentions(F.col("query")), F.col("mode") == "OCR"
    named = F.regexp_extract_all("query", F.lit(text.MENTION), F.lit(1))
    rows = rows.withColumns({"_bare": bare, "_named": F.size(named) > 0, "_strange": F.exists(named, lambda m: ~m.rlike(text.HANDLE))})
    words = F.when(ocr, text.tokens(text.fold(F.col("_bare")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("words", words)
    error = (
        F.when(F.col("_strange"), "use 1 to 40 letters, numbers or underscores for a name")
        .when(F.col("_bare").rlike(r"(^|\s)@"), "enter a saved name after @")
        .when(ocr & F.col("reference"), "text search takes no reference photo")
        .when(ocr & (F.size("words") > text.MOST_WORDS), f"use at most {text.MOST_WORDS} words for text search")
        .when(ocr & (F.size("words") == 0), "enter the words to look for")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~ocr & ~F.col("reference") & ~F.col("_named") & (F.col("_bare") == ""), "enter a prompt, a person or a reference photo")
    )
    wants = ~ocr & (F.col("reference") | (F.col("_bare") != ""))
    rows = rows.withColumn("error", error)
    right = F.col("error").isNull()
    return rows.select(*asked.columns, F.when(right, F.col("people")).alias("people"), F.when(right, F.col("words")).alias("words"), (right & wants).alias("wantsVector"), "error")
