"""Registered queries over the index's upkeep, checked queries, model descriptions, faces and image kernels."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismlake import schemas
from prismlake.datasets import MODEL, Library
from prismlake.functions import contracts, images, scalars, text, vectors
from prismlake.functions import faces as face_functions
from prismlake.operators import planning, search, store
from prismlake.plans import query as plans
from prismlake.queries import FILTER_TIME, TOKENS, VALID_FACES, stored_media
from prismlake.registry import query
from prismlake.sources import copies
from prismlake.sources import library as sources
from prismlake.sources.tables import Store, scratch
from prismlake.streaming import index as streaming

# --- the store (S7, S11, D7-D13, J10, P17) ---


@query("SELECT id, handle FROM people WHERE handle IN ('p_3', 'p_17', 'p_x')", "people")
def people_by_handles(lib):
    return store.by_ids(lib.people, ["p_3", "p_17", "p_x"], "handle").select("id", "handle")


@query("SELECT id, name, handle, thumbnail, embeddingModel FROM people ORDER BY handle", "people")
def saved_people(lib):
    return store.saved_people(lib.people)


@query("SELECT 0 AS n FROM history HAVING count(*) > 0", "history")
def clear_history(lib):
    return store.clear(lib.history).agg(F.count("*").cast("int").alias("n"))


@query("""SELECT event_id % 50 AS id, max(event_id) AS processed, 'second' AS status FROM events WHERE event_id % 50 >= 25 GROUP BY 1
UNION ALL SELECT event_id % 50, max(event_id), 'first' FROM events WHERE event_id % 50 < 25 GROUP BY 1""")
def progress_upsert(lib):
    rows = lib.table("events").groupBy((F.col("event_id") % 50).alias("id")).agg(F.max("event_id").alias("processed"))
    return store.put_progress(rows.withColumn("status", F.lit("first")), rows.where("id >= 25").withColumn("status", F.lit("second")))


NEW_PEOPLE = "SELECT id + 1000000 AS id, 'New ' || name AS name, 'new_' || handle AS handle FROM people WHERE id % 2 = 0"


@query(f"SELECT id, name, handle FROM people UNION ALL {NEW_PEOPLE}", "people")
def people_add(lib):
    new = lib.people.where("id % 2 = 0").withColumns({"id": F.col("id") + 1000000, "name": F.concat(F.lit("New "), "name"), "handle": F.concat(F.lit("new_"), "handle")})
    return store.add_people(lib.people, new).select("id", "name", "handle")


@query("SELECT id, CASE WHEN id = 5 THEN 'v2' ELSE embeddingModel END AS embeddingModel, CASE WHEN id = 5 THEN 3 ELSE embeddingDimension END AS embeddingDimension, 1 AS changed FROM people", "people")
def people_update_face(lib):
    people = lib.people.withColumn("thumbnail", F.encode("thumbnail", "UTF-8")).withColumn("embeddingDimension", F.col("embeddingDimension").cast("int"))
    changed, n = store.update_face(people, 5, [1.0, 0.0, 0.0], b"new", "v2")
    return changed.select("id", "embeddingModel", "embeddingDimension", F.lit(n).alias("changed"))


@query("""SELECT id, name, handle, embeddingModel FROM people UNION ALL SELECT max(id) + 1, 'Ánh Dương', 'ánh_dương', 'v1' FROM people""", "people")
def people_enroll(lib):
    people = lib.people.withColumn("thumbnail", F.encode("thumbnail", "UTF-8")).withColumn("embeddingDimension", F.col("embeddingDimension").cast("int"))
    return store.enroll(people, " @Ánh Dương ", [0.0] * 64, b"face", model=MODEL).select("id", "name", "handle", "embeddingModel")


#: Handles in queries; the answer to each depends on the stored people alone.
ASKED = ["p_1", "P_2", "p_6", "p_12", "nobody", "p_1999999", "ánh"]


@query(f"""SELECT q AS handle, CASE WHEN p.handle IS NULL THEN 'unknown @' || lower(q) WHEN embeddingModel <> 'v1' THEN 'update the face photo of @' || lower(q) ELSE 'found' END AS answer
FROM (SELECT unnest({ASKED}) AS q) LEFT JOIN people p ON p.handle = lower(q)""", "people")
def requested_people(lib):
    """What is said of each asked handle before anything is encoded."""
    rows = []
    for asked in ASKED:
        try:
            handles = plans.parse(f"@{asked} at the beach")[1]
            plans.people_vectors(lib.people, handles, MODEL)
            rows.append((asked, "found"))
        except plans.QueryError as error:
            rows.append((asked, str(error)))
    return lib.spark.createDataFrame(rows, "handle string, answer string")


#: Arguments of searches (query, mode, reference photo, people known) and what is said of them.
CHECKED = [
    ("a beach", "NORMAL", False, "vector"), ("", "NORMAL", True, "vector"), ("", "NORMAL", False, "enter a prompt, a person or a reference photo"),
    ("@p_1", "NORMAL", False, "people"), ("@", "NORMAL", False, "enter a saved name after @"), ("the sea", "OCR", False, "words the sea"),
    ("the sea", "OCR", True, "text search takes no reference photo"), (" !? ", "OCR", False, "enter the words to look for"), ("@p_1 menu", "OCR", False, "people words menu"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}', '{m}', {str(r).lower()}, '{a}')" for i, (q, m, r, a) in enumerate(CHECKED)) + ") t(id, query, mode, reference, answer)")
def query_checks(lib):
    """Arguments are checked before any plan is built."""

    people = lib.people.withColumn("embeddingModel", F.lit(schemas.FACE_MODEL))

    def answer(asked: str, mode: str, reference: bool) -> str:
        try:
            made = plans.build(asked, plans.Filters(mode=mode), people, encode_text=lambda t: [1.0] * 64, references=[[1.0] * 64] if reference else [], face_threshold=0.5)
        except plans.QueryError as error:
            return str(error)
        return " ".join(["people"] * bool(made.people) + ["vector"] * bool(made.vector) + ["words", *made.words] * bool(made.words))

    rows = [(i, q, m, r, answer(q, m, r)) for i, (q, m, r, _) in enumerate(CHECKED)]
    return lib.spark.createDataFrame(rows, "id int, query string, mode string, reference boolean, answer string")


@query("""SELECT 'people' AS t, 8 AS columns, (SELECT count(*) FROM people) AS n, 'mobileclip2-s0' AS value UNION ALL SELECT 'search_history', 4, (SELECT count(*) FROM history), 'HYBRID'
UNION ALL SELECT 'photo_text', 6, 0, NULL UNION ALL SELECT 'face_index', 3, 0, NULL UNION ALL SELECT 'face_embeddings', 4, 0, NULL""", "people", "history")
def schema_migration(lib):
    """Tables of the second schema as those of the fourth."""
    old = {"people": lib.people.drop("embeddingModel").withColumn("extra", F.lit(1)), "search_history": lib.history.drop("searchMode")}
    new = schemas.migrate(old, 2)
    value = {"people": F.max("embeddingModel"), "search_history": F.max("searchMode")}
    parts = [df.agg(F.lit(name).alias("t"), F.lit(len(df.columns)).alias("columns"), F.count("*").alias("n"), value.get(name, F.lit(None).cast("string")).alias("value")) for name, df in new.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT mediaId, mimeType = 'image/jpeg' AND mediaId % 2 = 0 AS copied, CASE WHEN mimeType <> 'image/jpeg' THEN 'no image' WHEN mediaId % 2 = 1 THEN 'no file' END AS error FROM (SELECT * REPLACE (CASE WHEN mediaId % 3 = 0 THEN 'image/jpeg' ELSE 'text/plain' END AS mimeType) FROM media)", "media")
def image_copies(lib):
    """A copy of a real file for each even photo; others have no file, or no image."""
    path = F.when(F.col("mediaId") % 2 == 0, F.lit(f"{lib.sf_dir}/region.parquet")).otherwise(F.lit(f"{lib.sf_dir}/nothing-here"))
    mime = F.when(F.col("mediaId") % 3 == 0, "image/jpeg").otherwise("text/plain")
    folder = scratch(lib.spark)
    lib.spark.range(1).write.parquet(folder)  # makes the folder
    done = copies.save_copies(lib.media.select("mediaId", path.alias("path"), "displayName", mime.alias("mimeType")), folder)
    kind = F.when(F.col("error").contains("format is unavailable"), "no image").when(F.col("error").isNotNull(), "no file")
    return done.select("mediaId", F.coalesce(F.col("bytes") > 0, F.lit(False)).alias("copied"), kind.alias("error"))


@query(f"SELECT doc_id AS mediaId FROM (SELECT doc_id, unnest({TOKENS}) AS w FROM documents) WHERE w IN ('the', 'and', 'to') GROUP BY doc_id HAVING count(DISTINCT w) = 3")
def text_index(lib):
    """Words met in a kept index, half of whose buckets are written again after a change."""
    tables = Store(lib.spark, scratch(lib.spark), buckets=8)
    kept = search.TextIndex(tables)
    tables.publish(kept.rebuilt(lib.photo_text.withColumn("searchText", F.lit("old words"))), range(4))
    tables.publish(kept.rebuilt(lib.photo_text), range(4))
    tables.publish(kept.rebuilt(lib.photo_text), range(4, 8))
    return kept.matches(("the", "and", "to"))


# --- dates and text (P6, X4, X10, X16) ---


@query(f"SELECT mediaId, {FILTER_TIME} AS at FROM media WHERE {FILTER_TIME} >= 1704585600000 - 25200000 AND {FILTER_TIME} < 1704758400000 + 86400000 - 25200000", "media")
def picked_range_filter(lib):
    """7 to 9 January 2024, picked as UTC dates, in a zone seven hours ahead."""
    start, end = scalars.picked_range(1704585600000, 1704758400000, "Asia/Ho_Chi_Minh")
    return search.candidates(lib.media, plans.Filters(start, end, mode="OCR")).select("mediaId", scalars.filter_time().alias("at"))


@query(f"""SELECT doc_id, CASE WHEN len(d) > 64 THEN 'use at most 64 words for text search' WHEN len(d) > 0 THEN '"' || array_to_string(d, '" "') || '"' END AS quoted FROM (
  SELECT doc_id, list(w ORDER BY i) FILTER (w <> '') AS d FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) GROUP BY doc_id, w) GROUP BY doc_id)""")
def quoted_words(lib):
    """Every document as a text query: its words in quotes, or why it is too long."""

    @F.pandas_udf(T.StringType())
    def asked(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return text.full_text_query(t or "")
            except ValueError as error:
                return str(error)

        return texts.map(one)

    return lib.table("documents").select("doc_id", asked(F.col("text")).alias("quoted"))


@query("""SELECT b AS byte, CASE WHEN v THEN chr(b) ELSE chr(256 + CAST(b - (SELECT count(*) FROM range(256) r(k) WHERE k < b AND (k BETWEEN 33 AND 126 OR k BETWEEN 161 AND 172 OR k BETWEEN 174 AND 255)) AS INTEGER)) END AS character, n FROM (
  SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS v, count(*) AS n FROM (
    SELECT CAST('0x' || x AS INTEGER) AS b FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents)) GROUP BY b)""")
def byte_alphabet(lib):
    """How often each byte stands in the documents, beside the character that shows it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for value in batch.column(0).drop_null():
                total += np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["byte", "n"])

    found = lib.table("documents").select(F.encode("text", "UTF-8").alias("b")).mapInArrow(counted, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    shown = F.create_map(*(F.lit(x) for pair in text.byte_alphabet().items() for x in pair))
    return found.select("byte", shown[F.col("byte")].alias("character"), "n")


# --- model descriptions (S9, S10, V12, X17, X18) ---

# a description for each part; some break a rule
DESCRIPTION = {
    **{k: json.dumps(v) for k, v in contracts.REQUIRED.items()},
    "format_version": "CASE WHEN p_partkey % 7 = 1 THEN '2' ELSE '1' END", "model.embedding_dimension": "CASE WHEN p_partkey % 7 = 2 THEN '\"512\"' ELSE '512' END",
    "image_encoder.input_shape": "CASE WHEN p_partkey % 7 = 3 THEN '[1, 3, 256, 256]' ELSE '[\"batch\", 3, 256, 256]' END",
    "image_encoder.preprocessing.center_crop": "CASE WHEN p_partkey % 7 = 4 THEN '1' ELSE 'true' END", "image_encoder.mean": "[0, 0, 0]", "image_encoder.std": "CASE WHEN p_partkey % 7 = 5 THEN '[1, 0, 1]' ELSE '[1, 1, 1]' END",
    **{k: {str: '"x"', bool: "true", int: "1"}[v] for k, v in contracts.PRESENT.items()}, **{k: '"file.bin"' for k in contracts.FILES},
    "tokenizer.vocab_file": "CASE WHEN p_partkey % 7 = 6 THEN '\"../vocab\"' ELSE '\"vocab\"' END", "tokenizer.merge_count": "3",
    "tokenizer_test_vectors": json.dumps([{"text": "a", "input_ids": [0] * 77}]),
}


def _described() -> str:
    """The JSON text of a description as an expression that Spark and DuckDB share."""
    tree: dict = {}
    for path, value in DESCRIPTION.items():
        *above, last = path.split(".")
        at = tree
        for name in above:
            at = at.setdefault(name, {})
        at[last] = value if value.startswith("CASE") else "'" + value + "'"

    def written(node) -> str:
        if isinstance(node, str):
            return f"({node})"
        return "'{' || " + " || ', ' || ".join(f"'\"{k}\": ' || {written(v)}" for k, v in node.items()) + " || '}'"

    return written(tree)


_RULES = " AND ".join(
    [f"json_extract(d, '$.{p}') = json_extract('{{\"x\": {json.dumps(v)}}}', '$.x')" for p, v in contracts.REQUIRED.items()]
    + [f"NOT contains(json_extract_string(d, '$.{p}'), '/')" for p in contracts.FILES]
    + ["list_min(CAST(json_extract(d, '$.image_encoder.std') AS DOUBLE[])) > 0"]
)


@query(f"SELECT p_partkey, coalesce({_RULES}, false) AS accepted FROM (SELECT p_partkey, CAST({_described()} AS JSON) AS d FROM part)")
def description_checks(lib):
    """Which descriptions keep every rule, shapes and types included."""

    @F.pandas_udf(T.BooleanType())
    def accepted(texts: pd.Series) -> pd.Series:
        def one(t: str) -> bool:
            try:
                return bool(contracts.read_config(t))
            except contracts.ContractError:
                return False

        return texts.map(one)

    return lib.table("part").selectExpr("p_partkey", f"{_described()} AS d").select("p_partkey", accepted("d").alias("accepted"))


@query("""SELECT doc_id, p[1] AS first, p[2] AS second, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS rank FROM (
  SELECT doc_id, i, regexp_split_to_array(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+') AS p, l FROM (
    SELECT doc_id, unnest(t) AS l, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS t FROM documents)))
WHERE NOT starts_with(l, '#version:') AND trim(l) <> '' AND len(p) = 2""")
def merge_lines(lib):
    """The lines of two words of every document, read as a merge list."""
    files = lib.table("documents").select(F.col("doc_id").alias("file"), F.col("text").alias("value"))
    return contracts.merge_lists(files).withColumnRenamed("file", "doc_id")


FIT = "o.is_float AND o.rank = 2 AND o.rows IN (1, -1) AND o.width = 512"


@query(f"""SELECT orderkey, CASE WHEN len(able) = 1 THEN able[1] END AS output FROM (SELECT orderkey, list_transform(list_filter(CASE WHEN len(named) > 0 THEN named[1:1] ELSE os END, lambda o: {FIT}), lambda o: o.name) AS able
FROM (SELECT orderkey, os, list_filter(os, lambda o: o.name = 'R') AS named FROM (SELECT l_orderkey AS orderkey, list({{'name': l_returnflag, 'is_float': l_quantity % 3 > 0, 'rank': 2 + CAST(l_quantity % 7 = 0 AS INTEGER), 'rows': 1 - 2 * CAST(l_partkey % 2 AS INTEGER), 'width': CASE WHEN l_partkey % 3 = 0 THEN 64 ELSE 512 END}} ORDER BY l_linenumber, l_returnflag, l_quantity % 3 > 0, 1 - 2 * (l_partkey % 2), l_partkey % 3 > 0, l_quantity % 7 = 0) AS os FROM lineitem GROUP BY l_orderkey)))""")
def output_resolution(lib):
    """The output of each order's line items, seen as a model's outputs."""

    @F.pandas_udf(T.StringType())
    def resolved(orders: pd.Series) -> pd.Series:
        def one(found) -> str | None:
            outputs = [contracts.Output(o["name"], o["is_float"], tuple(o["shape"])) for o in found]
            try:
                return contracts.resolve_output("R", 512, outputs)
            except contracts.ContractError:
                return None

        return orders.map(one)

    width = F.when(F.col("l_partkey") % 3 == 0, 64).otherwise(512)
    rows = F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(-1)
    shape = F.when(F.col("l_quantity") % 7 == 0, F.array(rows, width, F.lit(1))).otherwise(F.array(rows, width))
    output = F.struct("l_linenumber", F.col("l_returnflag").alias("name"), (F.col("l_quantity") % 3 > 0).alias("is_float"), shape.alias("shape"))
    grouped = lib.table("lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.sort_array(F.collect_list(output)).alias("os"))
    return grouped.select("orderkey", resolved("os").alias("output"))


@query("SELECT p_partkey, p_partkey * 1000003 AS number, p_size AS size, CAST(octet_length(encode(p_name)) AS INTEGER) AS name_bytes FROM part")
def wire_fields(lib):
    """Messages in the wire format of model files, walked field by field."""

    @F.pandas_udf(T.BinaryType())
    def message(numbers: pd.Series, sizes: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([contracts.wire_message([(1, int(n)), (2, name.encode()), (3, int(s))]) for n, s, name in zip(numbers, sizes, names, strict=True)])

    @F.pandas_udf(T.StructType([T.StructField("number", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("name_bytes", T.IntegerType())]))
    def walked(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in blobs:
            found = dict(contracts.wire_fields(bytes(blob)))
            rows.append((found[1], found[3], len(found[2])))
        return pd.DataFrame(rows, columns=["number", "size", "name_bytes"])

    blob = message(F.col("p_partkey") * 1000003, F.col("p_size"), F.col("p_name"))
    return lib.table("part").select("p_partkey", walked(blob).alias("f")).select("p_partkey", "f.*")


@query("SELECT count(*) - 1 AS merges, '#version: 0.2' AS head, (SELECT count(*) FROM region) AS entries FROM nation")
def tokenizer_export(lib):
    """D14, its text files: a vocabulary by id and merges by rank, written and read again."""
    folder = scratch(lib.spark)
    vocabulary = lib.table("region").select(F.col("r_name").alias("token"), F.col("r_regionkey").cast("int").alias("id"))
    merges = lib.table("nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("int").alias("rank"), F.lit("a").alias("first"), F.col("n_nationkey").cast("string").alias("second"))
    contracts.export_tokenizer(vocabulary, merges, folder)
    lines = lib.spark.read.text(f"{folder}/merges", wholetext=True)
    again = contracts.merge_list(lib.spark, f"{folder}/merges")
    entries = F.size(F.map_keys(F.from_json("value", "map<string,int>"))).cast("long")
    read = lib.spark.read.text(f"{folder}/vocabulary", wholetext=True).select(entries.alias("entries"))
    return again.agg(F.count("*").alias("merges")).join(lines.select(F.split("value", "\n")[0].alias("head"))).join(read)


@query("SELECT r_name, sha256(r_name) AS sha256 FROM region")
def asset_checksums(lib):
    """Files that must have the checksums that are expected of their names."""
    names = [r["r_name"] for r in lib.table("region").select("r_name").collect()]  # one file for each region
    files = lib.table("region").select(F.concat(F.lit("assets/"), "r_name").alias("path"), F.encode("r_name", "UTF-8").alias("content"))
    checked = contracts.with_checksum(files, {n: hashlib.sha256(n.encode()).hexdigest() for n in names})
    return checked.select(F.element_at(F.split("path", "/"), -1).alias("r_name"), "sha256")


# --- passes (R3-R6, R9, R10, S3, U1-U5) ---


@query("""SELECT 1 AS id, (SELECT count(*) FROM media) AS processed, (SELECT count(*) FROM media) AS total, (SELECT count(*) FROM media m WHERE m.mediaId NOT IN (SELECT mediaId FROM stored) AND mediaId % 5 = 0) AS failed, 'INTERRUPTED' AS status
UNION ALL SELECT 2, (SELECT count(*) FROM media) - (SELECT count(*) FROM media WHERE mediaId % 4 = 0), (SELECT count(*) FROM media), 0, 'UNAVAILABLE'
UNION ALL SELECT 3, (SELECT count(*) FROM media) - (SELECT count(*) FROM media WHERE mediaId % 3 = 0 AND mediaId % 5 = 0), (SELECT count(*) FROM media), (SELECT count(*) FROM media WHERE mediaId % 3 = 0 AND mediaId % 5 = 0), 'INTERRUPTED'""", "stored")
def staged_indexing(lib):
    """Three stages, of which the second's model is missing; failed photos are told apart and stay pending."""
    failing = F.when(F.col("mediaId") % 5 == 0, F.lit("unreadable"))
    result = F.struct(F.when(failing.isNull(), F.array(F.lit(1.0))).alias("value"), failing.alias("error"))

    def missing(rows: DataFrame) -> DataFrame:
        raise RuntimeError("the model is missing")

    stages = [
        planning.Stage("visual", lambda now: now.join(lib.stored.select("mediaId"), "mediaId", "left_anti"), lambda rows: rows.withColumn("result", result), True),
        planning.Stage("faces", lambda now: now.where("mediaId % 4 = 0"), missing, False),
        planning.Stage("text", lambda now: now.where("mediaId % 3 = 0"), lambda rows: rows.withColumn("result", result), False),
    ]
    progress = planning.run_stages(lib.media.select("mediaId", "dateModified"), stages)[1]
    return lib.spark.createDataFrame([tuple(p[c] for c in ("id", "processed", "total", "failed", "status")) for p in progress], "id int, processed long, total long, failed long, status string")


CHANGED = "SELECT mediaId, dateModified + 1 AS dateModified, embeddingDimension FROM media WHERE mediaId % 2 = 0"


@query(f"SELECT mediaId, max(dateModified) AS dateModified, count(*) OVER () AS n FROM (SELECT mediaId, dateModified FROM ({CHANGED}) UNION ALL SELECT mediaId, dateModified + CASE WHEN mediaId % 6 = 0 THEN 1 WHEN mediaId % 6 = 1 THEN -1 ELSE 0 END FROM media WHERE mediaId % 13 <> 0) GROUP BY mediaId", "media")
def stream_into_store(lib):
    """A change feed, read as a stream of files, merged into the kept tables by buckets."""
    folder = scratch(lib.spark)
    media = stored_media(lib).drop("origin")
    empty = {name: lib.spark.createDataFrame([], schema) for name, schema in (("photo_text", schemas.PHOTO_TEXT), ("face_index", schemas.FACE_INDEX), ("face_embeddings", schemas.FACES))}
    tables = Store(lib.spark, f"{folder}/store", buckets=8)
    tables.publish({"media_embeddings": media, **empty})
    feed = lib.media.where("mediaId % 2 = 0").select("mediaId", (F.col("dateModified") + 1).alias("dateModified"), "embeddingDimension")
    feed.write.parquet(f"{folder}/feed")
    changes = sources.changes(lib.spark, f"{folder}/feed", media.schema)
    streaming.into_store(changes, tables, f"{folder}/checkpoint").awaitTermination()
    now = tables.read("media_embeddings")
    return now.select("mediaId", "dateModified").join(now.agg(F.count("*").alias("n")))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def stream_live_counts(lib):
    """Counts that a stream keeps, after all files have come."""
    folder = scratch(lib.spark)
    lib.table("events").select("event_id", "event_type").write.parquet(f"{folder}/in")
    stream = streaming.live_counts(sources.changes(lib.spark, f"{folder}/in", T.StructType.fromDDL("event_id long, event_type string"), 1), "event_type")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.parquet(f"{folder}/out/{number}")

    done = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    return lib.spark.read.parquet(f"{folder}/out/{done.lastProgress['batchId']}")


@query("SELECT mediaId FROM media ORDER BY mediaId DESC LIMIT 5", "media")
def latest_query(lib):
    """A search that is overtaken while it is planned gives nothing; the newer one's rows count."""
    searches = streaming.LatestQuery(lib.spark)
    newest: list = []

    def overtaken() -> DataFrame:
        newest.extend(searches.run(lambda: lib.media.select("mediaId").orderBy(F.desc("mediaId")).limit(5)))
        return lib.media.select("mediaId").limit(5)

    stale = searches.run(overtaken)
    return lib.spark.createDataFrame([(r["mediaId"],) for r in newest if stale is None], "mediaId long")


@query("SELECT (SELECT count(*) FROM media) AS kept, true AS refused", "media")
def unreadable_source(lib):
    """A library that can't be read is no empty library, so nothing is deleted."""
    try:
        gone, refused = planning.deleted(sources.scan(lib.spark, f"{lib.sf_dir}/nothing-here"), lib.media), False
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        gone, refused = lib.media.where("false"), True
    return store.delete_media({"media_embeddings": lib.media}, gone)["media_embeddings"].agg(F.count("*").alias("kept")).withColumn("refused", F.lit(refused))


@query(f"""SELECT mediaId, round(s, 6) AS score FROM (SELECT f.mediaId, max(list_dot_product(CAST(f.embedding AS DOUBLE[]), q) / sqrt(list_dot_product(q, q))) AS s {VALID_FACES.replace('FROM faces f', 'FROM (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 30) CROSS JOIN faces f')} AND m.mediaType = 'IMAGE' AND m.embeddingDimension > 0 GROUP BY f.mediaId) WHERE s >= 0.2""", "media", "face_index")
def provider_search(lib):
    """U4: photos, and then the faces of those, from a deployment's own functions."""

    def faces(ids: DataFrame) -> DataFrame:
        return search.face_lists(lib.faces.join(ids, "mediaId", "left_semi"), lib.face_index, lib.media, MODEL)

    provider = search.Provider(lambda filters: search.candidates(lib.media, filters), faces)
    found = provider.search(plans.Query(plans.Filters(media_type="IMAGE"), people=(tuple(lib.vector(30)),), limit=2**31 - 1, face_threshold=0.2))
    return found.select("mediaId", F.round("rawSimilarity", 6).alias("score"))


@query("SELECT mediaId, mediaType FROM media", "media")
def allowed_types(lib):
    """Values outside the known types would fail."""
    return schemas.allowed(lib.media, "mediaType").select("mediaId", "mediaType")


def _picture(seed: np.ndarray) -> np.ndarray:
    """A small picture of a vector: rows from its numbers, columns from its first 48."""
    return np.uint8(np.clip(np.outer(seed, seed[:48]).astype(float)[..., None] * [400, 300, 200] + 128, 0, 255))


#: The same pictures for DuckDB: a row for each pixel's channel.
PIXELS = """px AS (SELECT vec_id, y, x, c, CAST(floor(least(greatest(CAST(CAST(embedding[y + 1] AS FLOAT) * CAST(embedding[x + 1] AS FLOAT) AS DOUBLE) * (400 - 100 * c) + 128, 0), 255)) AS DOUBLE) AS p
  FROM embeddings, range(64) a(y), range(48) b(x), range(3) d(c))"""


def _prepared(lib: Library, kernel) -> DataFrame:
    made = images.kernel(lambda blob: _picture(np.frombuffer(blob, "<f4")), kernel)(vectors.encode(F.col("embedding")))
    total = F.aggregate("r.value", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return lib.table("embeddings").select("vec_id", made.alias("r")).select("vec_id", F.size("r.value").alias("n"), F.round(total, 3).alias("total"), "r.error")


def _taps(name: str, size: int, source: int, scaled: float, offset: int) -> str:
    """Bicubic weights of an axis as a DuckDB table (o, i, w)."""
    near, far = "(1.5 * d - 2.5) * d * d + 1", "((-0.5 * d + 2.5) * d - 4) * d + 2"
    return f"""{name} AS (SELECT o, i, sum(w) AS w FROM (SELECT o, least(greatest(b + k, 0), {source} - 1) AS i, c / sum(c) OVER (PARTITION BY o) AS w FROM (
  SELECT o, b, k, CASE WHEN d <= 1 THEN {near} WHEN d < 2 THEN {far} ELSE 0 END AS c FROM (SELECT o, b, k, abs(pos - b - k) AS d FROM (
    SELECT o, pos, CAST(floor(pos) AS INTEGER) AS b FROM (SELECT o, (o + {offset} + 0.5) * ({source}.0 / {scaled}) - 0.5 AS pos FROM range({size}) r(o))), range(-1, 3) q(k)))) GROUP BY o, i)"""


# 64 x 48 to 42 x 32, from row 5 on
@query(f"""WITH {PIXELS}, {_taps("wy", 32, 64, 42, 5)}, {_taps("wx", 32, 48, 32, 0)},
h AS (SELECT vec_id, y, c, wx.o AS u, sum(p * w) AS p FROM px JOIN wx ON wx.i = x GROUP BY ALL),
v AS (SELECT vec_id, wy.o AS v, u, c, sum(p * w) AS p FROM h JOIN wy ON wy.i = y GROUP BY ALL)
SELECT vec_id, CAST(count(*) AS INTEGER) AS n, round(sum(CAST(CAST(least(greatest(p, 0), 255) / 255 AS FLOAT) AS DOUBLE)), 3) AS total, CAST(NULL AS VARCHAR) AS error FROM v GROUP BY vec_id""")
def bicubic_crop(lib):
    """The prepared image of small pictures made from each vector."""
    return _prepared(lib, lambda pixels: images.center_crop(pixels, 32))


def _linear(name: str, n: int, source: int) -> str:
    return f"""{name} AS (SELECT o, i, sum(w) AS w FROM (SELECT o, unnest([low, least(low + 1, {source} - 1)]) AS i, unnest([1 - (pos - low), pos - low]) AS w FROM (
  SELECT o, pos, least(CAST(floor(pos) AS INTEGER), {source} - 2) AS low FROM (SELECT o, least(greatest((o + 0.5) * ({source}.0 / {n}) - 0.5, 0), {source} - 1) AS pos FROM range({n}) r(o)))) GROUP BY o, i)"""


# 64 x 48 to 32 x 24, the rest of 32 x 32 as black
@query(f"""WITH {PIXELS}, {_linear("wy", 32, 64)}, {_linear("wx", 24, 48)},
h AS (SELECT vec_id, y, c, wx.o AS u, sum(p * w) AS p FROM px JOIN wx ON wx.i = x GROUP BY ALL),
v AS (SELECT vec_id, wy.o AS v, u, c, sum(p * w) AS p FROM h JOIN wy ON wy.i = y GROUP BY ALL)
SELECT vec_id, CAST(3072 AS INTEGER) AS n, round(sum(CAST(CAST((floor(p + 0.5) - 127.5) / 128 AS FLOAT) AS DOUBLE)) + 768 * CAST(CAST(-127.5 / 128 AS FLOAT) AS DOUBLE), 3) AS total, CAST(NULL AS VARCHAR) AS error FROM v GROUP BY vec_id""")
def detector_input(lib):
    """K2."""
    return _prepared(lib, lambda pixels: images.detector_input(pixels, 32))


# u = 0.25 x - 0.125 y + 3, v = 0.125 x + 0.25 y + 2, sampled on 16 x 16
WARP = (0.25, 0.125, 3.0, 2.0)


@query(f"""WITH {PIXELS}, spots AS (SELECT u, v, (0.25 * (u - 3) + 0.125 * (v - 2)) / 0.078125 AS sx, (0.25 * (v - 2) - 0.125 * (u - 3)) / 0.078125 AS sy FROM range(16) a(u), range(16) b(v)),
s AS (SELECT u, v, floor(sx) + i AS x, floor(sy) + j AS y, CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END * CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END AS w FROM spots, range(2) c(i), range(2) d(j)),
o AS (SELECT vec_id, u, v, c, sum(p * w) AS p FROM px JOIN s ON px.x = s.x AND px.y = s.y GROUP BY ALL)
SELECT vec_id, CAST(768 AS INTEGER) AS n, round(sum(CAST(CAST((p - 127.5) / 127.5 AS FLOAT) AS DOUBLE)) - (768 - count(*)), 3) AS total, CAST(NULL AS VARCHAR) AS error FROM o GROUP BY vec_id""")
def face_input(lib):
    """K4: faces warped by a similarity; beyond the picture is black."""
    return _prepared(lib, lambda pixels: images.face_input(pixels, WARP, 16))


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE CAST(2 + vec_id % 200 AS DOUBLE) END AS value, CASE WHEN vec_id % 4 = 0 THEN CASE WHEN vec_id % 8 = 0 THEN 'ValueError: the image is cut off or empty' ELSE 'ValueError: not a binary 8-bit PPM image' END END AS error FROM embeddings")
def kernel_errors(lib):
    """Decoded images through a model's place; what can't be decoded keeps its reason."""

    @F.pandas_udf(T.BinaryType())
    def file(ids: pd.Series) -> pd.Series:
        def one(i: int) -> bytes:
            whole = b"P6 2 1 255\n" + bytes([2 + i % 200] * 6)
            return whole if i % 4 else whole[:-3] if i % 8 == 0 else b"GIF" + whole

        return ids.map(one)

    mean = images.kernel(images.raw_rgb, lambda pixels: np.array([pixels.mean()]))(file("vec_id"))
    return lib.table("embeddings").select("vec_id", mean.alias("r")).select("vec_id", F.col("r.value")[0].cast("double").alias("value"), "r.error")


# --- faces (V7, V9, V10, A8, A12, W5, W6, O11, K3, U3) ---


@query(f"SELECT f.mediaId, CAST(row_number() OVER (PARTITION BY f.mediaId ORDER BY f.faceIndex) - 1 AS INTEGER) AS faceIndex, round(list_sum(CAST(f.embedding AS DOUBLE[])), 5) AS checksum {VALID_FACES}", "media", "face_index")
def face_ordinals(lib):
    """W5, U3."""
    found = search.face_lists(lib.faces, lib.face_index, lib.media, MODEL)
    total = F.aggregate("face", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return face_functions.numbered(found).select("mediaId", "faceIndex", F.round(total, 5).alias("checksum"))


def _similarity(vector: int) -> str:
    return f"(SELECT list_transform(v, lambda x: x / n) FROM (SELECT CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings WHERE vec_id = {vector}))"


# two persons: the one with fewer choices first; the second's favourite is given up only if the first can't move
@query(f"""WITH s AS (SELECT f.mediaId, f.faceIndex AS f, list_dot_product(CAST(f.embedding AS DOUBLE[]), a) AS a, list_dot_product(CAST(f.embedding AS DOUBLE[]), b) AS b
  {VALID_FACES.replace('FROM faces f', f'FROM (SELECT {_similarity(30)} AS a, {_similarity(31)} AS b) CROSS JOIN faces f')}),
c AS (SELECT mediaId, count(*) AS n, coalesce(list({{'f': f, 's': a}} ORDER BY a DESC, f) FILTER (a >= 0.05), []) AS a, coalesce(list({{'f': f, 's': b}} ORDER BY b DESC, f) FILTER (b >= 0.05), []) AS b FROM s GROUP BY mediaId),
p AS (SELECT mediaId, CASE WHEN len(b) < len(a) THEN b ELSE a END AS a, CASE WHEN len(b) < len(a) THEN a ELSE b END AS b FROM c WHERE n >= 2)
SELECT mediaId, round(CASE WHEN b[1].f <> a[1].f THEN a[1].s + b[1].s WHEN len(a) > 1 THEN a[2].s + b[1].s ELSE a[1].s + b[2].s END / 2, 6) AS score
FROM p WHERE len(a) > 0 AND len(b) > 0 AND NOT (b[1].f = a[1].f AND len(a) = 1 AND len(b) = 1)""", "media", "face_index")
def people_filter_multi(lib):
    """Photos with a face of their own for each of two persons."""
    faces = search.face_lists(lib.faces, lib.face_index, lib.media, MODEL).where(F.size("faces") >= 2)
    score = face_functions.match_all([lib.vector(30), lib.vector(31)], 0.05)(F.col("faces"))
    return faces.select("mediaId", F.round(score, 6).alias("score")).where("score is not null")


BOX = "{'l': CAST(l_partkey % 500 AS DOUBLE), 't': CAST(l_suppkey % 400 AS DOUBLE), 'r': CAST(l_partkey % 500 + l_quantity * 4 AS DOUBLE), 'b': CAST(l_suppkey % 400 + l_quantity * 3 AS DOUBLE)}"
_SHARED = "greatest(0, least(k.r, x.r) - greatest(k.l, x.l) + 1) * greatest(0, least(k.b, x.b) - greatest(k.t, x.t) + 1)"
_AREA = "((k.r - k.l + 1) * (k.b - k.t + 1) + (x.r - x.l + 1) * (x.b - x.t + 1))"


@query(f"""WITH RECURSIVE boxes AS (SELECT l_orderkey AS mediaId, list({BOX} ORDER BY CAST(1 - l_discount * 5 AS FLOAT) DESC, l_linenumber, l_partkey % 500, l_suppkey % 400, l_quantity) AS found FROM lineitem GROUP BY l_orderkey),
step AS (SELECT mediaId, found, 1 AS i, found[1:1] AS kept FROM boxes
  UNION ALL SELECT mediaId, found, i + 1, CASE WHEN (SELECT bool_or({_SHARED} / ({_AREA} - {_SHARED}) > 0.4) FROM (SELECT unnest(kept) AS k)) THEN kept ELSE list_append(kept, x) END
  FROM (SELECT *, found[i + 1] AS x FROM step WHERE i < len(found)))
SELECT mediaId, CAST(len(found) AS INTEGER) AS n, CAST(len(kept) AS INTEGER) AS kept, round(list_sum(list_transform(kept, lambda k: CAST(k.l AS DOUBLE))), 3) AS lefts FROM step WHERE i = len(found)""")
def nms(lib):
    """Boxes kept of each photo, best first; equal scores in the order of their lines."""
    e = "CAST(l_partkey % 500 AS FLOAT) AS left, CAST(l_suppkey % 400 AS FLOAT) AS top, CAST(l_partkey % 500 + l_quantity * 4 AS FLOAT) AS right, CAST(l_suppkey % 400 + l_quantity * 3 AS FLOAT) AS bottom, CAST(1 - l_discount * 5 AS FLOAT) AS score"
    boxes = lib.table("lineitem").selectExpr("l_orderkey AS mediaId", "l_linenumber", *e.split(", ")).withColumn("landmarks", F.lit(None).cast(T.ArrayType(face_functions.POINT)))
    box = F.struct("left", "top", "right", "bottom", "score", "landmarks")
    found = boxes.groupBy("mediaId").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", box.alias("face")))), lambda x: x["face"]).alias("found"))
    kept = found.select("mediaId", F.size("found").alias("n"), face_functions.suppressed(F.col("found")).alias("kept"))
    lefts = F.aggregate("kept", F.lit(0.0), lambda s, k: s + k["left"].cast("double"))
    return kept.select("mediaId", "n", F.size("kept").alias("kept"), F.round(lefts, 3).alias("lefts"))


_POINTS = "[" + ", ".join(f"{{'i': {i}, 'u': {x}, 'v': {y}, 'x': {x} * (1 + vec_id % 5) - {y} * (vec_id % 3) + vec_id + (vec_id % 7) * {i}, 'y': {y} * (1 + vec_id % 5) + {x} * (vec_id % 3)}}" for i, (x, y) in enumerate(face_functions.TEMPLATE.tolist())) + "]"


@query(f"""WITH p AS (SELECT vec_id, unnest({_POINTS}) AS p FROM embeddings),
m AS (SELECT vec_id, avg(p.x) AS mx, avg(p.y) AS my, avg(p.u) AS mu, avg(p.v) AS mv FROM p GROUP BY vec_id),
f AS (SELECT vec_id, sum((p.x - mx) * (p.u - mu) + (p.y - my) * (p.v - mv)) / sum((p.x - mx) ** 2 + (p.y - my) ** 2) AS a, sum((p.x - mx) * (p.v - mv) - (p.y - my) * (p.u - mu)) / sum((p.x - mx) ** 2 + (p.y - my) ** 2) AS b,
  any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv FROM p JOIN m USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx + b * my, 6) AS tx, round(mv - b * mx - a * my, 6) AS ty, CAST(NULL AS VARCHAR) AS error FROM f""")
def face_alignment(lib):
    """Similarity transforms of landmarks that turn, grow and bend with the row."""
    i = F.col("vec_id")
    points = F.array(*(F.struct((F.lit(x) * (1 + i % 5) - F.lit(y) * (i % 3) + i + (i % 7) * k).alias("x"), (F.lit(y) * (1 + i % 5) + F.lit(x) * (i % 3)).alias("y")) for k, (x, y) in enumerate(face_functions.TEMPLATE.tolist())))
    found = lib.table("embeddings").select("vec_id", face_functions.aligned(points).alias("t"))
    return found.select("vec_id", *(F.round(f"t.{c}", 6).alias(c) for c in ("a", "b", "tx", "ty")), "t.error")


# detector outputs from a vector's numbers: at strides 8 and 16 nothing reaches the least score, at 32 a cell has two anchors
@query("""SELECT vec_id, CAST(len(k) AS INTEGER) AS n, round(list_sum(list_transform(k, lambda f: f.l + f.r)), 4) AS total FROM (SELECT vec_id, CASE WHEN len(f) = 2 AND f[1].s >= f[2].s AND o > 0.4 THEN f[1:1] WHEN len(f) = 2 AND o > 0.4 THEN f[2:2] ELSE f END AS k FROM (
  SELECT vec_id, f, CASE WHEN len(f) = 2 THEN ((least(f[1].r, f[2].r) - greatest(f[1].l, f[2].l) + 1) * (least(f[1].b, f[2].b) - greatest(f[1].t, f[2].t) + 1)) / ((f[1].r - f[1].l + 1) * (f[1].b - f[1].t + 1) + (f[2].r - f[2].l + 1) * (f[2].b - f[2].t + 1)
    - (least(f[1].r, f[2].r) - greatest(f[1].l, f[2].l) + 1) * (least(f[1].b, f[2].b) - greatest(f[1].t, f[2].t) + 1)) ELSE 0 END AS o FROM (
    SELECT vec_id, list_filter([box(e, 1), box(e, 2)], lambda x: x.s >= 0.5) AS f FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))))""".replace("box(e, 1)", "{'s': 0.5 + e[1], 'l': -32 * (1 + abs(e[11])), 't': -32 * (1 + abs(e[12])), 'r': 32 * (1 + abs(e[13])), 'b': 32 * (1 + abs(e[14]))}").replace("box(e, 2)", "{'s': 0.5 + e[2], 'l': -32 * (1 + abs(e[15])), 't': -32 * (1 + abs(e[16])), 'r': 32 * (1 + abs(e[17])), 'b': 32 * (1 + abs(e[18]))}"))
def anchor_decoding(lib):
    """K3."""

    @F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("total", T.DoubleType())]))
    def decoded(rows: pd.Series) -> pd.DataFrame:
        out = []
        for v in rows:
            e = np.asarray(v, float)
            sizes = [2 * (32 // s) ** 2 for s in (8, 16, 32)]
            outputs = [np.zeros(n * k) for k in (1, 4, 10) for n in sizes]
            outputs[2], outputs[5], outputs[8] = 0.5 + e[:2], 1 + np.abs(e[10:18]), e[20:40]
            found = face_functions.decode_anchors(outputs, 32, 32, 32)
            out.append((len(found), sum(f["left"] + f["right"] for f in found) if found else None))
        return pd.DataFrame(out, columns=["n", "total"])

    return lib.table("embeddings").select("vec_id", decoded("embedding").alias("r")).select("vec_id", "r.n", F.round("r.total", 4).alias("total"))
