"""Registered queries over kept tables: streams into them, co-located tables, many queries at once and joins of two growing sides."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake import registry, schemas
from prismlake.datasets import MODEL, NOW_MILLIS, VIEWS
from prismlake.functions import contracts
from prismlake.operators import albums, asking, many, paging, pivots, planning, search, store
from prismlake.plans.query import Filters
from prismlake.queries import RANK_TIME, TOKENS
from prismlake.registry import query
from prismlake.sources import colocated
from prismlake.sources import library as sources
from prismlake.sources.tables import Store, scratch
from prismlake.streaming import index as streaming
from prismlake.streaming import live

# --- kept tables that follow a stream (D3, D5, D12, R2, R5) ---


@query(f"""SELECT m.mediaId, m.dateModified + CAST(m.mediaId % 5 = 0 AS BIGINT) AS dateModified FROM media m JOIN (SELECT doc_id, {TOKENS} AS w FROM documents) d ON m.mediaId = d.doc_id JOIN photo_text p ON p.mediaId = m.mediaId
WHERE m.mediaId % 7 <> 0 AND list_has_all(d.w, ['the', 'and']) AND (m.mediaId % 10 = 0 OR (m.mediaId % 5 <> 0 AND p.dateModified = m.dateModified AND p.modelVersion = 'v1'))""", "media", "photo_text")
def streamed_text_index(lib):
    """Words met in postings that followed two streams: changed and deleted photos, then texts read anew."""
    folder = scratch(lib.spark)
    media = lib.media.select("mediaId", "dateModified", "embeddingDimension")
    texts = lib.photo_text.select("mediaId", "searchText", "dateModified", "modelVersion")
    tables = Store(lib.spark, f"{folder}/store", buckets=8)
    kept = search.TextIndex(tables)
    empty = {name: lib.spark.createDataFrame([], schema) for name, schema in (("face_index", schemas.FACE_INDEX), ("face_embeddings", schemas.FACES))}
    tables.publish({"media_embeddings": media, "photo_text": texts, **kept.rebuilt(texts), **empty})
    # every fifth photo has a new revision, every seventh is gone
    changed = media.where("mediaId % 5 = 0").withColumns({"dateModified": F.col("dateModified") + 1, "gone": F.lit(False)})
    gone = media.where("mediaId % 7 = 0").withColumns({"dateModified": F.col("dateModified") + 2, "gone": F.lit(True)})
    changed.unionByName(gone).coalesce(1).write.parquet(f"{folder}/feed")
    feed = sources.changes(lib.spark, f"{folder}/feed", changed.schema)
    streaming.into_store(feed, tables, f"{folder}/c1", derived=[kept.derived]).awaitTermination()
    # of the changed ones every second text is read again, of deleted photos too
    ids = media.where("mediaId % 10 = 0").select("mediaId", (F.col("dateModified") + 1).alias("dateModified"))
    again = texts.drop("dateModified").join(ids, "mediaId").withColumn("modelVersion", F.lit(MODEL)).select(*texts.columns)
    again.coalesce(1).write.parquet(f"{folder}/texts")
    streaming.texts_into_store(sources.changes(lib.spark, f"{folder}/texts", texts.schema), tables, f"{folder}/c2", derived=[kept.derived]).awaitTermination()
    now = tables.read("media_embeddings")
    return now.join(kept.matches(("the", "and"), now, MODEL), "mediaId", "left_semi").select("mediaId", "dateModified")


# photos that move to another album, go, and come
MOVED = {"dateModified": "dateModified + 1", "bucketId": "'moved'", "bucketName": "'Moved'"}
CAME = {"mediaId": "mediaId + 1000000", "uri": "'new_' || CAST(mediaId AS STRING)"}
AFTERWARDS = f"SELECT * REPLACE ({', '.join(f'CASE WHEN mediaId % 6 = 0 THEN {e} ELSE {c} END AS {c}' for c, e in MOVED.items())}) FROM before WHERE mediaId % 7 <> 0 UNION ALL SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in CAME.items())}) FROM before WHERE mediaId % 10 = 0"


@query(f"WITH before AS ({VIEWS['media']}), media AS ({AFTERWARDS})" + registry.SQL["album_catalog"].removeprefix(f"WITH media AS ({VIEWS['media']})"))
def kept_album_catalog(lib):
    """The catalog from kept parts, after a stream moved, deleted and added photos, covers among them."""
    folder = scratch(lib.spark)
    tables = Store(lib.spark, f"{folder}/store", buckets=8)
    kept = albums.kept_parts(tables.bucket)
    media = lib.media.drop("embedding")
    empty = {name: lib.spark.createDataFrame([], schema) for name, schema in (("photo_text", schemas.PHOTO_TEXT), ("face_index", schemas.FACE_INDEX), ("face_embeddings", schemas.FACES))}
    tables.publish({"media_embeddings": media, "album_parts": kept.make(media), **empty})
    alive = F.lit(False).alias("gone")
    moved = media.where("mediaId % 6 = 0").selectExpr(*(f"{MOVED.get(c, c)} AS {c}" for c in media.columns)).select("*", alive)
    came = media.where("mediaId % 10 = 0").selectExpr(*(f"{CAME.get(c, c)} AS {c}" for c in media.columns)).select("*", alive)
    gone = media.where("mediaId % 7 = 0").withColumns({"dateModified": F.col("dateModified") + 2, "gone": F.lit(True)})
    moved.unionByName(came).unionByName(gone).coalesce(1).write.parquet(f"{folder}/feed")
    feed = sources.changes(lib.spark, f"{folder}/feed", gone.schema)
    streaming.into_store(feed, tables, f"{folder}/checkpoint", derived=[kept]).awaitTermination()
    rows = albums.build_kept(tables.read("album_parts"), tables.read("media_embeddings"), NOW_MILLIS).withColumn("position", F.monotonically_increasing_id())
    return rows.withColumn("position", F.row_number().over(Window.orderBy("position"))).select("id", "name", "count", "coverUri", "position")  # an album a row


@query("SELECT mediaId, dateModified, 'before' AS side FROM media WHERE mediaId % 90 = 0 OR mediaId % 77 = 0 UNION ALL SELECT mediaId, dateModified + 1, 'after' FROM media WHERE mediaId % 90 = 0 AND mediaId % 77 <> 0", "media")
def snapshot_changes(lib):
    """What two snapshots differ in, sought in the buckets whose digests differ."""
    after = lib.media.where("mediaId % 77 <> 0").withColumn("dateModified", F.when(F.col("mediaId") % 90 == 0, F.col("dateModified") + 1).otherwise(F.col("dateModified")))
    return planning.snapshot_changes(lib.media, after)


@query("SELECT mediaId, uri FROM media WHERE embeddingDimension > 0 ORDER BY mediaId LIMIT 64 OFFSET 128", "media")
def seek_page(lib):
    """The third page of 64 by cursor, from files sorted by id."""
    pages = paging.Pages.saved(lib.media.drop("embedding"), scratch(lib.spark))
    cursor = None
    for _ in range(2):
        last = pages.after(cursor, Filters(), 64).agg(F.max("mediaId")).first()[0]
        cursor = cursor if last is None else last  # a library of fewer pages ends here
    return pages.after(cursor, Filters(), 64).select("mediaId", "uri")


LATER = "CASE WHEN m.mediaId % 5 = 0 THEN 1 ELSE 0 END"


@query(f"""SELECT unnest(['photos', 'faces', 'texts']) AS name, unnest([photos, faces, texts]) AS n FROM (
  SELECT count(*) AS photos, count(*) FILTER (f.dateModified = m.dateModified + {LATER} AND f.modelVersion = 'v1') AS faces, count(*) FILTER (t.dateModified = m.dateModified + {LATER} AND t.modelVersion = 'v1') AS texts
  FROM media m LEFT JOIN face_index f ON m.mediaId = f.mediaId LEFT JOIN photo_text t ON m.mediaId = t.mediaId WHERE m.mediaId % 7 <> 0)""", "media", "face_index", "photo_text")
def stream_valid_counts(lib):
    """Photos and those with valid faces and texts, after revisions and deletions took some back."""
    folder = scratch(lib.spark)
    media = lib.media.select("mediaId", "dateModified")
    feeds = [live.changes_of("photos", media), live.changes_of("faces", lib.face_index), live.changes_of("texts", lib.photo_text)]
    # in the second batch every fifth photo has a new revision and every seventh goes, in the first some rows that are older
    later = live.changes_of("photos", media.where("mediaId % 5 = 0").withColumn("dateModified", F.col("dateModified") + 1))
    gone = live.changes_of("photos", media.where("mediaId % 7 = 0").withColumns({"dateModified": F.col("dateModified") + 2, "gone": F.lit(True)}))
    first = feeds[0].where("mediaId % 3 = 0").unionByName(feeds[1]).unionByName(gone.where("mediaId % 2 = 0"))
    second = feeds[0].where("mediaId % 3 <> 0").unionByName(feeds[2]).unionByName(later).unionByName(gone.where("mediaId % 2 = 1"))
    for k, rows in enumerate((first, second)):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live.counted(sources.changes(lib.spark, f"{folder}/in", first.schema), f"{folder}/live", MODEL, MODEL).awaitTermination()
    return live.totals(lib.spark, f"{folder}/live", k)


# --- many queries and two growing sides (V5, O1, O3, J9) ---

ASKED = "vec_id % 20 = 0"
BOUNDS = {"startMillis": "CASE WHEN vec_id % 3 = 0 THEN 1704067200000 + vec_id * 1800000 END", "endMillis": "CASE WHEN vec_id % 4 = 0 THEN 1704067200000 + vec_id * 7200000 END", "mediaType": "CASE WHEN vec_id % 7 = 0 THEN 'IMAGE' END"}
TIME = "coalesce(m.dateTaken, m.dateAdded * 1000)"


@query(f"""SELECT q.vec_id AS queryId, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, {RANK_TIME} DESC, mediaId DESC) AS INT) AS position, mediaId, round(s, 6) AS similarity FROM (
  SELECT q.vec_id, m.*, list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s
  FROM (SELECT vec_id, embedding, {", ".join(f"{e} AS {c}" for c, e in BOUNDS.items())} FROM embeddings WHERE {ASKED}) q JOIN media m
    ON m.embeddingDimension = 64 AND (q.startMillis IS NULL OR {TIME} >= q.startMillis) AND (q.endMillis IS NULL OR {TIME} < q.endMillis) AND (q.mediaType IS NULL OR m.mediaType = q.mediaType)) q
QUALIFY position <= 10""", "media")
def many_queries_topk(lib):
    """V5, O3: a query with dates and a type of its own for every twentieth vector, against all photos in one reading."""
    asked = lib.table("embeddings").where(ASKED).selectExpr("vec_id AS queryId", "embedding AS vector", *(f"{e} AS {c}" for c, e in BOUNDS.items()))
    found = many.search_many(lib.media, asked, 10, 64)
    return found.select("queryId", "position", "mediaId", F.round("rawSimilarity", 6).alias("similarity"))


@query("""SELECT p.id AS left_id, f.vec_id AS right_id, round(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) AS score
FROM people p JOIN embeddings f ON list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) >= 0.4""", "people")
def similarity_join_whole(lib):
    """Every stored person against every face, both sides whole."""
    people, faces = lib.people.select("id", "embedding"), lib.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = pivots.similarity_join(people, faces, 0.4, 64)
    return found.select("left_id", "right_id", F.round("score", 6).alias("score"))


# --- co-located tables (J1, J4-J6, A1-A3, S6, S7) ---


def in_buckets(lib, name: str, df: DataFrame, key: str = "mediaId") -> DataFrame:
    return colocated.save(df, f"prismlake_{name}_{uuid.uuid4().hex}", scratch(lib.spark), 8, key)


def colocated_plan(lib) -> DataFrame:
    library = in_buckets(lib, "library", lib.media.select("mediaId", "dateModified"))
    stored = in_buckets(lib, "stored", lib.stored)
    faces = in_buckets(lib, "faces", lib.face_index)
    texts = in_buckets(lib, "texts", lib.photo_text.select("mediaId", "dateModified", "modelVersion"))
    return planning.whole_plan(library, stored, faces, texts, MODEL, MODEL)


PLANNED = """SELECT coalesce(m.mediaId, s.mediaId) AS mediaId,
  CASE WHEN m.mediaId IS NULL THEN 'deleted' WHEN s.mediaId IS NULL THEN 'new' WHEN s.dateModified <> m.dateModified THEN 'changed' WHEN s.embeddingDimension = 0 THEN 'pending' ELSE 'unchanged' END AS work,
  m.mediaId IS NOT NULL AND coalesce(f.dateModified = m.dateModified AND f.modelVersion = 'v1', false) AS faceValid, m.mediaId IS NOT NULL AND coalesce(t.dateModified = m.dateModified AND t.modelVersion = 'v1', false) AS textValid,
  m.mediaId IS NOT NULL AND NOT coalesce(f.dateModified = m.dateModified AND f.modelVersion = 'v1', false) AS facePending, m.mediaId IS NOT NULL AND NOT coalesce(t.dateModified = m.dateModified AND t.modelVersion = 'v1', false) AS textPending
FROM media m LEFT JOIN face_index f ON m.mediaId = f.mediaId LEFT JOIN photo_text t ON m.mediaId = t.mediaId FULL JOIN stored s ON m.mediaId = s.mediaId"""
ROLES = ("media", "face_index", "photo_text", "stored")


@query(PLANNED, *ROLES)
def whole_index_plan(lib):
    """All of a pass's work in one reading of co-located tables."""
    return colocated_plan(lib)


@query(f"SELECT count(*) FILTER (work <> 'deleted') AS total, {', '.join(f'''count(*) FILTER (work = '{w}') AS {w}''' for w in ('new', 'changed', 'pending', 'deleted'))}, count(*) FILTER (faceValid) AS facesValid, count(*) FILTER (textValid) AS textsValid FROM ({PLANNED})", *ROLES)
def whole_plan_counts(lib):
    return planning.plan_counts(colocated_plan(lib))


@query("SELECT id, name, handle FROM people WHERE handle IN ('p_3', 'p_17', 'p_x')", "people")
def bucket_lookup(lib):
    """People by handle; only their buckets are opened."""
    people = in_buckets(lib, "people", lib.people.select("id", "name", "handle"), "handle")
    return colocated.lookup(people, ["p_3", "p_17", "p_x"], "handle")


# --- progress of a pass while it runs (R3, R10) ---

VISUAL, FACES, TEXT = "(m.mediaId NOT IN (SELECT mediaId FROM stored))", "(m.mediaId % 4 = 0)", "(m.mediaId % 3 = 0)"


@query(f"""SELECT unnest(range(11)) AS step, unnest([1, 2, 3, 1, 1, 1, 2, 2, 3, 3, 3]) AS id, unnest([0, 0, 0, n - a, n, n, n - b, n - b, n - c, n - cf, n - cf]) AS processed, n AS total,
  unnest([0, 0, 0, 0, af, af, 0, 0, 0, cf, cf]) AS failed, unnest(['QUEUED', 'QUEUED', 'QUEUED', 'RUNNING', 'RUNNING', if(af > 0, 'INTERRUPTED', 'COMPLETE'), 'RUNNING', 'UNAVAILABLE', 'RUNNING', 'RUNNING', if(cf > 0, 'INTERRUPTED', 'COMPLETE')]) AS status
FROM (SELECT count(*) AS n, count(*) FILTER ({VISUAL}) AS a, count(*) FILTER ({VISUAL} AND m.mediaId % 5 = 0) AS af, count(*) FILTER ({FACES}) AS b, count(*) FILTER ({TEXT}) AS c, count(*) FILTER ({TEXT} AND m.mediaId % 5 = 0) AS cf FROM media m)""", "stored")
def staged_progress(lib):
    """The rows that others see while three stages run, of which the second's model is missing."""

    def work(rows: DataFrame) -> DataFrame:
        failing = F.when(F.col("mediaId") % 5 == 0, F.lit("unreadable"))
        return rows.withColumn("result", F.struct(F.when(failing.isNull(), F.array(F.lit(1.0))).alias("value"), failing.alias("error")))

    def missing(rows: DataFrame) -> DataFrame:
        raise RuntimeError("the model is missing")

    stages = [
        planning.Stage("visual", lambda now: now.join(lib.stored.select("mediaId"), "mediaId", "left_anti"), work, True),
        planning.Stage("faces", lambda now: now.where("mediaId % 4 = 0"), missing, False),
        planning.Stage("text", lambda now: now.where("mediaId % 3 = 0"), work, False),
    ]
    folder = scratch(lib.spark)
    planning.run_stages(lib.media.select("mediaId", "dateModified"), stages, f"{folder}/run", planning.progress_table(lib.spark, f"{folder}/progress"))
    return lib.spark.read.parquet(f"{folder}/progress").select("step", "id", "processed", "total", "failed", "status")


# --- what fails, as rows (D7, J10, P17, U5, X15) ---


@query("SELECT 'search_history' AS name, 0 AS n UNION ALL SELECT 'index_progress', (SELECT count(*) FROM events WHERE event_id % 3 = 0)")
def history_cleared(lib):
    """Of two tables of one version only the history is empty afterwards."""
    tables = Store(lib.spark, scratch(lib.spark))
    tables.publish({"search_history": lib.history, "index_progress": lib.table("events").where("event_id % 3 = 0").select(F.col("event_id").alias("id"))})
    tables.publish({"search_history": store.clear(tables.read("search_history"))})
    counts = [tables.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in ("search_history", "index_progress")]
    return counts[0].unionByName(counts[1])


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN sha256(p_name) END AS sha256, CASE WHEN p_partkey % 7 = 0 THEN 'no checksum of p' || p_partkey WHEN p_partkey % 5 = 0 THEN 'wrong checksum of p' || p_partkey END AS error FROM part")
def asset_checks(lib):
    """A file for each part; some have another content than expected, some are not known."""
    files = lib.table("part").select("p_partkey", F.concat(F.lit("assets/p"), F.col("p_partkey")).alias("path"), F.encode("p_name", "UTF-8").alias("content"))
    expected = lib.table("part").where("p_partkey % 7 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), F.sha2(F.when(F.col("p_partkey") % 5 == 0, F.lit("other")).otherwise(F.col("p_name")), 256).alias("sha256"))
    return contracts.checksums(files, expected).select("p_partkey", "sha256", "error")


@query("SELECT mediaId, CASE WHEN mediaId % 13 = 0 THEN 'unknown mediaType: AUDIO' END AS error FROM media", "media")
def unknown_types(lib):
    """Which rows have a type that isn't known."""
    rows = lib.media.withColumn("mediaType", F.when(F.col("mediaId") % 13 == 0, F.lit("AUDIO")).when(F.col("mediaId") % 17 == 1, F.lit(None)).otherwise(F.col("mediaType")))
    return schemas.split_allowed(rows, "mediaType").select("mediaId", "error")


TYPED = "'@P_' || CAST(event_id % 700 AS STRING) || ' near @p_' || CAST(event_id % 53 AS STRING) || CASE WHEN event_id % 4 = 0 THEN ' or @nobody, write me@p_1' ELSE '' END"


@query(f"""SELECT e AS id, CASE WHEN unknown <> '' THEN 'unknown ' || unknown WHEN old <> '' THEN 'update the face photo of ' || old END AS error, CASE WHEN unknown = '' AND old = '' THEN n ELSE 0 END AS people FROM (
  SELECT e, coalesce(string_agg('@' || h, ', ' ORDER BY i) FILTER (p.id IS NULL), '') AS unknown, coalesce(string_agg('@' || h, ', ' ORDER BY i) FILTER (p.id IS NOT NULL AND p.embeddingModel <> 'v1'), '') AS old, count(*) AS n
  FROM (SELECT event_id AS e, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (
    SELECT event_id, list_distinct_in_order AS hs FROM (SELECT event_id, list_filter(hs, lambda x, k: list_position(hs, x) = k) AS list_distinct_in_order FROM (
      SELECT event_id, ['p_' || CAST(event_id % 700 AS STRING), 'p_' || CAST(event_id % 53 AS STRING)] || CASE WHEN event_id % 4 = 0 THEN ['nobody'] ELSE [] END AS hs FROM events)))) x
  LEFT JOIN people p ON p.handle = x.h GROUP BY e)""", "people")
def asked_people(lib):
    """Every event as a typed query: whom it mentions, and what is said of them."""
    asked = lib.table("events").selectExpr("event_id AS id", f"{TYPED} AS query")
    return asking.asked_people(asked, lib.people, MODEL).select("id", "error", F.coalesce(F.size("people"), F.lit(0)).cast("long").alias("people"))


PERSON = "CASE WHEN p.id IS NULL THEN 'unknown @' || h WHEN p.embeddingModel <> 'v1' THEN 'update the face photo of @' || h ELSE '{0}' END"
# what is typed, by the event's number: query, mode, reference photo, answer
KINDS = [
    ("'a beach'", "NORMAL", False, "'vector'"), ("''", "NORMAL", True, "'vector'"), ("NULL", "NORMAL", False, "'enter a prompt, a person or a reference photo'"),
    ("'@P_' || CAST(event_id % 700 AS STRING)", "NORMAL", False, PERSON.format("people")), ("'by @ the sea'", "NORMAL", False, "'enter a saved name after @'"),
    ("'The ' || event_type || '!'", "OCR", False, "'words the ' || replace(event_type, '_', ' ')"), ("'the sea'", "OCR", True, "'text search takes no reference photo'"),
    ("' !? '", "OCR", False, "'enter the words to look for'"), ("'@p_' || CAST(event_id % 700 AS STRING) || ' menu'", "OCR", False, PERSON.format("people words menu")),
    ("'@' || repeat('a', 41)", "NORMAL", True, "'use 1 to 40 letters, numbers or underscores for a name'"),
]


def by_kind(values) -> str:
    return "CASE " + " ".join(f"WHEN event_id % {len(KINDS)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query(f"SELECT event_id AS id, {by_kind(a for *_, a in KINDS)} AS answer FROM (SELECT event_id, event_type, 'p_' || CAST(event_id % 700 AS STRING) AS h FROM events) e LEFT JOIN people p ON p.handle = h", "people")
def typed_checks(lib):
    """Every event as a typed search: what is said of it before anything is encoded."""
    asked = lib.table("events").selectExpr("event_id AS id", f"{by_kind(q for q, *_ in KINDS)} AS query", f"{by_kind(repr(m) for _, m, *_ in KINDS)} AS mode", f"{by_kind(str(r).lower() for *_, r, _ in KINDS)} AS reference")
    rows = asking.checked(asked, lib.people, MODEL)
    parts = F.array(F.when(F.size("people") > 0, "people"), F.when(F.col("wantsVector"), "vector"), F.when(F.size("words") > 0, F.concat(F.lit("words "), F.array_join("words", " "))))
    return rows.select("id", F.coalesce("error", F.array_join(parts, " ")).alias("answer"))
