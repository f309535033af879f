"""The registered queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.datasets import MODEL, NOW_MILLIS, Library
from prismlake.functions import faces as face_functions
from prismlake.functions import scalars, text, vectors
from prismlake.operators import albums, planning, search, store
from prismlake.plans.query import Filters, Query
from prismlake.registry import QUERIES, SQL, query
from prismlake.sources import library as sources
from prismlake.streaming import index as streaming

__all__ = ["QUERIES", "SQL"]

TOP = 20
START, END = 1704067200000 + 100 * 3600000, 1704067200000 + 400 * 3600000
# the query's vector is a unit vector
DOT = "(SELECT list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(q, q)) FROM (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {0}) _q)"
FILTER_TIME, RANK_TIME = "coalesce(dateTaken, dateAdded * 1000)", "coalesce(dateTaken, coalesce(dateAdded, 0) * 1000)"


def shown(rows: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """At most ``TOP`` results, with their place."""
    order = search.relevance() if filters.sort == "MOST_RELEVANT" else search.chronology(filters.sort == "NEWEST_FIRST")
    return search.with_position(rows, order).select("position", "mediaId", F.round("rawSimilarity", 6).alias("similarity"))


def vector_of(lib: Library, vec_id: int) -> tuple[float, ...]:
    return tuple(vectors.unit(lib.vector(vec_id)))


# --- top k (V2, V5, V6, O1-O5, P1-P5, P9, P12, S5) ---


@query(f"""
SELECT row_number() OVER (ORDER BY s DESC, {RANK_TIME} DESC, mediaId DESC) AS position, mediaId, round(s, 6) AS similarity
FROM (SELECT *, {DOT.format(0)} AS s FROM media WHERE embeddingDimension = 64) ORDER BY 1 LIMIT {TOP}""", "media")  # fmt: skip
def vector_topk(lib):
    return shown(search.search(lib.media, Query(vector=vector_of(lib, 0), limit=TOP)))


@query(f"""
SELECT row_number() OVER (ORDER BY s DESC, {RANK_TIME} DESC, mediaId DESC) AS position, mediaId, round(s, 6) AS similarity
FROM (SELECT *, {DOT.format(3)} AS s FROM media WHERE embeddingDimension = 64 AND mediaType = 'IMAGE' AND {FILTER_TIME} >= {START} AND {FILTER_TIME} < {END})
ORDER BY 1 LIMIT {TOP}""", "media")  # fmt: skip
def vector_topk_filtered(lib):
    return shown(search.search(lib.media, Query(Filters(START, END, "IMAGE"), vector_of(lib, 3), limit=TOP)))


@query(f"""
SELECT row_number() OVER (ORDER BY {RANK_TIME} DESC, mediaId DESC) AS position, mediaId, round(s, 6) AS similarity
FROM (SELECT *, {DOT.format(5)} AS s FROM media WHERE embeddingDimension = 64 ORDER BY s DESC, {RANK_TIME} DESC, mediaId DESC LIMIT {TOP})""", "media")  # fmt: skip
def topk_then_newest(lib):
    filters = Filters(sort="NEWEST_FIRST")
    return shown(search.search(lib.media, Query(filters, vector_of(lib, 5), limit=TOP)), filters)


# the words that text queries look for; ids of documents stand for those of photos
WORDS = ("the", "of")
VALID_TEXT = """SELECT p.mediaId FROM photo_text p JOIN media m ON p.mediaId = m.mediaId AND p.dateModified = m.dateModified WHERE p.modelVersion = 'v1'"""
TOKENS = "string_split(trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"


def ocr_ids(lib: Library, words=WORDS) -> DataFrame:
    return search.text_matches(lib.photo_text, lib.media, words, MODEL)


@query(f"""
SELECT row_number() OVER (ORDER BY {RANK_TIME} DESC, mediaId DESC) AS position, mediaId, CAST(0 AS DOUBLE) AS similarity FROM media
WHERE mediaId IN (SELECT p.mediaId FROM photo_text p JOIN media m ON p.mediaId = m.mediaId AND p.dateModified = m.dateModified
                  WHERE p.modelVersion = 'v1' AND list_has_all({TOKENS}, ['the', 'of']))
ORDER BY 1 LIMIT {TOP}""", "media", "photo_text")  # fmt: skip
def ocr_newest_topk(lib):
    filters = Filters(sort="NEWEST_FIRST", mode="OCR")
    return shown(search.search(lib.media, Query(filters, words=WORDS, limit=TOP), text_ids=ocr_ids(lib)), filters)


@query(f"""
SELECT row_number() OVER (ORDER BY {RANK_TIME}, mediaId) AS position, mediaId, CAST(0 AS DOUBLE) AS similarity FROM media
WHERE {FILTER_TIME} >= {START} AND mediaId IN (SELECT p.mediaId FROM photo_text p JOIN media m ON p.mediaId = m.mediaId AND p.dateModified = m.dateModified
                  WHERE p.modelVersion = 'v1' AND list_has_all({TOKENS}, ['the', 'of']))
ORDER BY 1 LIMIT {TOP}""", "media", "photo_text")  # fmt: skip
def ocr_oldest_topk(lib):
    filters = Filters(START, sort="OLDEST_FIRST", mode="OCR")
    return shown(search.search(lib.media, Query(filters, words=WORDS, limit=TOP), text_ids=ocr_ids(lib)), filters)


UNIT = "(SELECT list(x / n ORDER BY i) FROM (SELECT x, i, sqrt(list_dot_product(v, v)) AS n FROM (SELECT CAST(embedding AS DOUBLE[]) AS v, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id = {0})))"


@query(f"""
SELECT row_number() OVER (ORDER BY s DESC, {RANK_TIME} DESC, mediaId DESC) AS position, mediaId, round(s, 6) AS similarity
FROM (SELECT *, list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) FROM (
  SELECT list_transform(generate_series(1, 64), lambda i: 0.5 * t[i] + 0.25 * a[i] + 0.25 * b[i]) AS c FROM (SELECT {UNIT.format(1)} AS t, {UNIT.format(2)} AS a, {UNIT.format(4)} AS b)))) AS s
  FROM media WHERE embeddingDimension = 64) ORDER BY 1 LIMIT {TOP}""", "media")  # fmt: skip
def composed_query_topk(lib):
    return shown(search.search(lib.media, Query(vector=tuple(vectors.compose(lib.vector(1), [lib.vector(2), lib.vector(4)])), limit=TOP)))


@query(f"""
SELECT mediaId, {FILTER_TIME} AS at FROM media WHERE {FILTER_TIME} >= 1704585600000 AND {FILTER_TIME} < 1705190400000""", "media")  # fmt: skip
def relative_date_filter(lib):
    """THIS_WEEK of 10 January 2024 in a zone where weeks begin on Sunday."""
    start, end = scalars.date_bounds("THIS_WEEK", 1704888000000, "UTC", first_weekday=6)
    return search.candidates(lib.media, Filters(start, end, mode="OCR")).select("mediaId", scalars.filter_time().alias("at"))


@query("SELECT mediaId, uri FROM media WHERE embeddingDimension > 0 ORDER BY mediaId LIMIT 64 OFFSET 128", "media")
def paged_scan(lib):
    return search.page(lib.media, Filters(), 64, 128).select("mediaId", "uri")


@query(f"""
SELECT t.mediaId, round(s, 6) AS similarity FROM (SELECT *, {DOT.format(8)} AS s FROM media WHERE embeddingDimension = 64
  ORDER BY s DESC, {RANK_TIME} DESC, mediaId DESC LIMIT {TOP}) t SEMI JOIN stored ON t.mediaId = stored.mediaId AND t.dateModified = stored.dateModified""", "media", "stored")  # fmt: skip
def library_consistency(lib):
    found = search.search(lib.media, Query(vector=vector_of(lib, 8), limit=TOP))
    return search.still_there(found, lib.stored).select("mediaId", F.round("rawSimilarity", 6).alias("similarity"))


@query("SELECT mediaId, uri, dateModified FROM media WHERE mediaId = 7", "media")
def point_lookup(lib):
    return store.by_id(lib.media, 7).select("mediaId", "uri", "dateModified")


# --- text (X1-X14, A9) ---


@query(f"SELECT doc_id AS mediaId FROM documents WHERE list_has_all({TOKENS}, ['the', 'of'])")
def text_match_all_terms(lib):
    return lib.photo_text.where(text.has_all(text.tokens(F.col("searchText")), WORDS)).select("mediaId")


@query(f"SELECT doc_id AS mediaId FROM (SELECT doc_id, unnest({TOKENS}) AS w FROM documents) WHERE w IN ('the', 'of', 'in') GROUP BY doc_id HAVING count(DISTINCT w) = 3")
def text_postings(lib):
    return search.text_matches_by_postings(search.words_of(lib.photo_text), ("the", "of", "in"))


@query("SELECT doc_id AS mediaId, trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS folded FROM documents")
def fold_text(lib):
    return lib.photo_text.select("mediaId", F.col("searchText").alias("folded"))


MENTION_TEXT = "'@User_' || CAST(user_id AS STRING) || ' near, ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' and @USER_' || CAST(user_id AS STRING) || '! ?' WHEN event_id % 3 = 1 THEN ' to me@mail.org' ELSE ' x@@y with @Ann' END"


@query(f"""SELECT event_id, array_to_string(list_distinct_in_order, ',') AS handles FROM (
  SELECT event_id, list_filter(h, lambda x, i: list_position(h, x) = i) AS list_distinct_in_order FROM (
    SELECT event_id, regexp_extract_all(lower(t), '(^|[^\\p{{L}}\\p{{N}}_@])@([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', 2) AS h FROM (SELECT event_id, {MENTION_TEXT} AS t FROM events)))""")
def mentions(lib):
    return lib.table("events").selectExpr("event_id", f"{MENTION_TEXT} AS t").select("event_id", F.array_join(text.mentions(F.col("t")), ",").alias("handles"))


@query(f"""SELECT event_id, trim(trim(trim(regexp_replace(regexp_replace(t, '(^|[^\\p{{L}}\\p{{N}}_@])@([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', '\\1 ', 'g'), '\\s+', ' ', 'g')), ',.!?;:')) AS rest
FROM (SELECT event_id, {MENTION_TEXT} AS t FROM events)""")
def mention_cleanup(lib):
    return lib.table("events").selectExpr("event_id", f"{MENTION_TEXT} AS t").select("event_id", text.without_mentions(F.col("t")).alias("rest"))


@query("""SELECT c_custkey, CASE WHEN regexp_full_match(h, '[\\p{L}\\p{N}_]{1,40}') THEN h END AS handle
FROM (SELECT c_custkey, regexp_replace(lower(trim(c_mktsegment || ' ' || CAST(c_custkey % 7 AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN '!' ELSE '' END)), '\\s+', '_', 'g') AS h FROM customer)""")
def handles(lib):
    name = F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 7).cast("string"), F.when(F.col("c_custkey") % 5 == 0, "!").otherwise(""))
    return lib.table("customer").select("c_custkey", text.handle(name).alias("handle"))


@query("SELECT id, handle FROM people WHERE starts_with(handle, 'p_1') ORDER BY handle LIMIT 6", "people")
def handle_autocomplete(lib):
    return store.suggestions(lib.people, "P_1").select("id", "handle")


@query(f"""SELECT doc_id AS mediaId, len(d) AS n_words, sha256(array_to_string(d, ' ')) AS words_sha256 FROM (
  SELECT doc_id, list(w ORDER BY i) AS d FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) WHERE w <> '' GROUP BY doc_id, w) GROUP BY doc_id)""")
def ordered_distinct_tokens(lib):
    words = text.tokens(F.col("searchText"))
    return lib.photo_text.select("mediaId", F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("words_sha256")).where("n_words > 0")


@query("SELECT doc_id AS mediaId, substr(text, 1, 500) AS text, length(text) > 500 AS truncated FROM documents")
def truncate_text(lib):
    first, more = text.truncated(F.col("text"), 500)
    return lib.table("documents").select(F.col("doc_id").alias("mediaId"), first.alias("text"), more.alias("truncated"))


@query("""SELECT mediaId, (CASE WHEN trim(b) = '' THEN 'Photo' ELSE b END) || '-copy-' || s || '.' || (CASE WHEN mimeType = 'image/jpeg' THEN 'jpg' WHEN e <> '' THEN e ELSE 'img' END) AS name
FROM (SELECT mediaId, mimeType, substr(regexp_replace(CASE WHEN contains(displayName, '.') THEN regexp_extract(displayName, '^(.*)\\.[^.]*$', 1) ELSE displayName END, '[\\x00-\\x1f\\x7f/\\\\]', '_', 'g'), 1, 80) AS b,
  regexp_extract(displayName, '\\.([A-Za-z0-9]{1,10})$', 1) AS e, substr(md5(CAST(mediaId AS VARCHAR)), 1, 8) AS s FROM media)""", "media")
def file_name_builder(lib):
    return lib.media.select("mediaId", text.copy_name(F.col("displayName"), F.col("mimeType"), F.md5(F.col("mediaId").cast("string"))).alias("name"))


@query("SELECT id, CASE WHEN searchMode IN ('OCR', 'TEXT_IN_PHOTOS') THEN 'OCR' ELSE 'NORMAL' END AS mode FROM history", "history")
def legacy_mode(lib):
    return lib.history.select("id", text.stored_mode(F.col("searchMode")).alias("mode"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_checksums(lib):
    return lib.table("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


_PLAIN = "replace(replace(replace({0}, '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"


@query(f"SELECT page_id, lower(trim(regexp_replace({_PLAIN.format(_PLAIN.format('nfc_normalize(html)'))}, '\\s+', ' ', 'g'))) AS clean FROM pages")
def clip_clean(lib):
    """Cleaned text of whole web pages; the SQL knows the entities of the pages, which have no wrongly decoded text."""
    return lib.table("pages").select("page_id", text.cleaned(F.col("html")).alias("clean"))


@query()
def bpe_tokens(lib):
    """77 ids of each document by a public vocabulary with word ends; tests hold it against the tokenizers library."""
    import public_tokenizers

    tokenizer = text.public_pairs(public_tokenizers.path("word_bpe_49k.json"))
    return lib.table("documents").select("doc_id", text.token_ids(tokenizer)(F.col("text")).alias("ids"))


# --- albums (A4-A6, E5, O6-O8, P10, P11, S1) ---

SCAN = "dateTaken DESC NULLS LAST, dateAdded DESC NULLS LAST, mediaId DESC"
CUTOFF = scalars.recent_cutoff(NOW_MILLIS)
RECENT = f"coalesce(dateAdded, 0) >= {CUTOFF}"


@query(f"""SELECT bucketId AS id, bucketName AS name, count(*) AS count, first(uri ORDER BY {SCAN}) AS coverUri FROM media
WHERE bucketId IS NOT NULL AND bucketName IS NOT NULL AND trim(bucketName) <> '' GROUP BY bucketId, bucketName""", "media")
def album_rollup(lib):
    return albums.bucket_albums(lib.media).select("id", "name", "count", "coverUri")


@query(f"SELECT mediaId, coalesce(dateAdded, 0) AS added FROM media WHERE {RECENT} ORDER BY 2 DESC, 1 DESC", "media")
def recently_added(lib):
    return albums.photos_for(albums.RECENT, lib.media, NOW_MILLIS).select("mediaId", F.coalesce("dateAdded", F.lit(0)).alias("added"))


@query(f"""SELECT 'all' AS id, count(*) AS count, first(uri ORDER BY {SCAN}) AS coverUri FROM media HAVING count(*) > 0
UNION ALL SELECT 'recent', count(*), first(uri ORDER BY coalesce(dateAdded, 0) DESC, {SCAN}) FROM media WHERE {RECENT} HAVING count(*) > 0""", "media")
def system_albums(lib):
    return albums.system_albums(lib.media, NOW_MILLIS).select("id", "count", "coverUri")


@query(f"""SELECT id, name, n AS count, coverUri, position FROM (
  SELECT *, row_number() OVER (ORDER BY rank, n DESC, p) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, n DESC, p) AS k FROM (
      SELECT 0 AS rank, 'all' AS id, 'All Photos' AS name, count(*) AS n, first(uri ORDER BY p) AS coverUri, 0 AS p FROM s
      UNION ALL SELECT 1, 'recent', 'Recently Added', count(*), first(uri ORDER BY coalesce(dateAdded, 0) DESC, p), 0 FROM s WHERE {RECENT}
      UNION ALL SELECT 2, bucketId, bucketName, count(*), first(uri ORDER BY p), min(p) FROM s WHERE bucketId IS NOT NULL AND trim(coalesce(bucketName, '')) <> '' GROUP BY bucketId, bucketName)
    WHERE n > 0) WHERE k = 1)""".replace("FROM s", f"FROM (SELECT *, row_number() OVER (ORDER BY {SCAN}) AS p FROM media) s"), "media")
def album_catalog(lib):
    rows = albums.build(lib.media, NOW_MILLIS).withColumn("position", F.monotonically_increasing_id())
    return rows.withColumn("position", F.row_number().over(Window.orderBy("position"))).select("id", "name", "count", "coverUri", "position")  # an album a row


@query(f"SELECT row_number() OVER (ORDER BY {SCAN}) AS position, mediaId, dateTaken FROM media ORDER BY 1 LIMIT 12", "media")
def library_scan(lib):
    """The newest of a source's rows, read through the tolerant reader."""
    raw = lib.media.withColumn("_id", F.col("mediaId")).drop("mediaId", "uri", "mediaType", "embedding", "embeddingDimension")
    rows = sources.from_rows(raw).orderBy(*albums.scan_order()).limit(12)
    return search.with_position(rows, albums.scan_order()).select("position", "mediaId", "dateTaken")


# --- planning and the store (R1, R2, D1-D9, J1-J6, J13, E1-E3, P15, W1, W4) ---

STATE = "FROM media m LEFT JOIN stored s ON m.mediaId = s.mediaId"


@query(f"SELECT m.mediaId {STATE} WHERE s.mediaId IS NULL", "stored")
def index_plan_new(lib):
    return planning.classify(lib.media, lib.stored).where("work = 'new'").select("mediaId")


@query(f"SELECT m.mediaId, CASE WHEN s.dateModified IS DISTINCT FROM m.dateModified THEN 'changed' ELSE 'pending' END AS work {STATE} WHERE s.mediaId IS NOT NULL AND (s.dateModified <> m.dateModified OR s.embeddingDimension = 0)", "stored")
def index_plan_changed(lib):
    return planning.classify(lib.media, lib.stored).where("work IN ('changed', 'pending')").select("mediaId", "work")


@query("SELECT mediaId FROM stored WHERE mediaId NOT IN (SELECT mediaId FROM media)", "stored")
def index_plan_deleted(lib):
    return planning.deleted(lib.media, lib.stored)


PENDING = "SELECT m.mediaId FROM media m LEFT JOIN face_index f ON m.mediaId = f.mediaId WHERE f.dateModified IS DISTINCT FROM m.dateModified OR f.modelVersion IS DISTINCT FROM 'v1'"


@query(PENDING, "media", "face_index")
def face_pending(lib):
    return planning.derived_pending(lib.media, lib.face_index, MODEL).select("mediaId")


@query("SELECT m.mediaId FROM media m LEFT JOIN photo_text f ON m.mediaId = f.mediaId WHERE f.dateModified IS DISTINCT FROM m.dateModified OR f.modelVersion IS DISTINCT FROM 'v1'", "media", "photo_text")
def text_pending(lib):
    return planning.derived_pending(lib.media, lib.photo_text.select("mediaId", "dateModified", "modelVersion"), MODEL).select("mediaId")


@query(f"SELECT m.mediaId {STATE} WHERE s.dateModified IS DISTINCT FROM m.dateModified OR s.embeddingDimension = 0 UNION SELECT * FROM ({PENDING})", "stored", "face_index")
def visual_pass(lib):
    return planning.visual_pass(lib.media, planning.to_embed(lib.media, lib.stored), planning.derived_pending(lib.media, lib.face_index, MODEL)).select("mediaId")


VALID_FACES = "FROM faces f JOIN face_index i ON f.mediaId = i.mediaId JOIN media m ON m.mediaId = i.mediaId AND m.dateModified = i.dateModified WHERE i.modelVersion = 'v1'"


@query(f"SELECT f.mediaId, f.faceIndex {VALID_FACES}", "media", "face_index")
def valid_faces(lib):
    scanned = store.valid_children(lib.face_index, lib.media, MODEL)
    return lib.faces.join(scanned.select("mediaId"), "mediaId", "left_semi").select("mediaId", "faceIndex")


@query("SELECT count(*) AS n FROM face_index i JOIN media m ON m.mediaId = i.mediaId AND m.dateModified = i.dateModified WHERE i.modelVersion = 'v1'", "media", "face_index")
def face_count(lib):
    return store.valid_children(lib.face_index, lib.media, MODEL).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM photo_text p JOIN media m ON m.mediaId = p.mediaId AND m.dateModified = p.dateModified WHERE p.modelVersion = 'v1'", "media", "photo_text")
def text_count(lib):
    return store.valid_children(lib.photo_text.drop("searchText"), lib.media, MODEL).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (embeddingDimension > 0) AS indexed, (SELECT count(*) FROM history) AS searches FROM media", "media", "history")
def index_counts(lib):
    searches = lib.history.agg(F.count("*").alias("searches"))
    return lib.media.agg(F.count_if(F.col("embeddingDimension") > 0).alias("indexed")).join(searches)


def stored_media(lib: Library) -> DataFrame:
    revision = F.col("dateModified") + F.when(F.col("mediaId") % 6 == 0, 1).when(F.col("mediaId") % 6 == 1, -1).otherwise(0)
    return lib.media.where("mediaId % 13 <> 0").select("mediaId", revision.cast("long").alias("dateModified"), "embeddingDimension", F.lit("stored").alias("origin"))


INCOMING = "SELECT mediaId, dateModified, embeddingDimension, 'incoming' AS origin FROM media WHERE mediaId % 2 = 0"
STORED_MEDIA = "SELECT mediaId, dateModified + CASE WHEN mediaId % 6 = 0 THEN 1 WHEN mediaId % 6 = 1 THEN -1 ELSE 0 END AS dateModified, embeddingDimension, 'stored' AS origin FROM media WHERE mediaId % 13 <> 0"


def incoming_media(lib: Library) -> DataFrame:
    return lib.media.where("mediaId % 2 = 0").select("mediaId", "dateModified", "embeddingDimension", F.lit("incoming").alias("origin"))


@query(f"SELECT mediaId, dateModified, embeddingDimension, origin FROM ({INCOMING} UNION ALL {STORED_MEDIA}) QUALIFY row_number() OVER (PARTITION BY mediaId ORDER BY dateModified DESC, origin) = 1", "media")
def gated_upsert(lib):
    return store.upsert_media(stored_media(lib), incoming_media(lib))


@query(f"SELECT mediaId, dateModified, CASE WHEN origin = 'incoming' THEN 0 ELSE embeddingDimension END AS embeddingDimension, origin FROM ({INCOMING} UNION ALL {STORED_MEDIA}) QUALIFY row_number() OVER (PARTITION BY mediaId ORDER BY dateModified DESC, origin DESC) = 1", "media")
def ensure_metadata(lib):
    return store.ensure_metadata(stored_media(lib), incoming_media(lib))


@query("SELECT mediaId, dateModified FROM photo_text SEMI JOIN media USING (mediaId, dateModified)", "media", "photo_text")
def derived_write_gate(lib):
    texts = lib.photo_text.select("mediaId", "dateModified", "modelVersion")
    return store.put_text(texts.where("false"), texts, lib.media).select("mediaId", "dateModified")


@query("SELECT mediaId, faceIndex FROM faces WHERE mediaId % 2 = 1 OR mediaId NOT IN (SELECT i.mediaId FROM face_index i JOIN media USING (mediaId, dateModified)) UNION ALL SELECT i.mediaId, 0 FROM face_index i JOIN media USING (mediaId, dateModified) WHERE i.mediaId % 4 = 2", "media", "face_index")
def replace_children(lib):
    """Even photos are scanned again: half of them have one face now, the others none."""
    states, faces = lib.face_index, lib.faces.select("mediaId", "faceIndex")
    again = states.where("mediaId % 2 = 0")
    new = again.where("mediaId % 4 = 2").select("mediaId", F.lit(0).alias("faceIndex"))
    return store.replace_faces(states, faces, again, new, lib.media)[1]


@query("SELECT 'media' AS t, count(*) AS n FROM media WHERE mediaId % 3 <> 0 UNION ALL SELECT 'faces', count(*) FROM faces WHERE mediaId % 3 <> 0 UNION ALL SELECT 'text', count(*) FROM photo_text WHERE mediaId % 3 <> 0 OR mediaId NOT IN (SELECT mediaId FROM media)", "media", "faces", "photo_text")
def cascade_delete(lib):
    gone = lib.media.where("mediaId % 3 = 0")
    left = store.delete_media({"media_embeddings": lib.media, "face_embeddings": lib.faces, "photo_text": lib.photo_text.select("mediaId")}, gone)
    counts = [left[name].agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t, name in (("media", "media_embeddings"), ("faces", "face_embeddings"), ("text", "photo_text"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT id, query, timestamp FROM history ORDER BY timestamp DESC, id DESC LIMIT 100", "history")
def history_latest_100(lib):
    old, new = lib.history.where("id % 2 = 0"), lib.history.where("id % 2 = 1")
    return store.add_history(old, new).select("id", "query", "timestamp")


@query("SELECT s.mediaId, s.dateModified, 'before' AS side FROM (SELECT mediaId, dateModified FROM stored EXCEPT ALL SELECT mediaId, dateModified FROM media) s UNION ALL SELECT m.mediaId, m.dateModified, 'after' FROM (SELECT mediaId, dateModified FROM media EXCEPT ALL SELECT mediaId, dateModified FROM stored) m", "stored")
def snapshot_diff(lib):
    return planning.snapshot_difference(lib.stored, lib.media)


@query("SELECT user_id AS mediaId, max(event_id) AS dateModified, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stream_latest_revision(lib):
    rows = lib.table("events").select(F.col("user_id").alias("mediaId"), F.col("event_id").alias("dateModified"), "event_type", "value")
    return streaming.latest_revision(rows)


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def live_counts(lib):
    return streaming.live_counts(lib.table("events"), "event_type")


@query("SELECT id, handle, embeddingModel = 'v1' AS ready, handle = 'p_7' AND id <> 3 AS duplicate FROM people", "people")
def person_flags(lib):
    return store.person_flags(lib.people, "p_7", 3, MODEL)


# --- vectors and faces (V1-V11, J8, J9, A7, A10, A13, P13, P14) ---


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def l2_norms(lib):
    return lib.table("embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("""SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3""")
def similarity_join(lib):
    rows = lib.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.similar_pairs(rows.where("id % 100 = 0"), rows, 0.3, 64).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query(f"""SELECT mediaId, round(s, 6) AS score FROM (SELECT f.mediaId, max(list_dot_product(CAST(f.embedding AS DOUBLE[]), q) / sqrt(list_dot_product(q, q))) AS s {VALID_FACES.replace('FROM faces f', 'FROM (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 30) CROSS JOIN faces f')} GROUP BY f.mediaId) WHERE s >= 0.2""", "media", "face_index")
def people_filter_single(lib):
    faces = search.face_lists(lib.faces, lib.face_index, lib.media, MODEL)
    score = face_functions.match_one(lib.vector(30), 0.2)(F.col("faces"))
    return faces.select("mediaId", F.round(score, 6).alias("score")).where("score is not null")


@query(f"SELECT f.mediaId, count(*) AS n, string_agg(CAST(f.faceIndex AS VARCHAR), ',' ORDER BY f.faceIndex) AS order_of_faces, round(sum(list_sum(CAST(f.embedding AS DOUBLE[]))), 5) AS checksum {VALID_FACES} GROUP BY f.mediaId", "media", "face_index")
def faces_grouped(lib):
    grouped = search.face_lists(lib.faces, lib.face_index, lib.media, MODEL)
    total = F.aggregate(F.flatten("faces"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    numbers = F.array_join(F.sequence(F.lit(0), F.size("faces") - 1), ",")
    return grouped.select("mediaId", F.size("faces").cast("long").alias("n"), numbers.alias("order_of_faces"), F.round(total, 5).alias("checksum"))


def detections(lib: Library) -> DataFrame:
    """Boxes from the line items: a photo for each order."""
    e = "l_orderkey AS mediaId, CAST(l_partkey % 500 AS FLOAT) AS left, CAST(l_suppkey % 400 AS FLOAT) AS top, CAST(l_partkey % 500 + l_quantity * 4 AS FLOAT) AS right, CAST(l_suppkey % 400 + l_quantity * 3 AS FLOAT) AS bottom, CAST(1 - l_discount * 5 AS FLOAT) AS score"
    boxes = lib.table("lineitem").selectExpr(*e.split(", "))
    points = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("left", "top"), ("right", "top"), ("left", "bottom"), ("right", "bottom"), ("left", "top"))))
    return boxes.select("mediaId", F.struct("left", "top", "right", "bottom", "score", points.alias("landmarks")).alias("face"))


@query("""SELECT l_orderkey AS mediaId, count(*) AS n FROM lineitem WHERE CAST(1 - l_discount * 5 AS FLOAT) >= 0.5 AND CAST(l_partkey % 500 + l_quantity * 4 AS FLOAT) - CAST(l_partkey % 500 AS FLOAT) >= 20
AND CAST(l_suppkey % 400 + l_quantity * 3 AS FLOAT) - CAST(l_suppkey % 400 AS FLOAT) >= 20 AND l_partkey % 500 < 450 AND l_suppkey % 400 < 350 GROUP BY l_orderkey""")
def detection_gate(lib):
    good = detections(lib).where(face_functions.plausible(F.col("face"), F.lit(450), F.lit(350)))
    return good.groupBy("mediaId").agg(F.count("*").alias("n"))


@query("""SELECT mediaId FROM (SELECT l_orderkey AS mediaId, count(*) AS n, min(CAST(1 - l_discount * 5 AS FLOAT)) AS s, min(CAST(l_partkey % 500 + l_quantity * 4 AS FLOAT) - CAST(l_partkey % 500 AS FLOAT)) AS w,
min(CAST(l_suppkey % 400 + l_quantity * 3 AS FLOAT) - CAST(l_suppkey % 400 AS FLOAT)) AS h FROM lineitem GROUP BY 1) WHERE n = 1 AND s >= 0.7 AND w >= 60 AND h >= 60""")
def enrollment_gate(lib):
    return face_functions.enrollable(detections(lib)).select("mediaId")


@query("SELECT vec_id, TRUE AS same, round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS dot FROM embeddings")
def codec_roundtrip(lib):
    rows = lib.table("embeddings").withColumn("blob", vectors.encode(F.col("embedding")))
    again = vectors.decode(F.col("blob"), F.size("embedding"))
    return rows.select("vec_id", (again == F.col("embedding")).alias("same"), F.round(vectors.encoded_dot(lib.vector(0))(F.col("blob"), F.size("embedding")), 6).alias("dot"))


COSINE = "list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-12)"


@query(f"""SELECT round(min({COSINE}), 9) AS min_cosine, round(avg({COSINE}), 9) AS mean_cosine, round(max(list_max(d)), 9) AS max_error, round(avg(list_sum(d) / 64), 9) AS mean_error, min({COSINE}) >= 0.9999 AND max(list_max(d)) <= 0.001 AS accepted
FROM (SELECT a, b, list_transform(generate_series(1, 64), lambda i: abs(a[i] - b[i])) AS d FROM (
  SELECT CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 4)) AS b FROM embeddings))""")
def embedding_drift(lib):
    rows = lib.table("embeddings").select(vectors.as_doubles(F.col("embedding")).alias("a")).withColumn("b", F.transform("a", lambda x: F.round(x, 4)))
    stats = rows.agg(*vectors.fidelity(F.col("a"), F.col("b")))
    return stats.select(*(F.round(c, 9).alias(c) for c in ("min_cosine", "mean_cosine", "max_error", "mean_error")), "accepted")


# --- scalars (C1-C11) ---


@query(f"SELECT mediaId, CAST(floor((least(greatest(s, -1), 1) + 1) * 50 + 0.5) AS INTEGER) AS percentage FROM (SELECT mediaId, {DOT.format(0)} AS s FROM media)", "media")
def match_percentage(lib):
    score = vectors.dot(F.col("embedding"), vectors.literal(vector_of(lib, 0)))
    return lib.media.select("mediaId", scalars.match_percentage(score).alias("percentage"))


@query("""SELECT mediaId, CASE WHEN dateTaken IS NULL THEN 'Date unavailable' ELSE strftime(make_timestamp(dateTaken * 1000), '%b %-d, %Y • %-I:%M %p') END AS shown FROM media""", "media")
def date_display(lib):
    return lib.media.select("mediaId", scalars.display_date(F.col("dateTaken")).alias("shown"))


STATUS_INPUT = "event_id, event_id % 11 <> 0 AS loaded, CASE WHEN event_id % 13 = 0 THEN 'no model' END AS model_error, CASE event_id % 4 WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN 'INTERRUPTED' WHEN 2 THEN 'QUEUED' END AS worker, event_id % 3 + 8 AS worker_total, CASE event_id % 5 WHEN 0 THEN 'ENQUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'BLOCKED' END AS work, event_id % 9 AS indexed, event_id % 10 AS faces, event_id % 17 % 10 AS total"


@query(f"""SELECT event_id, CASE WHEN NOT loaded THEN 'Idle' WHEN model_error IS NOT NULL OR worker = 'UNAVAILABLE' THEN 'Unavailable' WHEN total = 0 OR least(indexed, faces) >= total THEN 'Idle'
  WHEN work IN ('ENQUEUED', 'BLOCKED') THEN 'Waiting' WHEN work = 'RUNNING' THEN 'Running' WHEN worker = 'INTERRUPTED' AND worker_total = total THEN 'Interrupted' ELSE 'Waiting' END AS status,
  CASE WHEN NOT loaded OR total = 0 OR indexed >= total THEN 'Idle' WHEN work IN ('ENQUEUED', 'BLOCKED') THEN 'Waiting' WHEN work = 'RUNNING' AND worker = 'QUEUED' THEN 'Waiting' WHEN work = 'RUNNING' THEN 'Running'
  WHEN worker = 'INTERRUPTED' AND worker_total = total THEN 'Interrupted' ELSE 'Waiting' END AS text_status,
  greatest(total - indexed, 0) AS remaining, least(indexed, faces) AS progress FROM (SELECT {STATUS_INPUT} FROM events)""")
def status_machine(lib):
    c = F.col
    rows = lib.table("events").selectExpr(*STATUS_INPUT.split(", "))
    return rows.select(
        "event_id", scalars.indexing_status(c("loaded"), c("model_error"), c("worker"), c("worker_total"), c("work"), c("indexed"), c("faces"), c("total")).alias("status"),
        scalars.text_status(c("loaded"), c("worker"), c("worker_total"), c("work"), c("indexed"), c("total")).alias("text_status"),
        scalars.remaining(c("total"), c("indexed")).alias("remaining"), planning.overall_progress(c("indexed"), c("faces")).alias("progress"),
    )


@query("""SELECT mediaId, CAST(greatest(1, floor(width * least(1.0, 1280 / greatest(width, height)))) AS INTEGER) AS width, CAST(greatest(1, floor(height * least(1.0, 1280 / greatest(width, height)))) AS INTEGER) AS height FROM media""", "media")
def bounded_sizes(lib):
    return lib.media.select("mediaId", scalars.bounded_size(F.col("width"), F.col("height"), 1280).alias("s")).select("mediaId", "s.width", "s.height")


@query("""SELECT event_id, event_id % 2 = 0 AND indexed < total AS visual, event_id % 2 = 1 AND indexed < total AS in_text, event_id % 3 = 0 AND faces < total AS in_faces,
CASE WHEN event_id % 2 = 0 THEN 'Normal query' ELSE 'OCR search' END AS mode, CASE WHEN total = 9 THEN 'Top 9 results' ELSE CAST(total AS VARCHAR) || ' results' END AS label
FROM (SELECT event_id, event_id % 9 AS indexed, event_id % 10 AS faces, event_id % 17 % 10 AS total FROM events)""")
def incompleteness_flags(lib):
    rows = lib.table("events").selectExpr("event_id", "CASE WHEN event_id % 2 = 0 THEN 'NORMAL' ELSE 'OCR' END AS mode", "CASE WHEN event_id % 3 = 0 THEN '@a' ELSE 'b' END AS query", "event_id % 9 AS indexed", "event_id % 10 AS faces", "event_id % 17 % 10 AS total")
    c = F.col
    rows = rows.withColumn("f", scalars.incomplete(c("mode"), c("query"), c("indexed"), c("indexed"), c("faces"), c("total")))
    return rows.select("event_id", "f.visual", F.col("f.text").alias("in_text"), F.col("f.faces").alias("in_faces"), scalars.label(c("mode")).alias("mode"), scalars.results_label(c("total"), 9).alias("label"))
