"""The driver's tables in the roles of a library's tables.

The expressions are written in the part of SQL that Spark and DuckDB share, so that both read the same data;
``VIEWS`` gives them to DuckDB as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismlake.functions import text

DATE_ADDED = "CASE WHEN vec_id % 10 = 0 THEN NULL ELSE 1704067200 + vec_id * 3600 END"

MEDIA = {
    "mediaId": "vec_id", "uri": "'content://media/' || CAST(vec_id AS STRING)", "mediaType": "CASE WHEN vec_id % 17 = 0 THEN 'VIDEO' ELSE 'IMAGE' END",
    "displayName": "'photo_' || CAST(vec_id AS STRING) || CASE WHEN vec_id % 4 = 0 THEN '.JPG' WHEN vec_id % 4 = 1 THEN '/x.y.png' ELSE '' END",
    "dateTaken": "CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 1704067200000 + vec_id * 3600000 END", "dateAdded": DATE_ADDED, "dateModified": "vec_id % 7",
    "width": "CAST(640 + vec_id % 2000 AS INT)", "height": "CAST(480 + vec_id % 3000 AS INT)", "mimeType": "CASE WHEN vec_id % 3 = 0 THEN 'image/jpeg' ELSE 'image/x-other' END",
    "bucketId": "CASE WHEN label = 9 THEN NULL WHEN label = 8 THEN 'recent' ELSE CAST(label AS STRING) END", "bucketName": "CASE WHEN label = 7 THEN ' ' ELSE 'Album ' || CAST(label % 8 AS STRING) END",
    "embedding": "embedding", "embeddingDimension": "CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 64 END",
}
FACES = {"mediaId": "CAST(floor(vec_id / 3) AS BIGINT)", "faceIndex": "CAST(vec_id % 3 AS INT)", "embedding": "embedding", "embeddingDimension": "64"}
FACE_INDEX = {"mediaId": "mediaId", "dateModified": "mediaId % 7 + CASE WHEN mediaId % 4 = 0 THEN 1 ELSE 0 END", "modelVersion": "CASE WHEN mediaId % 9 = 0 THEN 'old' ELSE 'v1' END"}
PHOTO_TEXT = {"mediaId": "doc_id", "text": "text", "dateModified": "doc_id % 7 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END", "modelVersion": "CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE 'v1' END"}
HISTORY = {"id": "event_id", "query": "event_type", "timestamp": "CAST(floor(event_id * 7919 % 100003) AS BIGINT)", "searchMode": "CASE WHEN event_id % 5 = 0 THEN 'OCR' WHEN event_id % 5 = 1 THEN 'TEXT_IN_PHOTOS' WHEN event_id % 5 = 2 THEN 'HYBRID' ELSE 'NORMAL' END"}
PEOPLE = {"id": "vec_id", "name": "'Person ' || CAST(vec_id AS STRING)", "handle": "'p_' || CAST(vec_id AS STRING)", "embedding": "embedding", "embeddingDimension": "64", "thumbnail": "'th_' || CAST(vec_id AS STRING)", "embeddingModel": "CASE WHEN vec_id % 6 = 0 THEN 'old' ELSE 'v1' END"}
STORED = "mediaId % 13 <> 0"
STORED_REVISION = "dateModified + CASE WHEN mediaId % 6 = 0 THEN 1 ELSE 0 END"
MODEL = "v1"
NOW_MILLIS = 1704067200000 + 1200 * 3600000


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in expressions.items())


#: Common table expressions for DuckDB.
VIEWS = {
    "media": f"SELECT {_columns(MEDIA)} FROM embeddings",
    "faces": f"SELECT {_columns(FACES)} FROM embeddings",
    "face_index": f"SELECT {_columns(FACE_INDEX)} FROM (SELECT DISTINCT mediaId FROM faces) f",
    "photo_text": f"SELECT {_columns(PHOTO_TEXT)} FROM documents",
    "history": f"SELECT {_columns(HISTORY)} FROM events",
    "people": f"SELECT {_columns(PEOPLE)} FROM embeddings",
    "stored": f"SELECT mediaId, {STORED_REVISION} AS dateModified, embeddingDimension FROM media WHERE {STORED} UNION ALL SELECT mediaId + 100000, dateModified, embeddingDimension FROM media WHERE mediaId % 50 = 0",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the definitions that it needs."""
    needs = {"face_index": ("faces",), "stored": ("media",)}
    order: list[str] = []
    for n in names:
        order += [x for x in (*needs.get(n, ()), n) if x not in order]
    own = ", " + sql.strip().removeprefix("WITH ") if sql.strip().startswith("WITH ") else " " + sql
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + own


class Library:
    """The tables at ``sf_dir`` as DataFrames in library roles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _as(self, name: str, expressions: dict[str, str]) -> DataFrame:
        return self.table(name).selectExpr(*(f"{e} AS {c}" for c, e in expressions.items()))

    @property
    def media(self) -> DataFrame:
        return self._as("embeddings", MEDIA)

    @property
    def faces(self) -> DataFrame:
        return self._as("embeddings", FACES)

    @property
    def face_index(self) -> DataFrame:
        return self.faces.select("mediaId").distinct().selectExpr(*(f"{e} AS {c}" for c, e in FACE_INDEX.items()))

    @property
    def photo_text(self) -> DataFrame:
        rows = self._as("documents", PHOTO_TEXT)
        return rows.withColumn("searchText", text.fold(rows["text"]))

    @property
    def history(self) -> DataFrame:
        return self._as("events", HISTORY)

    @property
    def people(self) -> DataFrame:
        return self.table("embeddings").selectExpr(*(f"{e} AS {c}" for c, e in PEOPLE.items()))

    @property
    def stored(self) -> DataFrame:
        media = self.media.select("mediaId", "dateModified", "embeddingDimension")
        gone = media.where("mediaId % 50 = 0").selectExpr("mediaId + 100000 AS mediaId", "dateModified", "embeddingDimension")
        return media.where(STORED).selectExpr("mediaId", f"{STORED_REVISION} AS dateModified", "embeddingDimension").unionByName(gone)

    def vector(self, vec_id: int) -> list[float]:
        return list(self.table("embeddings").where(f"vec_id = {vec_id}").select("embedding").first()[0])
