"""The store's rules as DataFrame transformations.

A row's revision is ``dateModified``. Functions take stored and incoming rows and return the new state; the
caller publishes it (``prismlake.sources.tables``). Children without their parent's revision are dropped by a
semi-join, so a state written in part is harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.schemas import FACE_MODEL

CHILDREN = ("photo_text", "face_index", "face_embeddings")
HISTORY_SIZE = 100


class StoreError(ValueError):
    pass


def valid_children(children: DataFrame, media: DataFrame, model: str) -> DataFrame:
    """Derived rows of the model version whose revision is their photo's."""
    parents = media.select("mediaId", "dateModified")
    return children.where(F.col("modelVersion") == model).join(parents, ["mediaId", "dateModified"], "left_semi")


def _latest(stored: DataFrame, incoming: DataFrame, incoming_wins: bool) -> DataFrame:
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.select(*stored.columns).withColumn("_new", F.lit(1)))
    order = [F.desc("dateModified"), F.desc("_new") if incoming_wins else F.asc("_new")]
    if "indexedAt" in stored.columns:
        order.append(F.desc("indexedAt"))
    newest = F.row_number().over(Window.partitionBy("mediaId").orderBy(*order))
    return both.withColumn("_n", newest).where("_n = 1").drop("_n", "_new")


def upsert_media(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest revision of each photo; of one revision the incoming row. Late revisions are ignored."""
    return _latest(stored, incoming, True)


def merge_changes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``upsert_media`` for a feed that may say, in a column ``gone``, that a photo's newest revision is its deletion."""
    if "gone" not in incoming.columns:
        return upsert_media(stored, incoming)
    newest = _latest(stored.withColumn("gone", F.lit(False)), incoming.withColumn("gone", F.coalesce("gone", F.lit(False))), True)
    return newest.where("not gone").drop("gone")


def ensure_metadata(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """As ``upsert_media``, but a stored row of the same revision, with its vector, stays."""
    if "embedding" in incoming.columns:
        incoming = incoming.withColumn("embedding", F.array().cast(incoming.schema["embedding"].dataType))
    return _latest(stored, incoming.withColumn("embeddingDimension", F.lit(0)), False)


def cascade(tables: dict[str, DataFrame], media: DataFrame, before: DataFrame) -> dict[str, DataFrame]:
    """Children of photos that are gone or changed revision since ``before`` go."""
    same = before.select("mediaId", "dateModified").join(media.select("mediaId", "dateModified"), ["mediaId", "dateModified"], "left_semi").select("mediaId")
    return {name: df.join(same, "mediaId", "left_semi") if name in CHILDREN else df for name, df in tables.items()}


@dataclass(frozen=True)
class Derived:
    """A kept table that follows another one. Each of its rows is made from one row of ``base`` and has its mediaId."""

    name: str
    base: str
    make: Callable[[DataFrame], DataFrame]

    def followed(self, stored: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
        """The table once ``base`` has become ``after``: only new and changed base rows are made anew, rows of gone ones go.

        A photo's base row is told from the one before by a 64-bit hash of all its columns.
        """
        columns = [c for c in before.columns if c != "mediaId"]
        marked = [df.select("mediaId", F.xxhash64(*columns).alias("_mark")) for df in (before, after)]
        stays = marked[0].join(marked[1], ["mediaId", "_mark"], "left_semi").select("mediaId")
        new = self.make(after.join(stays, "mediaId", "left_anti"))
        return stored.join(stays, "mediaId", "left_semi").unionByName(new.select(*stored.columns))


def put_text(stored: DataFrame, incoming: DataFrame, media: DataFrame) -> DataFrame:
    """D3: texts whose photo is there at their revision replace the stored ones; late and orphaned ones are dropped."""
    good = incoming.join(media.select("mediaId", "dateModified"), ["mediaId", "dateModified"], "left_semi").select(*stored.columns)
    good = good.withColumn("_n", F.row_number().over(Window.partitionBy("mediaId").orderBy(F.desc("modelVersion")))).where("_n = 1").drop("_n")
    return stored.join(good.select("mediaId"), "mediaId", "left_anti").unionByName(good)


def replace_faces(states: DataFrame, faces: DataFrame, new_states: DataFrame, new_faces: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All faces of each scanned photo are replaced, also by none; faces of other photos don't belong."""
    good = new_states.join(media.select("mediaId", "dateModified"), ["mediaId", "dateModified"], "left_semi").select(*states.columns)
    ids = good.select("mediaId")
    kept_faces = faces.join(ids, "mediaId", "left_anti").unionByName(new_faces.join(ids, "mediaId", "left_semi").select(*faces.columns))
    return states.join(ids, "mediaId", "left_anti").unionByName(good), kept_faces


def delete_media(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Photos and, with them, their children; no chunks are needed."""
    return {name: df.join(gone.select("mediaId"), "mediaId", "left_anti") if name in ("media_embeddings", *CHILDREN) else df for name, df in tables.items()}


def add_history(stored: DataFrame, incoming: DataFrame, most: int = HISTORY_SIZE) -> DataFrame:
    """The newest rows by (timestamp, id); a sort with a limit, not a window over everything."""
    return stored.unionByName(incoming.select(*stored.columns)).orderBy(F.desc("timestamp"), F.desc("id")).limit(most)


def recent_history(history: DataFrame, most: int = HISTORY_SIZE) -> DataFrame:
    """S12."""
    return history.orderBy(F.desc("timestamp"), F.desc("id")).limit(most)


def clear(stored: DataFrame) -> DataFrame:
    """D7."""
    return stored.where("false")


def put_progress(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows by id."""
    return stored.join(incoming.select("id"), "id", "left_anti").unionByName(incoming.select(*stored.columns))


def by_id(df: DataFrame, value: int, key: str = "mediaId") -> DataFrame:
    """S6."""
    return df.where(F.col(key) == value)


def by_ids(df: DataFrame, values: Sequence, key: str) -> DataFrame:
    """S7."""
    return df.where(F.col(key).isin(list(values)))


def states(df: DataFrame) -> DataFrame:
    """Only the columns that planning needs."""
    return df.select(*(c for c in ("mediaId", "dateModified", "embeddingDimension", "modelVersion") if c in df.columns))


def saved_people(people: DataFrame) -> DataFrame:
    """S11."""
    return people.select("id", "name", "handle", "thumbnail", "embeddingModel").orderBy("handle")


def add_people(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A handle that is taken, or comes twice, fails at once."""
    both = stored.unionByName(incoming.select(*stored.columns))
    twice = both.groupBy("handle").agg(F.count("*").alias("n")).where("n > 1").orderBy("handle").limit(5).collect()
    if twice:
        raise StoreError("already saved: " + ", ".join(f"@{r['handle']}" for r in twice))
    return both


def update_face(stored: DataFrame, person: int, embedding: Sequence[float], thumbnail: bytes, model: str = FACE_MODEL) -> tuple[DataFrame, int]:
    """The new table and the number of rows changed."""
    mine = F.col("id") == person
    new = {"embedding": F.array(*map(F.lit, map(float, embedding))), "thumbnail": F.lit(bytearray(thumbnail)), "embeddingDimension": F.lit(len(embedding)), "embeddingModel": F.lit(model)}
    changed = stored.withColumns({c: F.when(mine, v.cast(stored.schema[c].dataType)).otherwise(F.col(c)) for c, v in new.items()})
    return changed, stored.where(mine).count()


def enroll(stored: DataFrame, name: str, embedding: Sequence[float], thumbnail: bytes, existing: int | None = None, model: str = FACE_MODEL) -> DataFrame:
    """A new person, or a new face of ``existing``, who must still own the handle."""
    from prismlake.plans.query import canonical_handle

    handle = canonical_handle(name)
    owners = [r["id"] for r in stored.where(F.col("handle") == handle).select("id").collect()]
    if existing is not None:
        if owners != [existing]:
            raise StoreError(f"@{handle} is no longer this person's name")
        changed, n = update_face(stored, existing, embedding, thumbnail, model)
        if n != 1:
            raise StoreError("the person is gone")
        return changed
    if owners:
        raise StoreError(f"@{handle} is already saved")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    row = {"id": top + 1, "name": name.strip().removeprefix("@"), "handle": handle, "thumbnail": bytearray(thumbnail), "embedding": [float(x) for x in embedding], "embeddingDimension": len(embedding), "embeddingModel": model}
    return stored.unionByName(stored.sparkSession.createDataFrame([tuple(row[c] for c in stored.columns)], stored.schema))


def person_flags(people: DataFrame, handle: str, editing: int | None = None, model: str = FACE_MODEL) -> DataFrame:
    """Who is ready for search, and who already owns the handle being typed."""
    other = F.lit(True) if editing is None else F.col("id") != editing
    return people.select("id", "handle", (F.col("embeddingModel") == model).alias("ready"), ((F.col("handle") == handle) & other).alias("duplicate"))


def suggestions(people: DataFrame, draft_end: str, most: int = 6) -> DataFrame:
    """Handles that continue the mention at the end of a draft."""
    return people.where(F.col("handle").startswith(draft_end.lower())).select("id", "name", "handle").orderBy("handle").limit(most)
