"""Table schemas, conforming reads and schema migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: versions of the models whose results are valid
FACE_MODEL = "buffalo-sc-w600k-mbf-v1"
TEXT_MODEL = "mlkit-latin-16.0.1-vi-v1"
IMAGE_MODEL = "mobileclip2-s0"

VECTOR = T.ArrayType(T.FloatType(), False)


def _table(mandatory: str, optional: str = "") -> T.StructType:
    """Fields written as ``name:type``; mandatory ones can't be null."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "vector": VECTOR}
    fields = [T.StructField(n, kinds[k], False) for n, k in (x.split(":") for x in mandatory.split())]
    return T.StructType(fields + [T.StructField(n, kinds[k], True) for n, k in (x.split(":") for x in optional.split())])


MEDIA_ITEM = _table(
    "mediaId:long uri:string mediaType:string dateModified:long",
    "displayName:string dateTaken:long dateAdded:long width:int height:int mimeType:string bucketId:string bucketName:string",
)
MEDIA = T.StructType([*MEDIA_ITEM.fields, *_table("embedding:vector embeddingDimension:int indexedAt:long").fields])
FACE_INDEX = _table("mediaId:long dateModified:long modelVersion:string")
FACES = _table("mediaId:long faceIndex:int embedding:vector embeddingDimension:int")
PEOPLE = _table("id:long name:string handle:string thumbnail:bytes embedding:vector embeddingDimension:int embeddingModel:string")
PHOTO_TEXT = _table("mediaId:long text:string searchText:string dateModified:long modelVersion:string truncated:bool")
HISTORY = _table("id:long query:string timestamp:long searchMode:string", "topResultUri:string")
PROGRESS = _table("id:int processed:int total:int failed:int status:string updatedAt:long", "error:string")

MEDIA_TYPES = ("IMAGE", "VIDEO")


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Casts to ``schema``: missing optional columns become null, nulls take their default, missing mandatory columns fail."""
    defaults = defaults or {}
    missing = [f.name for f in schema if not f.nullable and f.name not in df.columns and f.name not in defaults]
    if missing:
        raise ValueError(f"mandatory columns are missing: {', '.join(missing)}")
    columns = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        columns.append(c.alias(f.name))
    return df.select(*columns)


def split_allowed(df: DataFrame, column: str, values: tuple[str, ...] = MEDIA_TYPES) -> DataFrame:
    """U5 with the error as a value: ``error`` says which rows ``allowed`` would fail on."""
    unknown = F.col(column).isNotNull() & ~F.col(column).isin(*values)
    return df.withColumn("error", F.when(unknown, F.concat(F.lit(f"unknown {column}: "), F.col(column))))


def allowed(df: DataFrame, column: str, values: tuple[str, ...] = MEDIA_TYPES) -> DataFrame:
    """Fails at run time on a value outside ``values``."""
    wrong = F.concat(F.lit(f"unknown {column}: "), F.col(column))
    return df.withColumn(column, F.when(F.col(column).isin(*values) | F.col(column).isNull(), F.col(column)).otherwise(F.raise_error(wrong)))


def migrate(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Tables of schema ``version`` (1 to 4) as tables of version 4: later tables start empty, later columns with their default."""
    if not 1 <= version <= 4:
        raise ValueError(f"unknown schema version {version}")
    out = dict(tables)
    spark = next(iter(tables.values())).sparkSession

    def empty(name: str, schema: T.StructType) -> None:
        out.setdefault(name, spark.createDataFrame([], schema))

    if version < 2:
        empty("people", T.StructType([f for f in PEOPLE if f.name != "embeddingModel"]))
    if version < 3:
        empty("face_index", FACE_INDEX)
        empty("face_embeddings", FACES)
        out["people"] = out["people"].withColumn("embeddingModel", F.lit(IMAGE_MODEL))
    if version < 4:
        empty("photo_text", PHOTO_TEXT)
        if "search_history" in out:
            out["search_history"] = out["search_history"].withColumn("searchMode", F.lit("HYBRID"))
    return out
