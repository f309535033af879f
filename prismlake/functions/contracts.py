"""Strict readers of model descriptions."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake.functions.text import BytePairs

# fixed values that a model description must have, by path
REQUIRED = {
    "format_version": 1, "model.name": "MobileCLIP2-S0", "model.embeddings_l2_normalized": True, "model.embedding_dimension": 512,
    "image_encoder.image_size": 256, "image_encoder.layout": "NCHW", "image_encoder.input_dtype": "float32", "image_encoder.output_dtype": "float32",
    "image_encoder.input_shape": ["batch", 3, 256, 256], "image_encoder.output_shape": ["batch", 512], "image_encoder.input_range": [0, 1],
    "image_encoder.preprocessing.resize_mode": "shortest", "image_encoder.preprocessing.interpolation": "bicubic",
    "image_encoder.preprocessing.center_crop": True, "image_encoder.preprocessing.divide_uint8_by_255": True,
    "text_encoder.context_length": 77, "text_encoder.input_dtype": "int64", "text_encoder.output_dtype": "float32",
    "text_encoder.input_shape": ["batch", 77], "text_encoder.output_shape": ["batch", 512],
    "tokenizer.context_length": 77, "tokenizer.type": "open_clip_simple_tokenizer", "tokenizer.byte_encoding": "openai_clip_bytes_to_unicode",
    "tokenizer.clean_function": "_clean_lower", "tokenizer.padding_is_reserved_token": False, "tokenizer.vocab_size": 49408, "tokenizer.truncate": True,
    "tokenizer.text_cleaning": ["ftfy_fix_text", "html_unescape_twice", "trim", "collapse_whitespace", "lowercase"],
}
#: Paths that must be there with a value of a kind.
PRESENT = {
    "image_encoder.input_name": str, "image_encoder.output_name": str, "text_encoder.input_name": str, "text_encoder.output_name": str,
    "tokenizer.regex": str, "tokenizer.regex_ignore_case": bool, "tokenizer.sot_token": str, "tokenizer.eot_token": str,
    "tokenizer.sot_token_id": int, "tokenizer.eot_token_id": int, "tokenizer.padding_value": int,
}
FILES = ("image_encoder.model_file", "text_encoder.model_file", "tokenizer.vocab_file", "tokenizer.merges_file")


class ContractError(ValueError):
    pass


def _at(root: dict, path: str):
    for name in path.split("."):
        if not isinstance(root, dict) or name not in root:
            raise ContractError(f"{path} is missing")
        root = root[name]
    return root


def read_config(text: str) -> dict:
    """The description, if it keeps every rule."""
    try:
        root = json.loads(text)
    except ValueError as error:
        raise ContractError(f"not JSON: {error}") from error
    for path, value in REQUIRED.items():
        got = _at(root, path)
        if got != value or isinstance(got, bool) != isinstance(value, bool):
            raise ContractError(f"{path} must be {value!r}, not {got!r}")
    for path, kind in PRESENT.items():
        if not isinstance(_at(root, path), kind):
            raise ContractError(f"{path} must be {kind.__name__}")
    for path in FILES:
        name = _at(root, path)
        if not str(name).strip() or "/" in name or "\\" in name:
            raise ContractError(f"{path} must be a local file name")
    for path in ("image_encoder.mean", "image_encoder.std"):
        if len(_at(root, path)) != 3 or not all(math.isfinite(x) for x in _at(root, path)):
            raise ContractError(f"{path} must have 3 finite values")
    if min(_at(root, "image_encoder.std")) <= 0:
        raise ContractError("image_encoder.std must be positive")
    if not isinstance(_at(root, "tokenizer.merge_count"), int) or root["tokenizer"]["merge_count"] <= 0:
        raise ContractError("tokenizer.merge_count must be positive")
    examples = _at(root, "tokenizer_test_vectors")
    if not examples or any(len(x["input_ids"]) != 77 for x in examples):
        raise ContractError("tokenizer_test_vectors must have 77 ids each")
    return root


def matches(shape: Sequence, expected: Sequence) -> bool:
    """Equal element by element, names to names and numbers to numbers."""
    return len(shape) == len(expected) and all(type(a) is type(b) and a == b for a, b in zip(shape, expected, strict=True))


def merge_list(spark: SparkSession, path: str) -> DataFrame:
    """First, second, rank of a merge list; blank and version lines don't count."""
    return merge_lists(spark.read.text(path, wholetext=True).select(F.lit(path).alias("file"), "value")).drop("file")


def merge_lists(files: DataFrame) -> DataFrame:
    """File, first, second, rank of merge lists (file, value); of a null text there are none."""
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    parts = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")
    lines = lines.where(~F.col("text").startswith("#version:") & F.col("text").rlike(r"\S")).select("file", "line", parts.alias("parts")).where(F.size("parts") == 2)
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1  # within one file
    return lines.select("file", F.col("parts")[0].alias("first"), F.col("parts")[1].alias("second"), rank.alias("rank"))


def read_tokenizer(config: dict, vocabulary: str, merges: DataFrame) -> BytePairs:
    """The tokenizer of a checked description, if its files have the promised sizes, ids and examples."""
    known, described = json.loads(vocabulary), config["tokenizer"]
    pairs = [(r["first"], r["second"]) for r in merges.orderBy("rank").collect()]  # one file of a fixed size
    promised = {
        "vocabulary entries": (len(known), described["vocab_size"]), "merges": (len(pairs), described["merge_count"]),
        "start id": (known.get(described["sot_token"]), described["sot_token_id"]), "end id": (known.get(described["eot_token"]), described["eot_token_id"]),
    }
    for what, (got, wanted) in promised.items():
        if got != wanted:
            raise ContractError(f"{what}: {got!r}, not {wanted!r}")
    made = BytePairs(known, pairs, described["sot_token"], described["eot_token"], described["context_length"], described["padding_value"], described["regex"])
    for i, example in enumerate(config["tokenizer_test_vectors"]):
        if made.ids(example["text"]) != example["input_ids"]:
            raise ContractError(f"example {i} has other ids")
    return made


def export_tokenizer(vocabulary: DataFrame, merges: DataFrame, folder: str) -> None:
    """D14, its text files: ``folder/vocabulary``, JSON by id of (token, id), and ``folder/merges``, lines by rank of (rank, first,
    second) after a version line. Both tables are one tokenizer's, of a fixed size."""
    entry = F.concat(F.to_json(F.array("token")).substr(F.lit(2), F.length(F.to_json(F.array("token"))) - 2), F.lit(": "), F.col("id").cast("string"))
    entries = vocabulary.agg(F.sort_array(F.collect_list(F.struct("id", entry.alias("e")))).alias("x"))
    lines = merges.agg(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(" ", "first", "second").alias("e")))).alias("x"))
    entries.select(F.concat(F.lit("{"), F.array_join("x.e", ", "), F.lit("}"))).write.text(f"{folder}/vocabulary")
    lines.select(F.concat(F.lit("#version: 0.2\n"), F.array_join("x.e", "\n"))).write.text(f"{folder}/merges")


def wire_number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def wire_message(fields: Sequence[tuple[int, int | bytes]]) -> bytes:
    """X18, the other way: numbers and strings of bytes in the wire format of model files."""
    out = b""
    for number, value in fields:
        out += wire_number(number << 3) + wire_number(value) if isinstance(value, int) else wire_number(number << 3 | 2) + wire_number(len(value)) + value
    return out


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message: numbers, and bytes of fields with a length or of 4 or 8 bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ContractError("the message is cut off")
            byte = data[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        if kind not in (1, 2, 5):
            raise ContractError(f"unknown wire type {kind}")
        size = number() if kind == 2 else 8 if kind == 1 else 4
        if at + size > len(data):
            raise ContractError("the message is cut off")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Output:
    name: str
    is_float: bool
    shape: tuple[int, ...]


def resolve_output(configured: str, dimension: int, outputs: Sequence[Output]) -> str:
    """The named output, or where no output has the name the only one of the right kind."""

    def fits(o: Output) -> bool:
        return o.is_float and len(o.shape) == 2 and o.shape[0] in (1, -1) and o.shape[1] == dimension

    named = [o for o in outputs if o.name == configured][:1]
    able = [o.name for o in (named or outputs) if fits(o)]
    if len(able) != 1:
        raise ContractError(f"no single output of {dimension} floats named {configured!r} among {[o.name for o in outputs]}")
    return able[0]


def with_checksum(files: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Binary files whose SHA-256 is the expected one by file name; any other fails."""
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.create_map(*(F.lit(x) for pair in expected.items() for x in pair))[name] if expected else F.lit(None).cast("string")
    digest = F.sha2("content", 256)
    return files.withColumn("sha256", F.when(digest == wanted, digest).otherwise(F.raise_error(F.concat(F.lit("wrong checksum of "), name)).cast("string")))


def checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """X15 with the error as a value: ``files`` (path, content) beside ``expected`` (name, sha256), each file with its sha256 or why not."""
    digest = F.sha2("content", 256)
    rows = files.withColumn("_name", F.element_at(F.split("path", "/"), -1)).join(expected.select(F.col("name").alias("_name"), F.lower("sha256").alias("_wanted")), "_name", "left")
    error = F.when(F.col("_wanted").isNull(), F.lit("no checksum of ")).when(F.col("content").isNull(), F.lit("no content of ")).when(digest != F.col("_wanted"), F.lit("wrong checksum of "))
    return rows.withColumns({"sha256": F.when(digest == F.col("_wanted"), digest), "error": F.concat(error, F.col("_name"))}).drop("_name", "_wanted")
