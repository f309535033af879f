"""Copying image files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import text

BUFFER = 64 * 1024


def copy_image(source: str, target: str) -> int:
    """Copies the bytes to a pending name and then renames; a failure removes only the pending copy."""
    files, source_path = pafs.FileSystem.from_uri(source) if "://" in source else (pafs.LocalFileSystem(), source.removeprefix("file:"))
    out, target_path = pafs.FileSystem.from_uri(target) if "://" in target else (pafs.LocalFileSystem(), target.removeprefix("file:"))
    pending, copied = f"{target_path}.pending", 0
    with files.open_input_stream(source_path) as stream:  # before anything is created
        try:
            with out.open_output_stream(pending) as sink:
                while part := stream.read(BUFFER):
                    sink.write(part)
                    copied += len(part)
            if not copied:
                raise OSError("the original photo is empty")
            out.move(pending, target_path)
        except BaseException:
            if out.get_file_info(pending).type != pafs.FileType.NotFound:
                out.delete_file(pending)
            raise
    return copied


def save_copies(photos: DataFrame, folder: str) -> DataFrame:
    """mediaId, copy, bytes, error: a copy of each image (path, displayName, mimeType) in ``folder``, shared by all executors.

    The name's eight characters come from the photo's id and path, so that a task that runs again writes the
    same file and not another.
    """
    suffix = F.sha2(F.concat_ws("|", F.col("mediaId").cast("string"), "path"), 256)
    named = photos.select("mediaId", "path", F.coalesce(F.col("mimeType").startswith("image/"), F.lit(False)).alias("image"), text.copy_name(F.col("displayName"), F.col("mimeType"), suffix).alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media_id, path, image, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if not image:
                        raise OSError("this photo's image format is unavailable")
                    target = f"{folder.rstrip('/')}/{name}"
                    rows.append((media_id, target, copy_image(path, target), None))
                except OSError as error:
                    rows.append((media_id, None, None, str(error)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["mediaId", "copy", "bytes", "error"])

    return named.mapInArrow(run, "mediaId long, copy string, bytes long, error string")
