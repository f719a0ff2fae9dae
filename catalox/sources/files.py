"""Files as rows: scanning, media types, content hashes and archive expansion."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Media types by file-name suffix.
MEDIA_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp",
    "heic": "image/heic", "svg": "image/svg+xml", "psd": "image/vnd.adobe.photoshop", "fbs": "image/vnd.fastbidsheet", "mp4": "video/mp4", "mov": "video/quicktime",
    "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm", "mpg": "video/mpeg", "ts": "video/mp2t", "zip": "application/zip",
}
# Media types that a scan leaves out.
EXCLUDED = ["image/svg+xml", "image/vnd.adobe.photoshop", "image/vnd.fastbidsheet", "video/mp2t"]


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path) -> Column:
    """The media type by suffix; null where unknown."""
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(table, suffix(path))


def is_media(kind: Column) -> Column:
    """Images, videos and zip archives that a scan takes."""
    return F.coalesce((kind.startswith("image/") | kind.startswith("video/") | (kind == "application/zip")) & ~kind.isin(EXCLUDED), F.lit(False))


def scan(spark: SparkSession, path: str, ignore: str | None = None, content: bool = False) -> DataFrame:
    """Files below ``path``: path, length, modified (and content). ``ignore`` is a pattern of paths to leave out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(~F.col("path").rlike(ignore)) if ignore else files
    return files.select("path", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def scan_media(spark: SparkSession, path: str, ignore: str | None = None, content: bool = False) -> DataFrame:
    found = scan(spark, path, ignore, content).withColumn("content_type", media_type(F.col("path")))
    return found.filter(is_media(F.col("content_type")))


def hashed(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """``files(path, length, modified, content)`` with the SHA-256 of their bytes.

    ``cache(path, length, modified, hash)`` answers for files of equal path, length
    and time; only the content of the others is hashed.
    """
    own = F.sha2("content", 256)
    if cache is None:
        return files.withColumn("hash", own).drop("content")
    known = cache.select("path", "length", "modified", F.col("hash").alias("known"))
    return files.join(known, ["path", "length", "modified"], "left").withColumn("hash", F.coalesce("known", own)).drop("content", "known")


def expand_archives(files: DataFrame, depth: int = 100) -> DataFrame:
    """One row (path, length, hash, content) per entry of ``files(path, content)``, with archives in archives opened.

    The logical path is the archive's path and the entry's. Anything that is no
    archive is itself one row; a broken archive too. Archives nested deeper than
    ``depth``, as those that hold themselves, raise.
    """

    def entries(path: str, data: bytes, left: int) -> Iterator[tuple[str, bytes]]:
        if path.lower().endswith(".zip"):
            if not left:
                raise ValueError(f"{path[:200]} is nested too deep")
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for name in archive.namelist():
                        if not name.endswith("/"):
                            yield from entries(f"{path}/{name}", archive.read(name), left - 1)
                return
            except zipfile.BadZipFile:
                pass
        yield path, data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, raw in entries(path, data or b"", depth):
                    yield pa.RecordBatch.from_pydict({"path": [name], "length": pa.array([len(raw)], pa.int64()), "hash": [hashlib.sha256(raw).hexdigest()], "content": [raw]})

    return files.select("path", "content").mapInArrow(run, "path string, length long, hash string, content binary")
