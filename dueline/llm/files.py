"""Files that tasks write: temporary names, deterministic final names, manifest."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.session import scratch_path

#: Rows of a manifest. ``units`` counts whatever positions in a file refer to.
MANIFEST = "file string, block int, bytes long, records long, units long, sha256 string"


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder in the shared folder.

    A path without a scheme is in the default file system of the cluster, as it is
    for Spark; tasks are told the whole URI.
    """
    return qualified(spark, scratch_path(spark, name))


def qualified(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    # Hadoop writes file:/x, others want file:///x.
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") else whole


class RollingFiles:
    """Files of one block. A file's name depends on the block and its number.

    Content and names are the same in every attempt of a task, so a move over
    the file of another attempt changes nothing.
    """

    def __init__(self, folder: str, block: int, suffix: str, roll_bytes: int):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.block, self.suffix, self.roll_bytes = block, suffix, roll_bytes
        self.done: list[tuple] = []
        self.parts: list[bytes] = []
        self.size = self.records = self.units = 0

    def add(self, part: bytes, records: int, units: int) -> None:
        if self.parts and self.size + len(part) > self.roll_bytes:
            self._close()
        self.parts.append(part)
        self.size += len(part)
        self.records += records
        self.units += units

    def _close(self) -> None:
        name = f"part-{self.block:06d}-{len(self.done):05d}{self.suffix}"
        attempt = TaskContext.get().taskAttemptId()
        temporary = f"{self.folder}/_temporary/{name}.{attempt}-{uuid.uuid4().hex}"
        data = b"".join(self.parts)
        self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
        with self.fs.open_output_stream(temporary) as out:
            out.write(data)
        self.fs.move(temporary, f"{self.folder}/{name}")
        digest = hashlib.sha256(data).hexdigest()
        self.done.append((name, self.block, len(data), self.records, self.units, digest))
        self.parts = []
        self.size = self.records = self.units = 0

    def finish(self) -> Iterator[dict]:
        """Close the last file; the manifest rows of all."""
        if self.parts:
            self._close()
        if self.done:
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            yield {n: list(c) for n, c in zip(names, zip(*self.done, strict=True), strict=True)}


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/_manifest")


def checked_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame | None:
    """Files as (path, content, ..), None if there are none.

    Their names and sizes must be those of the manifest; contents are not read
    for that.
    """
    manifest = read_manifest(spark, folder)
    if not manifest.limit(1).collect():
        return None
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"part-*{suffix}").load(folder)
    here = found.select(file_name().alias("file"), F.col("length").alias("bytes"))
    wrong = here.join(manifest.select("file", F.col("bytes").alias("_bytes")), "file", "full").filter(
        ~F.col("bytes").eqNullSafe(F.col("_bytes"))
    )
    if bad := wrong.limit(3).collect():
        raise ValueError(f"files and manifest differ: {[r['file'] for r in bad]}")
    return found


def file_name():
    return F.element_at(F.split("path", "/"), -1)
