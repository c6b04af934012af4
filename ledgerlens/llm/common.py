"""What the operators share: tables, the shared folder, materialised steps, files that executors write and read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        key = spark.sparkContext.applicationId
        if key not in _OWN_FOLDERS:
            _OWN_FOLDERS[key] = tempfile.mkdtemp(prefix="ledgerlens-")
        folder = _OWN_FOLDERS[key]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, what: str) -> DataFrame:
    """Writes a step to the shared folder and reads it back: later steps neither recompute it nor lose it with an executor."""
    spark = frame.sparkSession
    path = new_folder(spark, what)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow file system and path of a URI or a local path; used inside tasks for byte ranges."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def write_target(folder: str, suffix: str):
    """An open output file of a unique name below folder, and its URI. A repeated task attempt writes another file."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(frame: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: str.translate table of the same.
ASCII_LOWER = {upper: upper + 32 for upper in range(65, 91)}


def texts(batches, columns: list[str], rows: int = 1000):
    """Arrow batches as tuples of Python values, converted a thousand rows at a time to bound memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield from zip(*(part.column(name).to_pylist() for name in columns), strict=True)
