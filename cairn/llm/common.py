"""Shared folder, table access and small helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Unset in local mode (tests), a temporary folder is made and set; unset on a
    cluster, that is an error, for a machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='spark-cairn-')}"
        sc.setCheckpointDir(conf)
    return conf if "://" in conf else (f"file://{conf}" if conf.startswith("/") else conf.replace("file:/", "file:///", 1))


#: Folders that this driver has named in the shared folder.
_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a folder of its own for one call, inside the shared folder. It stays until ``discard``."""
    uri = f"{shared_dir(spark)}/cairn-{label}-{uuid.uuid4().hex}"
    _FOLDERS.append(uri)
    return uri


def discard() -> int:
    """Deletes the folders that operators of this driver have staged so far, and tells their number.

    For when the results that read them are written: a result that is not yet computed needs its folders.
    """
    gone = 0
    while _FOLDERS:
        fs, path = filesystem(_FOLDERS.pop())
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)
            gone += 1
    return gone


def mark() -> int:
    """The number of folders named so far, for ``discard_since``."""
    return len(_FOLDERS)


def discard_since(begin: int) -> int:
    """Deletes the folders named since ``begin`` but the last one, for when that is written and nothing else reads the others; tells their number."""
    gone, last = 0, _FOLDERS[-1:] if len(_FOLDERS) > begin else []
    for uri in _FOLDERS[begin:-1]:
        fs, path = filesystem(uri)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)
            gone += 1
    _FOLDERS[begin:] = last
    return gone


def _write(df: DataFrame, path: str, compression: str | None) -> DataFrame:
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Cuts lineage with a table in the shared folder; survives the loss of executors. compression: of its Parquet files, Spark's own choice if none."""
    return _write(df, new_folder(df.sparkSession, label), compression)


@contextlib.contextmanager
def shuffles_end(spark: SparkSession):
    """Queries of the session that end meanwhile give back their shuffle files then, not when the driver happens to collect its garbage.

    For queries that are run once: one that runs again makes its shuffle files again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Steps:
    """Tables that one call stages by ``written`` and gives up by ``drop`` as it goes on; what is not dropped stays until ``discard``."""

    def __init__(self):
        self.folders: dict[str, str] = {}

    def written(self, df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
        """As the function of that name; the step's shuffle files go once it is written."""
        self.folders[label] = new_folder(df.sparkSession, label)
        with shuffles_end(df.sparkSession):
            return _write(df, self.folders[label], compression)

    def drop(self, *labels: str) -> None:
        """Deletes tables of this call that nothing reads any more, its result included. One that pyarrow can't reach stays until ``discard``."""
        for label in labels:
            uri = self.folders.pop(label)
            with contextlib.suppress(OSError, pa.ArrowException):
                fs, path = filesystem(uri)
                fs.delete_dir(path)
                _FOLDERS.remove(uri)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put_json(uri: str, value: object) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(json.dumps(value).encode())


def get_json(uri: str) -> object:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as src:
        return json.loads(src.read())


def unused(columns: list[str], *stems: str) -> list[str]:
    """Names for columns of an operator's own, none of which ``columns`` has (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Zero-copy slices of a batch whose binary or string column holds about max_bytes at most (one row at least)."""
    array = batch.column(column)
    sizes = array.nbytes / max(1, len(array))
    step = max(1, int(max_bytes / max(sizes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
