"""One commit for many files: data lies in folders of new names, and a manifest, put in place as a whole, tells readers which count.

Manifests are numbered; the highest is the state. A writer that dies before its manifest is in place leaves
folders that nobody reads. One writer at a time: a second one that commits the same number gets an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Commit:
    number: int
    content: dict


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _log(root: str) -> str:
    return f"{root.rstrip('/')}/_commits"


def new_folder(root: str) -> str:
    """A folder under root for one writer's files."""
    return f"{root.rstrip('/')}/data-{uuid.uuid4().hex}"


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def current(spark: SparkSession, root: str) -> Commit | None:
    """The state under root; None before the first commit."""
    names = [n for n in children(spark, _log(root)) if n.endswith(".json") and n[0].isdigit()]
    if not names:
        return None
    fs, p = _fs(spark, f"{_log(root)}/{names[-1]}")
    stream = fs.open(p)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return Commit(int(names[-1].split(".")[0]), json.loads(text))


def commit(spark: SparkSession, root: str, content: dict, after: Commit | None) -> Commit:
    """Makes content the state that follows ``after``."""
    number = after.number + 1 if after else 1
    fs, target = _fs(spark, f"{_log(root)}/{number:020d}.json")
    _, draft = _fs(spark, f"{_log(root)}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise FileExistsError(f"{target}: another writer has committed")
    return Commit(number, content)


def drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
