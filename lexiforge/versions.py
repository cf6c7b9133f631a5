"""Snapshots of a stored data set: data files are only ever added, and a small
manifest, one new file per version, says which of them make up a version.

A reader sees the last whole manifest or an earlier one, never a mixture; a
writer that stops half-way leaves files that no manifest names. Works on any file
system that Spark can reach (Hadoop's interface, as Spark's own writers use).
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

FOLDER = "_versions"


class VersionConflict(RuntimeError):
    """Another writer published the version first."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions below ``root``, ascending; none if it does not exist."""
    fs, p = _path(spark, f"{root.rstrip('/')}/{FOLDER}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, Any]] | None:
    """(version, manifest) of ``version`` or the last one; None without any."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return None
        version = known[-1]
    fs, p = _path(spark, f"{root.rstrip('/')}/{FOLDER}/{version:012d}.json")
    stream = fs.open(p)
    try:
        return version, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, manifest: dict[str, Any], after: int | None = None) -> int:
    """Publish ``manifest`` as the version that follows ``after`` (the last one if
    None): written beside, then renamed, so it appears whole or not at all."""
    if after is None:
        after = (versions(spark, root) or [0])[-1]
    fs, final = _path(spark, f"{root.rstrip('/')}/{FOLDER}/{after + 1:012d}.json")
    _, beside = _path(spark, f"{root.rstrip('/')}/{FOLDER}/.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(beside, final):
        fs.delete(beside, False)
        raise VersionConflict(f"version {after + 1} of {root} exists already")
    return after + 1


def new_folder(root: str, kind: str) -> str:
    """A fresh folder for the data of a version to come."""
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
