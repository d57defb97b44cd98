"""Versioned outputs with a commit pointer: readers see a whole version or the one before.

    <root>/versions/<id>/...         one folder for each build, never changed afterwards
    <root>/commits/0000000007.json   a commit: its version's folder, the digest of its inputs

A build writes its version's folder first.  Then its commit file is written
under another name and renamed, which is the only step that readers notice:
they take the highest commit.  A build that fails or is killed leaves no commit,
so readers keep the version before.  Numbers are claimed by creating a file
that must not exist yet, so two builds at a time get two numbers, and the higher
one counts.

``input_digest`` tells whether inputs have changed: paths, sizes and
modification times, summed up on the executors.  ``expire`` removes the folders
of old versions; a reader that opened one before needs it as long as it runs, so
the caller chooses when, and how many to keep.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, file_system, path_exists


class Version(NamedTuple):
    """A committed version: number, folder, input digest and what else the build noted."""

    number: int
    folder: str
    digest: str | None
    notes: dict


def input_digest(spark: SparkSession, paths: Iterable[str]) -> str:
    """A digest of all files below ``paths``: their paths, sizes and modification times.

    The order of paths counts, that of files does not.  Contents are not read.
    A path without files, or that does not exist, has a digest as well.
    """
    parts = []
    for path in paths:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            parts.append(f"{path}:none")
            continue
        name = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
        row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.bit_xor(name).alias("names")).first()
        parts.append(f"{path}:{row.n}:{row['size']}:{row.names}")
    return "|".join(parts)


def history(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the commits, ascending."""
    fs, folder = file_system(spark, f"{root.rstrip('/')}/commits")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def committed(spark: SparkSession, root: str, number: int) -> Version:
    """The version of one commit."""
    root = root.rstrip("/")
    fs, path = file_system(spark, _commit_path(root, number))
    stream = fs.open(path)
    try:
        cell = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(number, f"{root}/{cell['folder']}", cell["digest"], cell["notes"])


def current(spark: SparkSession, root: str) -> Version | None:
    """The version that readers see; None before the first commit."""
    numbers = history(spark, root)
    return committed(spark, root, numbers[-1]) if numbers else None


def _commit_path(root: str, number: int) -> str:
    return f"{root}/commits/{number:010d}.json"


def _claim(spark: SparkSession, root: str) -> int:
    fs, folder = file_system(spark, f"{root}/commits")
    fs.mkdirs(folder)
    number = max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder)), default=0)
    while True:
        number += 1
        _, path = file_system(spark, f"{root}/commits/{number:010d}.claim")
        try:
            if fs.createNewFile(path):
                return number
        except Exception as raised:  # some file systems raise where others say no
            if "AlreadyExists" not in str(raised):
                raise


def _commit(spark: SparkSession, root: str, folder: str, digest: str | None, notes: dict) -> Version:
    number = _claim(spark, root)
    fs, target = file_system(spark, _commit_path(root, number))
    _, written = file_system(spark, f"{_commit_path(root, number)}.{uuid.uuid4().hex}")
    stream = fs.create(written, True)
    try:
        stream.write(bytearray(json.dumps({"folder": folder, "digest": digest, "notes": notes}, default=str), "utf-8"))
    finally:
        stream.close()
    if not fs.rename(written, target):
        raise OSError(f"commit {number} of {root} could not be renamed into place")
    return committed(spark, root, number)


def publish(
    spark: SparkSession,
    root: str,
    build: Callable[[str], dict | None],
    digest: str | None = None,
) -> Version:
    """Let ``build`` write into a new version's folder, then commit it.

    What ``build`` returns is kept as the commit's notes.  If it raises, its
    folder is removed and the version that was current stays so.
    """
    root = root.rstrip("/")
    folder = f"versions/{uuid.uuid4().hex}"
    try:
        notes = build(f"{root}/{folder}") or {}
    except BaseException:
        delete_path(spark, f"{root}/{folder}")
        raise
    return _commit(spark, root, folder, digest, notes)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove the commits and folders of all but the last ``keep`` versions; their numbers."""
    if keep < 1:
        raise ValueError("the current version is always kept")
    old = history(spark, root)[:-keep]
    for number in old:
        folder = committed(spark, root, number).folder
        delete_path(spark, _commit_path(root.rstrip("/"), number))  # first, so that no reader finds it
        delete_path(spark, folder)
    return old


def replace_path(spark: SparkSession, written: str, target: str) -> None:
    """Move a finished ``written`` to ``target``; what was there goes only afterwards.

    For outputs at a fixed path.  Two renames: in between, ``target`` is missing
    for a moment, but never half written.
    """
    fs, source = file_system(spark, written)
    _, place = file_system(spark, target)
    _, aside = file_system(spark, f"{target}.replaced-{uuid.uuid4().hex}")
    parent = place.getParent()
    if parent is not None:
        fs.mkdirs(parent)
    replaced = path_exists(spark, target)
    if replaced and not fs.rename(place, aside):
        raise OSError(f"{target} could not be moved aside")
    if not fs.rename(source, place):
        if replaced:
            fs.rename(aside, place)
        raise OSError(f"{written} could not be moved to {target}")
    if replaced:
        fs.delete(aside, True)
