"""A table of partitions with atomic commits.

``<base>/_manifest/<number>.json`` lists, for every partition of the table, the folder
that holds its rows. A writer reads the newest manifest, writes the partitions it
changes to a folder of its own under ``<base>/data``, and commits by creating the next
number: the file system creates a file only if it is absent, so of two writers who
read the same version one is refused, by name, and its rows are removed. Readers see
the partitions of one manifest, never a half-written one, and partitions that a commit
does not change are neither read nor written.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

KEEP_VERSIONS = 5
# A manifest that cannot be read is one being written, or, after this, one left by a crash.
SECONDS_TO_COMMIT = 60


class ConcurrentCommitError(RuntimeError):
    """Another writer committed since this one read the table."""


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


@dataclass
class Version:
    number: int = 0
    partitions: dict[str, str] = field(default_factory=dict)     # partition -> folder below the base

    def paths(self, base: str, prefix: str = "") -> list[str]:
        return [f"{base}/{folder}" for key, folder in sorted(self.partitions.items()) if key.startswith(prefix)]


def _numbers(fs, folder) -> list[int]:
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _file(base: str, number: int) -> str:
    return f"{base}/_manifest/{number:08d}.json"


def _read(spark: SparkSession, base: str, number: int) -> Version | None:
    """None for a manifest that was not written to its end."""
    fs, p, jvm = file_system(spark, _file(base, number))
    stream = fs.open(p)
    try:
        got = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        return Version(number, got["partitions"])
    except ValueError:
        return None
    finally:
        stream.close()


def newest(spark: SparkSession, base: str) -> Version:
    """The newest committed version; number 0 without one."""
    fs, p, jvm = file_system(spark, f"{base}/_manifest")
    numbers = _numbers(fs, p)
    for n in reversed(numbers):
        got = _read(spark, base, n)
        if got is not None:
            got.number = numbers[-1]         # torn ones after it are passed over, their numbers used up
            return got
        age = time.time() - fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(_file(base, n))).getModificationTime() / 1e3
        if age < SECONDS_TO_COMMIT:
            raise ConcurrentCommitError(f"version {n} of {base} is being committed")
    return Version(numbers[-1] if numbers else 0)


def new_folder() -> str:
    return f"data/{uuid.uuid4().hex}"


def remove(spark: SparkSession, base: str, folder: str) -> None:
    fs, p, _ = file_system(spark, f"{base}/{folder}")
    fs.delete(p, True)


def commit(spark: SparkSession, base: str, before: Version, changed: dict[str, str | None],
           keep: int | None = KEEP_VERSIONS) -> Version:
    """The version after ``before`` with some partitions in new folders (None: gone).

    Folders that none of the last ``keep`` versions names are removed (None: all stay).
    """
    partitions = {**before.partitions, **{k: v for k, v in changed.items() if v is not None}}
    for k, v in changed.items():
        if v is None:
            partitions.pop(k, None)
    after = Version(before.number + 1, partitions)
    fs, p, _ = file_system(spark, _file(base, after.number))
    try:
        out = fs.create(p, False)
    except Py4JJavaError as taken:
        if "FileAlreadyExists" not in str(taken.java_exception.getClass().getName()) \
                and "already exists" not in str(taken.java_exception.getMessage()):
            raise
        raise ConcurrentCommitError(f"version {after.number} of {base} was committed by another writer") from taken
    out.write(json.dumps({"partitions": partitions}, sort_keys=True).encode())
    out.close()
    if keep is not None:
        _forget(spark, base, after, keep)
    return after


def _forget(spark: SparkSession, base: str, after: Version, keep: int) -> None:
    fs, p, jvm = file_system(spark, f"{base}/_manifest")
    numbers = _numbers(fs, p)
    old, held = numbers[:-keep], {n: _read(spark, base, n) for n in numbers}
    named = {f for n in numbers[-keep:] if held[n] for f in held[n].partitions.values()}
    for n in old:
        for folder in set(held[n].partitions.values() if held[n] else ()) - named:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}"), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(_file(base, n)), False)


def scan(spark: SparkSession, base: str, schema, version: Version | None = None, prefix: str = "") -> DataFrame:
    """Rows of the partitions whose key begins with ``prefix``; empty without any.
    An unreadable file raises (never silently read as empty)."""
    paths = (version or newest(spark, base)).paths(base, prefix)
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)
