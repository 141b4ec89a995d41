"""Publications that are replaced only when the new one is complete.

A publication at ``uri`` is a row of versions:

    uri/_versions/v-<id>/            the files of a version
    uri/_published/<number>.v-<id>   an empty file: from here on, this version is the current one

A version's files are written first and its marker last, so a job that dies in between
leaves the old version current and readable. Making one small file is atomic on
HDFS, on object stores and locally; nothing is renamed or overwritten. Of two jobs that
publish at once both complete, and every reader sees the same one as the last.
Readers call ``published_path``; a folder without markers (written by other tools,
or before there were markers) is its own current version.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

VERSIONS, MARKERS = "_versions", "_published"
# Earlier versions that stay for readers that opened them.
KEEP = 1


class _Folder:
    """The few file-system calls needed, on the path's own file system."""

    def __init__(self, spark: SparkSession, uri: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(uri).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> dict[str, int]:
        """Entries of a folder and their times in seconds; none for a missing one."""
        p, above = self._path(path), self._path(path).getParent()
        # Some file systems refuse to look for anything below a file.
        if above is not None and not (self.fs.exists(above) and self.fs.getFileStatus(above).isDirectory()):
            return {}
        if not self.fs.exists(p):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(p)}

    def touch(self, path: str) -> None:
        self.fs.create(self._path(path), False).close()

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def _markers(folder: _Folder, uri: str) -> list[str]:
    """Oldest first. Checksum files and other strangers are no markers."""
    names = [n for n in folder.names(f"{uri}/{MARKERS}") if n.partition(".")[0].isdigit() and n.partition(".")[2].startswith("v-")]
    return sorted(names, key=lambda n: (int(n.partition(".")[0]), n))


def versions(spark: SparkSession, uri: str) -> list[str]:
    """Paths of the published versions, the current one last."""
    uri = uri.rstrip("/")
    return [f"{uri}/{VERSIONS}/{m.partition('.')[2]}" for m in _markers(_Folder(spark, uri), uri)]


def published_path(spark: SparkSession, uri: str) -> str:
    """Where the current version's files are: a version's folder, or ``uri`` itself."""
    found = versions(spark, uri)
    return found[-1] if found else uri


def new_version(uri: str) -> str:
    """A folder for a version's files; nobody reads it before ``switch``."""
    return f"{uri.rstrip('/')}/{VERSIONS}/v-{uuid.uuid4().hex[:16]}"


def switch(spark: SparkSession, uri: str, version: str, keep: int = KEEP) -> None:
    """Make ``version`` the current one, then remove all but ``keep`` earlier ones and
    the plain files of a folder that had no versions."""
    uri = uri.rstrip("/")
    folder = _Folder(spark, uri)
    before = _markers(folder, uri)
    number = int(before[-1].partition(".")[0]) + 1 if before else 1
    folder.touch(f"{uri}/{MARKERS}/{number:012d}.{version.rsplit('/', 1)[-1]}")
    now = _markers(folder, uri)
    for marker in now[: max(0, len(now) - 1 - keep)]:
        # Files first: a marker without files would be a version that cannot be read back.
        folder.delete(f"{uri}/{VERSIONS}/{marker.partition('.')[2]}")
        folder.delete(f"{uri}/{MARKERS}/{marker}")
    for name in folder.names(uri):
        if name not in (VERSIONS, MARKERS):
            folder.delete(f"{uri}/{name}")


def sweep(spark: SparkSession, uri: str, older_than: float = 7 * 86_400) -> list[str]:
    """Remove files of versions that were never published and are older than so many
    seconds: what broken jobs left. Returns the names removed."""
    uri = uri.rstrip("/")
    folder = _Folder(spark, uri)
    known = {m.partition(".")[2] for m in _markers(folder, uri)}
    limit = time.time() - older_than
    gone = [n for n, t in folder.names(f"{uri}/{VERSIONS}").items() if n not in known and t <= limit]
    for name in gone:
        folder.delete(f"{uri}/{VERSIONS}/{name}")
    return gone


def publish_files(
    df: DataFrame, uri: str, fmt: str = "csv", header: bool = True, keep: int = KEEP, partition_by: Sequence[str] = ()
) -> str:
    """Write ``df`` as the next version of the publication at ``uri`` and switch to
    it. Inputs that do not exist, and tasks that fail, fail before the switch."""
    spark = df.sparkSession
    version = new_version(uri)
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", header)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(version)
    switch(spark, uri, version, keep)
    return uri
