"""Which files stand behind given paths, without a job or a read for each path.

A path is first taken literally, then as a glob. A folder stands for all files below it, except hidden ones. What
cannot be read is listed with a reason, so that no file vanishes unreported.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

FILES = "source STRING, source_idx INT, path STRING, length BIGINT, modified_at TIMESTAMP"

_GLOB_CHARACTERS = "\\{}[]*?"


@dataclass(frozen=True)
class Listing:
    """``files``: (path, length, modified) in order; ``roots``: literal paths that cover them; ``missing``: (given, reason)."""

    files: list[tuple[str, int, datetime]]
    roots: list[str]
    missing: list[tuple[str, str]]

    def table(self, spark: SparkSession) -> DataFrame:
        """``source, source_idx, path, length, modified_at``; ``source`` is the path without a local scheme."""
        rows = [(plain_path(p), i, p, n, at) for i, (p, n, at) in enumerate(self.files)]
        return spark.createDataFrame(rows, FILES)


def plain_path(path: str) -> str:
    if not path.startswith("file:/"):
        return path
    return "/" + path.removeprefix("file:").lstrip("/")


def escaped(path: str) -> str:
    """The path as a glob that only matches itself."""
    return "".join("\\" + c if c in _GLOB_CHARACTERS else c for c in path)


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def list_sources(spark: SparkSession, paths: Sequence[str]) -> Listing:
    """Files of all paths, each once, in the order given and by name below one path."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    conf = context._jsc.hadoopConfiguration()
    found: dict[str, tuple[int, datetime]] = {}
    roots: dict[str, None] = {}
    missing: list[tuple[str, str]] = []
    for given in dict.fromkeys(paths):
        try:
            place = hadoop.Path(given)
            system = place.getFileSystem(conf)
            literal = system.exists(place)
            matches = [system.getFileStatus(place)] if literal else [m for m in system.globStatus(place) or [] if not _hidden(m.getPath().getName())]
            if not matches:
                missing.append((given, f"FileNotFoundError: {given}"))
            for status in matches:
                root = status.getPath()
                if status.isFile():
                    if literal and _hidden(root.getName()):
                        missing.append((plain_path(root.toString()), "OSError: a name that starts with _ or . is not read"))
                        continue
                    statuses = [status]
                else:
                    statuses = sorted(_below(system, root), key=lambda s: s.getPath().toString())
                roots[root.toString()] = None
                for file in statuses:
                    at = datetime.fromtimestamp(file.getModificationTime() / 1000, timezone.utc)
                    found.setdefault(file.getPath().toString(), (file.getLen(), at))
        except Exception as error:  # noqa: BLE001 (whatever the file system says is the reason)
            missing.append((given, f"OSError: {str(error).splitlines()[0]}"))
    kept = [r for r in roots if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in _parents(r, roots))]
    return Listing([(p, n, at) for p, (n, at) in found.items()], kept, missing)


def _parents(path: str, roots: dict[str, None]) -> list[str]:
    """The roots among the folders above a path."""
    parts = path.split("/")
    return [p for i in range(1, len(parts)) if (p := "/".join(parts[:i]) or "/") in roots]


def _below(system, root) -> list:  # noqa: ANN001 (JVM objects)
    depth = len(root.toString().rstrip("/").split("/"))
    files, walk = [], system.listFiles(root, True)
    while walk.hasNext():
        status = walk.next()
        if not any(map(_hidden, status.getPath().toString().split("/")[depth:])):
            files.append(status)
    return files
