"""A workspace as a Spark data source: files listed and read by the tasks, and a stream of what was saved since.

The driver lists folders breadth first until there are enough of them to deal out, and no further; a task walks its folder.
"""

from __future__ import annotations

import json
import os
import time
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from auditweave import catalog

#: Folders that are dealt out at least, if there are as many.
FOLDERS = 64


class Folder(InputPartition):
    """One folder of a workspace: with all below it, or its own files only."""

    def __init__(self, workspace: str, root: str, path: str, whole: bool, since: int = -1, until: int | None = None):
        self.workspace, self.root, self.path, self.whole, self.since, self.until = workspace, root, path, whole, since, until


def dealt(roots: dict[str, str], folders: int = FOLDERS) -> list[Folder]:
    """The workspaces' folders; one that is listed here leaves its subfolders, and itself for its own files."""
    open_, out = deque((name, root, root) for name, root in roots.items()), []
    while open_ and len(open_) + len(out) < folders:
        name, root, path = open_.popleft()
        try:
            below = sorted(e.name for e in os.scandir(path) if e.is_dir(follow_symlinks=False) and e.name not in catalog.EXCLUDED_DIRS)
        except OSError:
            continue
        out.append(Folder(name, root, path, False))
        open_.extend((name, root, os.path.join(path, n)) for n in below)
    return out + [Folder(*f, True) for f in open_]


def walk(part: Folder | None, several: bool, extensions: tuple[str, ...]) -> Iterator[tuple[str, str, os.stat_result]]:
    """(absolute path, path relative to its workspace, stat) of a folder's source files; several workspaces prefix their names.

    Spark reads no folder at all as None.
    """
    if part is None:
        return
    for folder, below, names in os.walk(part.path):
        below[:] = [d for d in below if part.whole and d not in catalog.EXCLUDED_DIRS]
        for n in names:
            if n.lower().endswith(extensions):
                path = os.path.join(folder, n)
                try:
                    stat = os.stat(path)
                except OSError:
                    continue
                if stat.st_mtime_ns > part.since and (part.until is None or stat.st_mtime_ns <= part.until):
                    relative = os.path.relpath(path, part.root).replace(os.sep, "/")
                    yield path, f"{part.workspace}/{relative}" if several else relative, stat


class Options:
    """roots: JSON of workspace name -> folder; extensions: comma-joined; largest: bytes of a text that is read."""

    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.extensions = tuple((options.get("extensions") or ",".join(e for exts in catalog.EXTENSIONS.values() for e in exts)).split(","))
        self.largest = int(options.get("largest") or catalog.MAX_FILE_BYTES)


class Files(DataSourceReader):
    """All files' names, without their texts."""

    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[Folder]:
        return dealt(self.options.roots)

    def read(self, part: Folder) -> Iterator[tuple]:
        for path, relative, _ in walk(part, len(self.options.roots) > 1, self.options.extensions):
            yield path, relative


class Saves(DataSourceStreamReader):
    """Files by when they were last saved; an offset is a time, so no list of files is kept."""

    def __init__(self, options: Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"at": -1}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        out = dealt(self.options.roots)
        for part in out:
            part.since, part.until = start["at"], end["at"]
        return out

    def read(self, part: Folder) -> Iterator[tuple]:
        for path, relative, stat in walk(part, len(self.options.roots) > 1, self.options.extensions):
            if stat.st_size <= self.options.largest:
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        text = f.read()
                except OSError:
                    continue
                yield path, relative, text, stat.st_mtime_ns, "save", datetime.fromtimestamp(stat.st_mtime, timezone.utc)

    def commit(self, end: dict) -> None:
        pass


class WorkspaceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "absolute_path string, relative_path string"

    def reader(self, schema) -> Files:
        return Files(Options(self.options))


class WorkspaceSaves(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace-saves"

    def schema(self) -> str:
        return "absolute_path string, relative_path string, text string, version long, op string, ts timestamp"

    def streamReader(self, schema) -> Saves:
        return Saves(Options(self.options))


def register(spark: SparkSession) -> None:
    for source in (WorkspaceFiles, WorkspaceSaves):
        spark.dataSource.register(source)
