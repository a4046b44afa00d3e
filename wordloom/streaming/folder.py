"""A folder of files as a stream whose offset is what was seen: each path with its time and size.

A file is offered when its stamp is new, so a changed file comes again; one that is empty, or whose stamp moves within
``settle`` seconds, is still being written and waits for a later poll.  The offset is part of the checkpoint, so a restart
goes on where the last batch ended.  Files are listed by the driver and read by the tasks, at most BATCH_BYTES or one file each.
"""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import archive

BATCH_BYTES = 64 << 20
Stamps = dict[str, str]


class FolderSource(DataSource):
    """Options: path, glob (of file names, any case) and settle (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "settled_folder"

    def schema(self) -> str:
        return archive.FILES

    def streamReader(self, schema) -> FolderReader:  # noqa: N802 - Spark's name
        return FolderReader(self.options["path"], self.options.get("glob", "*"), float(self.options.get("settle", 1)))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def stamps(folder: str, glob: str) -> Stamps:
    """Time and size of each file below a folder whose name matches, empty ones left out."""
    from pyarrow import fs

    files, top = _opened(folder)
    found = files.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    wanted = [f for f in found if f.type == fs.FileType.File and f.size and fnmatch.fnmatch(f.base_name.lower(), glob.lower())]
    return {f.path: f"{f.mtime_ns}:{f.size}" for f in sorted(wanted, key=lambda f: f.path)}


class FolderReader(DataSourceStreamReader):
    def __init__(self, folder: str, glob: str, settle: float):
        self.folder, self.glob, self.settle = folder, glob, settle
        self.last: Stamps = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        seen = stamps(self.folder, self.glob)
        if any(self.last.get(p) != s for p, s in seen.items()):
            time.sleep(self.settle)
            again = stamps(self.folder, self.glob)
            # What still moves keeps the stamp that it was last offered with.
            seen = {p: s if again.get(p) == s else self.last.get(p) for p, s in seen.items() if p in again}
        self.last = {p: s for p, s in seen.items() if s}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        out, size = [], 0
        for path in sorted(p for p, s in end.items() if start.get(p) != s):
            own = int(end[path].split(":")[1])
            if not out or size + own > BATCH_BYTES:
                out, size = [*out, Files([])], 0
            out[-1].paths.append(path)
            size += own
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _opened(self.folder)
        for path in partition.paths:
            try:
                info = files.get_file_info(path)
                with files.open_input_stream(path) as f:
                    content = f.read()
            except FileNotFoundError:  # gone since it was listed: nothing to offer
                continue
            yield path, datetime.fromtimestamp(info.mtime_ns / 1e9, UTC), len(content), content

    def commit(self, end: dict) -> None:
        """Nothing is kept that a batch's end could release."""
