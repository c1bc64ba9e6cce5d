"""Writes of tasks that are seen only when their job commits.

Tasks write below a hidden folder of the job, which the driver makes before they start. A task makes only its own folder in
it and never the job's, so that one that outlives an aborted job can't bring it back.
"""

from __future__ import annotations

import os
import re
import time
import uuid

#: Seconds after which what a dead job left behind may go.
STALE = 7 * 86_400


def store_of(path: str):
    """(file system, path within it, prefix that makes it whole again)."""
    from pyarrow import fs

    path = re.sub(r"^file:(//)?", "", path)
    if not re.match(r"[a-zA-Z][\w+.-]+:", path):
        return fs.LocalFileSystem(), os.path.abspath(path), ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path.removesuffix(inner)


class Staging:
    """The hidden folder of one job that writes to path."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex
        store, inner, _ = store_of(path)
        store.create_dir(f"{inner}/_temporary/{self.job}", recursive=True)

    def task_folder(self) -> str:
        """A new folder for this attempt of this task; fails once the job has ended."""
        from pyspark import TaskContext

        store, inner, _ = store_of(self.path)
        folder = f"{inner}/_temporary/{self.job}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(folder, recursive=False)
        return folder

    def publish(self, files: list[str], old: list[str] = ()) -> None:
        """Move files of tasks into place, then delete old ones: a crash between leaves both, never neither."""
        store, inner, _ = store_of(self.path)
        new = {f"{inner}/{os.path.basename(f)}": f for f in files}
        for to, f in new.items():
            store.move(f, to)
        for f in old:
            if f not in new:
                store.delete_file(f)
        self.discard()

    def discard(self) -> None:
        """Remove the job's folder, and those that dead jobs left long ago."""
        from pyarrow import fs

        store, inner, _ = store_of(self.path)
        top = f"{inner}/_temporary"
        _remove(store, f"{top}/{self.job}")
        for other in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if other.mtime_ns is not None and time.time() - other.mtime_ns / 1e9 > STALE:
                _remove(store, other.path)
        if store.get_file_info(top).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(top)):
            try:
                store.delete_dir(top)
            except OSError:  # another job has just begun in it
                pass


def _remove(store, folder: str) -> None:
    """Delete a folder in which a task that was just killed may still be writing a file."""
    from pyarrow import fs

    for wait in (0.0, 0.1, 0.5, 2.0):
        time.sleep(wait)
        if store.get_file_info(folder).type != fs.FileType.Directory:
            return
        try:
            store.delete_dir(folder)
        except OSError:
            continue
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)
