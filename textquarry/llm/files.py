"""Files in the shared folder, from the driver or a task, through pyarrow: local, hdfs, s3 or gs paths."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Committed:
    """A file that is written under a temporary name of its own and gets its final name when it is whole.

    A task that runs twice, or at the same time as its twin, makes equal bytes for the same name: where a store does not
    rename onto a name that is there, the file that is there stays.
    """

    def __init__(self, folder: str, name: str):
        self.fs, path = at(folder)
        self.fs.create_dir(path, recursive=True)
        self.final, self.temp = f"{path}/{name}", f"{path}/.tmp-{uuid.uuid4().hex}-{name}"
        self.out, self.size = self.fs.open_output_stream(self.temp), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.temp, self.final)
        except OSError:
            there = self.fs.get_file_info(self.final)
            if there.type != fs.FileType.File or there.size != self.size:
                raise
            self.fs.delete_file(self.temp)

    def abort(self) -> None:
        """The file is not to be: nothing of it stays."""
        self.out.close()
        with contextlib.suppress(OSError):
            self.fs.delete_file(self.temp)
