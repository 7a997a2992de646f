"""Files in the shared folder: tasks write them whole under fresh names, and only files that a task has reported
are read, so a task that is run again, or whose executor is lost, leaves at most a file nobody reads."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that executors share."""
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends to files below a folder and starts a new one past ``limit`` bytes."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.system, self.path = opened(folder)
        self.system.create_dir(self.path)
        self.suffix, self.limit, self.out, self.name, self.size = suffix, limit, None, "", 0

    def append(self, data: bytes) -> tuple[str, int]:
        """Name of the file and place in it."""
        if self.out is None or self.size >= self.limit:
            self.close()
            self.name, self.size = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.system.open_output_stream(f"{self.path}/{self.name}", buffer_size=1 << 20)
        at, self.size = self.size, self.size + len(data)
        self.out.write(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Reader:
    """Byte ranges of files below a folder; keeps the last file open."""

    def __init__(self, folder: str):
        self.system, self.path = opened(folder)
        self.name, self.file = None, None

    def read(self, name: str, start: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.path}/{name}")
        self.file.seek(start)
        return self.file.read(length)

    def size(self, name: str) -> int:
        return self.system.get_file_info(f"{self.path}/{name}").size
