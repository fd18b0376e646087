"""Files that tasks write once, in a folder that all machines share."""

from __future__ import annotations

import uuid

from pyarrow import fs


class Shelf:
    """Files by name in ``folder`` (a local path, or an address that pyarrow can open).

    A file is written under a name of its own and then moved, so it is there whole or not at all. A name is meant to
    be put once: two tasks that put the same name at the same time both succeed and the last one's file stays.
    """

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)

    def has(self, name: str) -> bool:
        return self.files.get_file_info(f"{self.folder}/{name}").type == fs.FileType.File

    def names(self) -> list[str]:
        """All files but drafts, in order."""
        found = self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def read(self, name: str) -> bytes:
        with self.files.open_input_stream(f"{self.folder}/{name}") as f:
            return f.read()

    def draft(self, data: bytes) -> str:
        """Write data that has no name yet; returns what ``keep`` and ``drop`` know it by."""
        self.files.create_dir(f"{self.folder}/_drafts", recursive=True)
        draft = f"{self.folder}/_drafts/{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as f:
            f.write(data)
        return draft

    def keep(self, draft: str, name: str) -> None:
        self.files.move(draft, f"{self.folder}/{name}")

    def drop(self, draft: str) -> None:
        if self.files.get_file_info(draft).type == fs.FileType.File:
            self.files.delete_file(draft)

    def put(self, name: str, data: bytes) -> None:
        self.keep(self.draft(data), name)

    def remove(self, name: str) -> None:
        self.files.delete_file(f"{self.folder}/{name}")
