"""A sink for flat token files: a Spark data source that writes through any file system that the workers reach.

Each row is a file. A task writes under temporary names; the driver moves them to their names and writes the manifest
when all tasks have ended, so a task that fails or runs twice leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "shard string, data binary"


def file_system(folder: str):
    """``(file system, path)`` of a folder's URI or absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class TokenWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.width = options["path"], int(options["width"])

    def write(self, iterator: Iterator) -> Written:
        fs, root = file_system(self.folder)
        out = Written()
        for row in iterator:
            data = bytes(row["data"])
            temporary = f"{root}/_temporary/{uuid.uuid4().hex}"
            fs.create_dir(f"{root}/_temporary", recursive=True)
            with fs.open_output_stream(temporary, compression=None) as f:
                f.write(data)
            out.files.append({"temporary": temporary, "shard": row["shard"], "path": f"{root}/{row['shard']}.bin", "n_tokens": len(data) // self.width, "sha256": hashlib.sha256(data).hexdigest()})
        return out

    def commit(self, messages: list) -> None:
        fs, root = file_system(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        for f in files:
            fs.move(f.pop("temporary"), f["path"])
        fs.create_dir(f"{root}-manifest", recursive=True)
        with fs.open_output_stream(f"{root}-manifest/{uuid.uuid4().hex}.json", compression=None) as f:
            f.write("".join(json.dumps(x) + "\n" for x in files).encode())
        self._clear(fs, root)

    def abort(self, messages: list) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/_temporary").type == FileType.Directory:
            fs.delete_dir(f"{root}/_temporary")


class TokenFiles(DataSource):
    """``df.write.format("token_files").mode("append").option("width", 4).save(folder)`` for rows of :data:`SCHEMA`."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TokenWriter(self.options)
