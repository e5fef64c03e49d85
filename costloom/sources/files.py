"""Files of a shared folder, for the Python sides of data sources: ``pyarrow.fs`` by URI."""

from __future__ import annotations

import re
import sys

from pyarrow import fs
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark spells it (``file:/x`` and ``file:///x`` are the same)."""
    plain = re.sub(r"^file:/*", "/", uri)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(uri)


def names_in(store: fs.FileSystem, path: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File)


def read_all(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_file(path) as f:
        return f.read()


def write_all(store: fs.FileSystem, path: str, data: bytes) -> None:
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)
