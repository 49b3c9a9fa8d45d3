"""Files that tasks write and read themselves, in any store that a URI names."""

from __future__ import annotations

import pyarrow.fs
from pyspark import TaskContext


def at(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def put(folder: str, name: str, chunks) -> int:
    """Write one file. It appears under its name only when whole, so a task that is run again leaves no half file."""
    fs, path = at(folder)
    fs.create_dir(path, recursive=True)
    context = TaskContext.get()
    draft = f"{path}/.{name}.{context.taskAttemptId() if context else 0}"
    size = 0
    with fs.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(draft, f"{path}/{name}")
    return size


def names(folder: str, ending: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files in a folder, in order of name."""
    fs, path = at(folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(path))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(ending) and not f.base_name.startswith("."))
