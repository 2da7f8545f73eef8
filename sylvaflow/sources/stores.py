"""Files in any store that Arrow reaches, read by byte range and published by a manifest."""

from __future__ import annotations

import json

from pyarrow import fs

MANIFEST = "manifest.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_range(path: str, start: int, size: int) -> bytes:
    store, name = opened(path)
    with store.open_input_file(name) as f:
        return f.read_at(size, start)


def write_bytes(path: str, data: bytes) -> None:
    store, name = opened(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as f:
        f.write(data)


def files(path: str, ending: str) -> list[str]:
    """The files that a folder's manifest lists; without one, those with the ending, by name; or the file itself."""
    store, name = opened(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    root = path.rstrip("/")
    if store.get_file_info(f"{name}/{MANIFEST}").type == fs.FileType.File:
        with store.open_input_file(f"{name}/{MANIFEST}") as f:
            return [f"{root}/{x}" for x in json.loads(f.read())["files"]]
    found = store.get_file_info(fs.FileSelector(name))
    return sorted(f"{root}/{i.base_name}" for i in found if i.type == fs.FileType.File and i.base_name.endswith(ending))


def publish(path: str, names: list[str], **more) -> None:
    """The manifest, written last: readers see all files of a write or those before it."""
    write_bytes(f"{path.rstrip('/')}/{MANIFEST}", json.dumps({"files": names, **more}).encode())


def remove(path: str, names: list[str]) -> None:
    store, root = opened(path)
    for name in names:
        if store.get_file_info(f"{root.rstrip('/')}/{name}").type == fs.FileType.File:
            store.delete_file(f"{root.rstrip('/')}/{name}")
