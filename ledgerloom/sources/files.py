"""Single files on any file system that Arrow knows (local, hdfs, s3, gs, abfs), by URI."""

from __future__ import annotations

import os
import posixpath
import uuid

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain path is a local one. An unknown scheme is an error."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), posixpath.abspath(uri)


def read(uri: str) -> bytes | None:
    """The bytes of a file, or None where there is none."""
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


def put(uri: str, data: bytes) -> None:
    """Write a whole file under a name of its own, then move it into place, so that a retried or doubled task is harmless."""
    fs, path = open_fs(uri)
    folder, name = posixpath.split(path)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def remove(uri: str) -> bool:
    """Delete a file; whether there was one."""
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type != pafs.FileType.File:
        return False
    fs.delete_file(path)
    return True


def remove_folder(uri: str) -> None:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def names(uri: str, deep: bool = False) -> list[str]:
    """Names of what lies in a folder (``deep``: and below, as paths from it), in order, without hidden ones; none if there is no such folder."""
    fs, path = open_fs(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=deep))
    return sorted(posixpath.relpath(f.path, path) for f in found if not f.base_name.startswith("."))


def inside(path: str) -> bool:
    """Whether a relative path stays in its folder."""
    return bool(path) and not path.startswith("/") and ".." not in path.split("/")


def create(uri: str, data: bytes) -> bool:
    """Write a file only where there is none; whether this call did. Of several at once, one does."""
    fs, path = open_fs(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        raise NotImplementedError(f"no file system for exclusive creation: {uri}")
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    try:
        os.link(part, path)  # a whole file or none, and never over another
    except FileExistsError:
        return False
    finally:
        os.unlink(part)
    return True
