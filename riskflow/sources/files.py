"""Files named by path or URI, on the driver and in tasks."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and what the file is called there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def files_in(path: str) -> list[str]:
    """Full names of a folder's files in order, or of the one file; hidden ones left out."""
    files, inner = located(path)
    info = files.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(inner))
    names = sorted(i.path for i in found if i.is_file and not i.base_name.startswith(("_", ".")))
    # File systems name files without the scheme and host they were asked by.
    start = path.rstrip("/").removesuffix(inner.rstrip("/"))
    return [start + name for name in names]


def write_once(path: str, text: str) -> bool:
    """Write a small file whole or not at all; False if it is there already."""
    files, inner = located(path)
    if files.get_file_info(inner).type != fs.FileType.NotFound:
        return False
    files.create_dir(inner.rsplit("/", 1)[0])
    unfinished = f"{inner}.unfinished"
    with files.open_output_stream(unfinished) as stream:
        stream.write(text.encode())
    files.move(unfinished, inner)
    return True


def read_small(path: str) -> str | None:
    """The text of a small file; None if there is none."""
    files, inner = located(path)
    if files.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(inner) as stream:
        return stream.read().decode()


def delete(path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, inner = located(path)
    kind = files.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        files.delete_dir(inner)
    elif kind == fs.FileType.File:
        files.delete_file(inner)
