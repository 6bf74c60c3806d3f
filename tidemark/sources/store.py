"""Files by byte range, in any store that Arrow knows: listing, reading from the first place that can give, writing safely."""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyarrow import fs

#: Bytes that are fetched together while a file is read through.
FETCH = 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Local URIs are Hadoop's: a percent sign in them stands for itself."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    path = f"s3{path[3:]}" if path.startswith(("s3a:", "s3n:")) else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(paths: str | Sequence[str]) -> list[tuple[str, int]]:
    """(path, bytes) of files, of files below folders, and of files that patterns match, in order; names that begin with ``_`` or ``.`` are no files."""
    out: dict[str, int] = {}
    for given in [paths] if isinstance(paths, str) else paths:
        files, path = located(given)
        prefix = given[: len(given) - len(path)] if given.endswith(path) else given.split(":", 1)[0] + "://"
        parts = path.split("/")
        fixed = next((k for k, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
        if fixed < len(parts):
            found = [f for f in files.get_file_info(fs.FileSelector("/".join(parts[:fixed]) or "/", recursive=True)) if f.path.count("/") == path.count("/") and fnmatch.fnmatchcase(f.path, path)]
        else:
            info = files.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(given)
            found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
        out |= {prefix + f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "_."}
    return sorted(out.items())


#: A range of a file as a path: what is stored there is read as a file of the name that ends the path.
_RANGE = re.compile(r"^(.*)!(\d+)\+(\d+)/([^/]+)$")


def inside(path: str, offset: int, size: int, name: str) -> str:
    """The path of a range of a file."""
    return f"{path}!{offset}+{size}/{name}"


class Opened:
    """A file, or a range of one (``inside``), that is read by byte ranges. ``taken`` counts the bytes that were asked of the store."""

    def __init__(self, path: str):
        m = _RANGE.match(path)
        files, inner = located(m[1] if m else path)
        self.file = files.open_input_file(inner)
        self.base, self.size = (int(m[2]), int(m[3])) if m else (0, self.file.size())
        self.taken = 0

    def read(self, offset: int, length: int) -> bytes:
        out = self.file.read_at(max(0, min(length, self.size - offset)), self.base + offset) if offset < self.size else b""
        self.taken += len(out)
        return out

    def through(self, offset: int, stop: int | None = None, fetch: int = FETCH) -> Iterator[bytes]:
        """The bytes from offset on, up to ``stop``, piece by piece."""
        stop = self.size if stop is None else min(stop, self.size)
        while offset < stop:
            part = self.read(offset, min(fetch, stop - offset))
            if not part:
                return
            yield part
            offset += len(part)

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


class Held:
    """Bytes of a file from ``base`` on, read as a file is."""

    def __init__(self, data: bytes, base: int = 0):
        self.data, self.base, self.size = data, base, base + len(data)

    def read(self, offset: int, length: int) -> bytes:
        return self.data[offset - self.base : offset - self.base + length]

    through = Opened.through


def first_readable(places: Sequence[str], work: Callable[[Opened], object]) -> object:
    """What ``work`` makes of the first place that it can read; the last place's error if it can read none."""
    failed: Exception = FileNotFoundError("no place is known")
    for place in places:
        try:
            with Opened(place) as f:
                return work(f)
        except (OSError, EOFError, ValueError) as e:
            failed = e
    raise failed


class Draft:
    """A file that is there, whole, once it is closed: it is written under another name and moved, so a repeated task replaces it."""

    def __init__(self, path: str):
        self.files, self.path = located(path)
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.name = f"{self.path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.open"
        self.out = self.files.open_output_stream(self.name, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.files.move(self.name, self.path)


def folders(path: str, name: str) -> set[int]:
    """The numbers k of the folders ``name=k`` in a folder; of one that is not there, none."""
    files, inner = located(path)
    found = files.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return {int(f.base_name.split("=", 1)[1]) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{name}=")}


def moved(path: str, to: str) -> None:
    files, inner = located(path)
    files.move(inner, located(to)[1])


def removed(path: str) -> None:
    """A folder that goes; one that is gone is no error."""
    files, inner = located(path)
    if files.get_file_info(inner).type == fs.FileType.Directory:
        files.delete_dir(inner)
