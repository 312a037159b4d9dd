"""Reading a dataset directory that nobody vouches for: flat names, regular files, no links, bounded sizes."""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

CONTROL_BYTES, DATA_BYTES, MAX_ENTRIES, LINE_CHARS = 4 << 20, 256 << 20, 512, 1 << 20
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,254}")


class DatasetError(ValueError):
    """A file or directory is not what a dataset may hold."""


def safe_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise DatasetError(f"{name!r} is no flat file name")
    return name


@dataclass
class Reader:
    """Files of one directory, opened relative to it."""

    root: Path

    def __enter__(self) -> Reader:
        self.fd = os.open(self.root, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW)
        return self

    def __exit__(self, *_) -> None:
        os.close(self.fd)

    def entries(self) -> list[tuple[str, str]]:
        """(name, kind) of what the directory holds."""
        names = os.listdir(self.fd)
        if len(names) > MAX_ENTRIES:
            raise DatasetError(f"more than {MAX_ENTRIES} entries")
        kinds = ((stat.S_ISREG, "file"), (stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "directory"))
        out = []
        for n in sorted(names):
            mode = os.stat(n, dir_fd=self.fd, follow_symlinks=False).st_mode
            out.append((n, next((k for test, k in kinds if test(mode)), "special")))
        return out

    def _open(self, name: str, limit: int):
        try:
            fd = os.open(safe_name(name), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=self.fd)
        except OSError as why:
            raise DatasetError(f"{name}: cannot be read ({why.strerror})") from None
        held = os.fstat(fd)
        if not stat.S_ISREG(held.st_mode) or held.st_size > limit:
            os.close(fd)
            raise DatasetError(f"{name}: " + ("not a regular file" if not stat.S_ISREG(held.st_mode) else f"more than {limit} bytes"))
        return os.fdopen(fd, "rb")

    def chunks(self, name: str, limit: int) -> Iterator[bytes]:
        with self._open(name, limit) as f:
            before, total = os.fstat(f.fileno()), 0
            while chunk := f.read(1 << 20):
                total += len(chunk)
                if total > limit:
                    raise DatasetError(f"{name}: more than {limit} bytes")
                yield chunk
            after = os.fstat(f.fileno())
            if (before.st_mtime_ns, before.st_size) != (after.st_mtime_ns, after.st_size):
                raise DatasetError(f"{name}: changed while it was read")

    def text(self, name: str) -> str:
        raw = b"".join(self.chunks(name, CONTROL_BYTES))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            raise DatasetError(f"{name}: not UTF-8") from None

    def digest(self, name: str, limit: int = DATA_BYTES) -> tuple[str, int]:
        h, n = hashlib.sha256(), 0
        for chunk in self.chunks(name, limit):
            h.update(chunk)
            n += len(chunk)
        return h.hexdigest(), n


def parse_sums(text: str) -> dict[str, str]:
    """path -> digest of a list of sums; a path stands in it once."""
    out: dict[str, str] = {}
    for n, line in enumerate(text.splitlines(), 1):
        m = re.fullmatch(r"([0-9a-f]{64})  (.+)", line)
        if not m or m[2] in out:
            raise DatasetError(f"line {n} of the sums is malformed, or repeats a path")
        out[safe_name(m[2])] = m[1]
    return out
