"""Names of streams: what a run's seed and declarations contribute to the key of every site."""

from __future__ import annotations

import struct

MAJOR = 0


def stream_prefix(seed: int, pack: str, version: str, recipe: str, major: int = MAJOR) -> bytes:
    """The bytes before the site: seed as eight bytes, big-endian, then the names, each behind a zero byte."""
    if not 0 <= seed < 1 << 64:
        raise ValueError(f"seed {seed} is outside 0..2^64-1")
    parts = [str(major), pack, version, recipe]
    if any("\0" in p for p in parts):
        raise ValueError("a name holds a zero byte")
    return struct.pack(">Q", seed) + b"".join(b"\0" + p.encode("utf-8") for p in parts) + b"\0"
