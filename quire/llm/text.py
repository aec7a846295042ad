"""Word splitting shared by the operators that read texts in Python tasks."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs

#: Lower-cases A-Z and turns every ASCII byte outside 0-9a-z into a space; other bytes stay.
_WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after A-Z are lower-cased; null has none."""
    return raw.translate(_WORD_TABLE).split() if raw else []


def space_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text after A-Z are lower-cased; null has none."""
    return raw.lower().split() if raw else []


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path there."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
