"""JSON Pointers of record fields."""

from __future__ import annotations


def escape(segment: str) -> str:
    """A key as a pointer segment."""
    return segment.replace("~", "~0").replace("/", "~1")


def join(path: str, segment: str) -> str:
    return f"{path}/{escape(segment)}"


def split(name: str) -> list[str]:
    """Keys on the way to a field: a plain name is one top-level key, /a/b a pointer through objects."""
    if not name.startswith("/"):
        return [name]
    return [part.replace("~1", "/").replace("~0", "~") for part in name[1:].split("/")]
