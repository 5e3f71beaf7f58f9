"""How records of two versions are paired."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Match:
    """``id``: by one field's value; ``key``: by a hash of fields; ``content``: by a hash of the whole record."""

    by: str
    fields: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        wanted = {"id": len(self.fields) == 1, "key": len(self.fields) >= 1, "content": not self.fields}
        if self.by not in wanted:
            raise ValueError(f"records are matched by id, key or content, not {self.by!r}")
        if not wanted[self.by]:
            raise ValueError({"id": "an id is one field", "key": "a key needs a field", "content": "content matching has no fields"}[self.by])

    def describe(self) -> str:
        return {"id": "id field " + repr(self.fields[0] if self.fields else ""), "key": "key " + " + ".join(self.fields), "content": "whole-record content"}[self.by]

    def to_dict(self) -> dict[str, Any]:
        return {"by": self.by, "fields": list(self.fields)}
