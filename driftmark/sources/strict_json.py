"""JSON without the extensions that make a document ambiguous."""

from __future__ import annotations

import json
import math
from typing import Any, NoReturn

from ..functions.canonical import MAX_DIGITS


class StrictJsonError(ValueError):
    """A document that JSON decoders read differently."""


def _members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    members = dict(pairs)
    if len(members) < len(pairs):
        names = [k for k, _ in pairs]
        raise StrictJsonError(f"an object names {next(k for i, k in enumerate(names) if k in names[:i])!r} twice")
    return members


def _constant(text: str) -> NoReturn:
    raise StrictJsonError(f"{text} is not JSON")


def _number(text: str) -> float:
    if not math.isfinite(value := float(text)):
        raise StrictJsonError("a number beyond the range of a 64-bit float")
    return value


def _integer(text: str) -> int:
    if len(text.lstrip("-")) > MAX_DIGITS:
        raise StrictJsonError(f"an integer of more than {MAX_DIGITS} digits")
    return int(text)


_DECODER = json.JSONDecoder(object_pairs_hook=_members, parse_constant=_constant, parse_float=_number, parse_int=_integer)


def loads(text: str) -> Any:
    """Decode ``text``; ValueError for what is not strict JSON."""
    if text.startswith("﻿"):
        raise StrictJsonError("unexpected byte order mark")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        raise StrictJsonError("nested too deeply") from None
