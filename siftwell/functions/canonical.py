"""JSON values, pointers and identities: the small pure functions everything else rests on."""

from __future__ import annotations

import hashlib
import json
import math
import re

#: Sent with every request and part of its identity, whichever evaluator answers.
ENDPOINT = "siftwell:field-choice/1"
_INDEX = re.compile(r"0|[1-9][0-9]*")
_MISSING = object()
_WRITE = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode


class InvalidValue(ValueError):
    """A value that JSON can't hold, or a malformed pointer."""


def canonical(value: object) -> str:
    """JSON text with sorted keys and no spaces; non-ASCII stays, NaN and infinities are errors."""
    return _WRITE(value)


def check_json(value: object, depth: int = 200) -> object:
    """value itself, if it's a JSON value: no cycles, no NaN, string keys, at most `depth` levels."""

    def visit(x: object, level: int, above: frozenset[int]) -> None:
        if x is None or isinstance(x, bool | int | str):
            return
        if isinstance(x, float):
            if not math.isfinite(x):
                raise InvalidValue("numbers must be finite")
            return
        if not isinstance(x, list | dict):
            raise InvalidValue(f"{type(x).__name__} is not a JSON value")
        if id(x) in above:
            raise InvalidValue("values must not contain themselves")
        if level >= depth:
            raise InvalidValue("value is nested too deeply")
        inside = above | {id(x)}
        if isinstance(x, dict):
            for k, v in x.items():
                if not isinstance(k, str):
                    raise InvalidValue("object keys must be strings")
                visit(v, level + 1, inside)
        else:
            for v in x:
                visit(v, level + 1, inside)

    visit(value, 0, frozenset())
    return value


def pointer_key(key: str) -> str:
    """A key as one token of a pointer."""
    return key.replace("~", "~0").replace("/", "~1")


def pointer_tokens(pointer: str) -> list[str]:
    """The tokens of an RFC 6901 pointer; '' has none."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise InvalidValue(f"pointer must be empty or start with /: {pointer!r}")
    found = pointer[1:].split("/")
    if "~" not in pointer:
        return found
    if any(re.search(r"~(?![01])", x) for x in found):
        raise InvalidValue(f"bad escape in pointer {pointer!r}")
    return [x.replace("~1", "/").replace("~0", "~") for x in found]


def resolve(value: object, pointer: str, default: object = _MISSING) -> object:
    """What pointer leads to; default, or LookupError, where it leads nowhere. A bad pointer is always an error."""
    for token in pointer_tokens(pointer):
        if isinstance(value, dict) and token in value:
            value = value[token]
        elif isinstance(value, list) and _INDEX.fullmatch(token) and int(token) < len(value):
            value = value[int(token)]
        elif default is not _MISSING:
            return default
        else:
            raise LookupError(pointer)
    return value


def present(value: object, pointer: str) -> bool:
    """Whether pointer leads anywhere; null counts as something."""
    nowhere = object()
    return resolve(value, pointer, nowhere) is not nowhere


def scalar_id(value: object) -> str:
    """A nonempty scalar as an id: 0, false and "0001" are fine; null, "", lists and objects aren't."""
    if value is None or value == "" or isinstance(value, list | dict):
        raise InvalidValue("an id must be a nonempty scalar")
    return str(value)


def default_fields(value: object) -> list[str]:
    """Pointers of the top-level keys of an object; of anything else, the root."""
    return [f"/{pointer_key(k)}" for k in value] if isinstance(value, dict) and value else [""]


def tokens_of(text: str) -> int:
    """A cautious estimate of a JSON text's tokens."""
    return -(-len(text.encode()) // 2) + 16


def request_key(request: dict) -> str:
    """The identity of a request: a hash of its canonical text with the endpoint."""
    return hashlib.sha256(canonical({"endpoint": ENDPOINT, "request": request}).encode()).hexdigest()
