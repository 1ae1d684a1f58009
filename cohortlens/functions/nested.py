"""JSON nested to any depth, as texts: what path expressions of a fixed depth can't reach."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf_text(value: object, keys: tuple[str, ...]) -> str:
    """The scalars below a parsed JSON value, trimmed, a line each, in order: of a list all items, of an object what stands under
    the first of `keys` that it has. Nulls and blanks give no line."""
    lines, waiting = [], [value]
    while waiting:
        item = waiting.pop()
        if isinstance(item, list):
            waiting.extend(reversed(item))
        elif isinstance(item, dict):
            waiting.extend([item[k] for k in keys if k in item][:1])
        elif item is not None and str(item).strip():
            lines.append(str(item).strip())
    return "\n".join(lines)


def without_fields(value: object, names: frozenset[str]) -> object:
    """A parsed JSON value without the object fields of these names, at any depth."""
    root = [value]
    waiting = [root]
    while waiting:
        inside = waiting.pop()
        for key, item in list(enumerate(inside) if isinstance(inside, list) else inside.items()):
            if isinstance(item, dict):
                inside[key] = item = {k: v for k, v in item.items() if k not in names}
            if isinstance(item, dict | list):
                waiting.append(item)
    return root[0]


def texts_of(contents: Column, keys: tuple[str, ...]) -> Column:
    """leaf_text of each item of an array of JSON texts, as array<string>; null items are empty texts."""

    @F.arrow_udf("array<string>")
    def texts(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            rows = [None if row is None else [leaf_text(None if x is None else json.loads(x), keys) for x in row] for row in array.to_pylist()]
            yield pa.array(rows, pa.list_(pa.string()))

    return texts(contents)


def dropped(raw: Column, names: tuple[str, ...]) -> Column:
    """JSON text without the object fields of these names, at any depth, with the remaining keys in their order; what isn't JSON
    stays as it is."""
    gone = frozenset(names)

    @F.arrow_udf("string")
    def cut(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            out = []
            for text in array.to_pylist():
                try:
                    out.append(None if text is None else json.dumps(without_fields(json.loads(text), gone), ensure_ascii=False, separators=(",", ":")))
                except ValueError:
                    out.append(text)
            yield pa.array(out, pa.string())

    return cut(raw)
