"""Keys of an object's sections by a strict JSON parser, in Arrow batches (the JVM's parser accepts what follows a document)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F


def _refuse(name: str) -> None:
    raise ValueError(name)


def section_keys(sections: tuple[str, ...]):
    """A column function: the keys of the named sections that are objects, in order; none for malformed JSON."""

    @F.arrow_udf("array<string>")
    def keys(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                top = json.loads(t, parse_constant=_refuse) if t is not None else {}
            except (ValueError, RecursionError):
                top = {}
            out.append([k for s in sections if isinstance(top, dict) and isinstance(top.get(s), dict) for k in top[s]])
        return pa.array(out, pa.list_(pa.string()))

    return keys
