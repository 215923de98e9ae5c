"""Keys of JSON texts at any depth: repeated ones, which a parsed value no longer shows, and forbidden ones."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame


class Pairs(list):
    """An object as its pairs in the order of the text, repeated keys included."""


def key_faults(text: str, forbidden: frozenset[str]) -> list[tuple[str, str]]:
    """(fault, path) of one text: INVALID, REPEATED (once for every key that an object holds again), FORBIDDEN.

    Keys are compared with ``forbidden`` in lower case, with blanks and hyphens as underscores.
    """
    try:
        todo = [("", json.loads(text, object_pairs_hook=Pairs))]
    except (ValueError, RecursionError):
        return [("INVALID", "")]
    out = []
    while todo:
        path, value = todo.pop()
        if isinstance(value, Pairs):
            seen, said = set(), set()
            for key, child in value:
                at = f"{path}/{key}"
                if key in seen and key not in said:
                    said.add(key)
                    out.append(("REPEATED", at))
                if key not in seen and key.lower().replace("-", "_").replace(" ", "_") in forbidden:
                    out.append(("FORBIDDEN", at))
                seen.add(key)
                todo.append((at, child))
        elif isinstance(value, list):
            todo += [(f"{path}/{i}", child) for i, child in enumerate(value)]
    return sorted(out)


def scanned(df: DataFrame, key: str, text: str, forbidden: set[str]) -> DataFrame:
    """key, fault, path of every fault in the JSON texts of a column, in one pass over Arrow batches; a null text has none."""
    denied, kind = frozenset(forbidden), dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            at, faults, paths = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for fault, path in key_faults(t, denied) if t is not None else ():
                    at.append(i)
                    faults.append(fault)
                    paths.append(path)
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(faults, pa.string()), pa.array(paths, pa.string())], [key, "fault", "path"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, fault string, path string")
