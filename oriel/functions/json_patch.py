"""JSON_TRANSFORM: a patch of SET, REMOVE, APPEND and the like, as one expression over a VARIANT.

A document is parsed once.  Each operation walks its path: an object becomes a map whose one entry changes, an array a
transformed array, and what lies beside the path is passed on as it is.  Operations apply in order, each to what the ones before left.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP, ARRAY = "map<string,variant>", "array<variant>"


def steps_of(path: str) -> list[str | int]:
    """Keys and places of a path like ``$.a."b c"[0]``."""
    found = re.fullmatch(r'\$((?:\.(?:\w+|"[^"]*")|\[\d+\])*)', path)
    if not found:
        raise ValueError(f"JSON path {path}")
    return [int(i) if i else (quoted if quoted or not word else word) for word, quoted, i in re.findall(r'\.(?:(\w+)|"([^"]*)")|\[(\d+)\]', found[1])]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is written, and computed, once; the expressions of a path would else grow with the power of its depth."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def variant(value: Any) -> Column:
    """A value as a variant: a column as it is, anything else a literal; None is a JSON null."""
    if value is None:
        return F.parse_json(F.lit("null"))
    c = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(c.cast("variant"), F.parse_json(F.lit("null")))


def json(text: Column) -> Column:
    """FORMAT JSON: text that is JSON itself."""
    return F.parse_json(text)


@dataclass(frozen=True)
class Op:
    """One operation.

    ``set`` replaces or creates, making objects on the way; ``insert`` only creates, ``replace`` only replaces; ``remove``, ``rename``
    (value is the new key), ``append`` and ``prepend`` to an array change nothing where the path leads nowhere.  ``keep`` drops all keys of
    the object at the path but those of the list ``value``.  A place beyond an array's end is nowhere, one just beyond it can be set.
    """

    op: str
    path: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in ("set", "insert", "replace", "remove", "rename", "append", "prepend", "keep"):
            raise ValueError(f"no JSON operation {self.op}")
        if self.op in ("remove", "rename") and not steps_of(self.path):
            raise ValueError(f"{self.op} needs a path below the document")

    def apply(self, doc: Column) -> Column:
        return self._walk(doc, steps_of(self.path))

    def _walk(self, at: Column, steps: list[str | int]) -> Column:
        if not steps:
            return let(at, self._here)
        kind = MAP if isinstance(steps[0], str) else ARRAY
        return let(at, lambda v: let(v.try_cast(kind), lambda inner: self._step(v, inner, steps)))

    def _step(self, at: Column, held: Column, steps: list[str | int]) -> Column:
        """The value ``at`` with what its entry at the first step becomes; ``held`` is what it holds, as a map or an array."""
        entry, last = steps[0], len(steps) == 1
        # these create what is missing, on the way objects only: a place in an array that is not there is nowhere
        make = self.op in ("set", "insert") and all(isinstance(s, str) for s in steps[1:])
        if isinstance(entry, str):
            m = held
            has = F.coalesce(F.map_contains_key(m, F.lit(entry)), F.lit(False))
            rest = F.map_filter(m, lambda k, _: k != entry)
            if last and self.op == "remove":
                out = F.when(has, rest).otherwise(m)
            elif last and self.op == "rename":
                out = F.when(has, F.map_concat(F.map_filter(rest, lambda k, _: k != self.value), F.create_map(F.lit(self.value), m[entry]))).otherwise(m)
            else:
                inner = F.create_map(F.lit(entry), self._walk(m[entry], steps[1:]))
                change = F.map_concat(rest, inner)
                if make:
                    only_new = self.op == "insert" and last
                    out = F.when(has, m).otherwise(change) if only_new else change
                else:
                    out = F.when(has, change).otherwise(m)
            # a missing parent is an empty object for those that create
            missing = F.to_variant_object(F.create_map(F.lit(entry), self._walk(F.lit(None).cast("variant"), steps[1:]))) if make else at
            return F.when(m.isNotNull(), F.to_variant_object(out)).when(at.isNull(), missing).otherwise(at)
        a = held
        there = F.size(a) > entry
        if last and self.op == "remove":
            out = F.filter(a, lambda _, i: i != entry)
        elif last and self.op == "insert":
            head, tail = F.slice(a, 1, entry) if entry else F.slice(a, 1, 0), F.slice(a, entry + 1, F.size(a))
            return F.when(a.isNotNull() & (F.size(a) >= entry), F.to_variant_object(F.concat(head, F.array(variant(self.value)), tail))).otherwise(at)
        else:
            out = F.transform(a, lambda x, i: F.when(i == entry, self._walk(x, steps[1:])).otherwise(x))
            if last and self.op == "set":
                return F.when(a.isNotNull() & there, F.to_variant_object(out)).when(F.size(a) == entry, F.to_variant_object(F.array_append(a, variant(self.value)))).otherwise(at)
        return F.when(a.isNotNull() & there, F.to_variant_object(out)).otherwise(at)

    def _here(self, at: Column) -> Column:
        if self.op in ("set", "insert"):
            return variant(self.value)
        if self.op == "replace":
            return F.when(at.isNotNull(), variant(self.value))
        if self.op == "keep":
            m = at.try_cast(MAP)
            return F.when(m.isNotNull(), F.to_variant_object(F.map_filter(m, lambda k, _: k.isin(*self.value)))).otherwise(at)
        a, one = at.try_cast(ARRAY), F.array(variant(self.value))
        return F.when(a.isNotNull(), F.to_variant_object(F.concat(a, one) if self.op == "append" else F.concat(one, a))).otherwise(at)


def json_transform(text: Column, *ops: Op) -> Column:
    """The document as text after all operations, its keys in order; null stays null, and text that is not JSON raises."""
    doc = F.parse_json(text)
    for op in ops:
        doc = op.apply(doc)
    return F.when(text.isNotNull(), F.to_json(doc))
