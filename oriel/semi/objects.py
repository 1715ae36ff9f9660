"""Object types: a tree of types whose instances are structs that carry the name of their type.

All types of a tree share one struct, so a column holds instances of any of them and joins, shuffles and files
treat it as one type.  IS OF TYPE compares the tag, TREAT is null for other types, and a call of a member function is one CASE over
the tag with the bodies that the types have, inlined: no row goes through Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "__type"
#: A member function: of the instance's attributes and the arguments.
Body = Callable[..., Column]


class Self:
    """SELF within a body: its attributes, and calls of its member functions, which are dispatched again."""

    def __init__(self, tree: TypeTree, value: Column, kind: str):
        self.tree, self.value, self.kind = tree, value, kind

    def __getattr__(self, name: str) -> Column:
        if name.lower() not in self.tree.attributes(self.kind):
            raise AttributeError(f"{self.kind} has no attribute {name}")
        return self.value[name.lower()]

    def call(self, method: str, *args: Any) -> Column:
        return self.tree.call(self.value, method, *args, below=self.kind)

    def above(self, method: str, *args: Any) -> Column:
        """(SELF AS parent).method: the body that the type's parent has."""
        parent = self.tree.types[self.kind].parent
        if parent is None:
            raise LookupError(f"{self.kind} has no type above it")
        return self.tree.body(parent, method)(Self(self.tree, self.value, parent), *args)


@dataclass
class ObjectType:
    name: str
    attributes: dict[str, str]
    parent: str | None = None
    #: Without instances of its own.
    abstract: bool = False
    methods: dict[str, Body] = field(default_factory=dict)
    #: The member function that instances are ordered and compared by.
    map_method: str | None = None


@dataclass
class TypeTree:
    types: dict[str, ObjectType] = field(default_factory=dict)

    def add(self, name: str, attributes: dict[str, str], under: str | None = None, abstract: bool = False, map_method: str | None = None, **methods: Body) -> ObjectType:
        """A type with attributes (name: Spark type), those of the type above it being its own as well."""
        low = name.lower()
        parent = under.lower() if under else None
        if low in self.types:
            raise ValueError(f"type {name} is there already")
        if parent is not None and parent not in self.types:
            raise LookupError(f"no type {under}")
        if parent is None and self.types:
            raise ValueError("a tree has one root; a type without another above it begins a tree of its own")
        own = {a.lower(): k for a, k in attributes.items()}
        inherited = self.attributes(parent) if parent else {}
        other = {a for t in self.types.values() for a, k in t.attributes.items() if a in own and k != own[a]}  # one struct holds them all
        if clash := own.keys() & inherited.keys() | other:
            raise ValueError(f"attributes {', '.join(sorted(clash))} of {name} are there already")
        self.types[low] = ObjectType(low, own, parent, abstract, {m.lower(): b for m, b in methods.items()}, map_method)
        return self.types[low]

    def line(self, name: str) -> list[ObjectType]:
        """A type and those above it, the root last."""
        if name.lower() not in self.types:
            raise LookupError(f"no type {name}")
        t = self.types[name.lower()]
        return [t, *(self.line(t.parent) if t.parent else [])]

    def below(self, name: str) -> list[str]:
        """A type and all those under it."""
        wanted = self.line(name)[0].name
        return [n for n in self.types if any(t.name == wanted for t in self.line(n))]

    def attributes(self, name: str) -> dict[str, str]:
        return {a: k for t in reversed(self.line(name)) for a, k in t.attributes.items()}

    @property
    def schema(self) -> T.StructType:
        """The struct of every instance: the tag, then all attributes of all types."""
        out = T.StructType().add(TAG, "string")
        for t in self.types.values():
            for a, k in t.attributes.items():
                if a not in out.fieldNames():
                    out = out.add(a, T._parse_datatype_string(k) if isinstance(k, str) else k)
        return out

    def make(self, type: str, **values: Any) -> Column:
        """The type's constructor; attributes that are not given are null.  ``None`` as every value still is an instance, a null is none."""
        t = self.line(type)[0]
        if t.abstract:
            raise ValueError(f"type {type} is NOT INSTANTIABLE")
        known = self.attributes(type)
        if unknown := {v.lower() for v in values} - set(known):
            raise LookupError(f"{type} has no attribute {', '.join(sorted(unknown))}")
        given = {k.lower(): v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
        return F.struct(*[(F.lit(t.name) if f.name == TAG else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in self.schema])

    def is_of(self, value: Column, *names: str, only: bool = False) -> Column:
        """IS OF TYPE ([ONLY] ...); of a null it is unknown."""
        tags = sorted({x for n in names for x in ([self.line(n)[0].name] if only else self.below(n))})
        return value[TAG].isin(*tags)

    def treat(self, value: Column, name: str) -> Column:
        """TREAT(value AS type): the instance where it is one, else null."""
        return F.when(self.is_of(value, name), value)

    def attribute(self, value: Column, name: str, attribute: str) -> Column:
        """TREAT(value AS type).attribute."""
        if attribute.lower() not in self.attributes(name):
            raise LookupError(f"{name} has no attribute {attribute}")
        return F.when(self.is_of(value, name), value[attribute.lower()])

    def body(self, name: str, method: str) -> Body:
        """The body a type has for a method: its own or the nearest above."""
        for t in self.line(name):
            if method.lower() in t.methods:
                return t.methods[method.lower()]
        raise LookupError(f"{name} has no member function {method}")

    def call(self, value: Column, method: str, *args: Any, below: str | None = None) -> Column:
        """value.method(...): the body of each instance's own type, as one CASE; null for a null instance.

        Types that share a body share a branch.  ``below`` narrows what the value can be, as TREAT would.
        """
        names = self.below(below or next(iter(self.types)))
        branches: dict[int, tuple[Body, list[str]]] = {}
        for n in (n for n in names if not self.types[n].abstract):
            b = self.body(n, method)
            branches.setdefault(id(b), (b, []))[1].append(n)
        out: Column | None = None
        for b, own in branches.values():
            owner = next(t.name for t in self.line(own[0]) if t.methods.get(method.lower()) is b)
            made = b(Self(self, value, owner), *args)
            hit = value[TAG].isin(*own)
            out = F.when(hit, made) if out is None else out.when(hit, made)
        if out is None:
            raise LookupError(f"no type has both instances and {method}")
        return out

    def key(self, value: Column) -> Column:
        """What ORDER BY and comparisons of instances go by: the root's map function."""
        root = next(iter(self.types.values()))
        if root.map_method is None:
            raise LookupError(f"type {root.name} has no map function")
        return self.call(value, root.map_method)
