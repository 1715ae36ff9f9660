"""Registered queries over the test tables, each with its DuckDB equivalent."""

from __future__ import annotations

from .base import Registry


def registries() -> list[Registry]:
    from . import changes, markup, more, nested, procedural, ranked, relational, scalars

    return [relational.R, scalars.R, procedural.R, more.R, ranked.R, changes.R, markup.R, nested.R]
