"""Small fixed tables inside expressions: a literal each, however many entries, so that plans stay small."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def looked_up(table: Mapping[str, str], key: Column) -> Column:
    """The table's entry for a key; null for others."""
    return F.element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def looked_up_list(table: Mapping[str, list[str]], key: Column) -> Column:
    """The table's list for a key; null for others."""
    return F.element_at(F.from_json(F.lit(json.dumps(table)), "map<string,array<string>>"), key)


def among(word: Column, words: Iterable[str]) -> Column:
    """Whether a word is one of the words."""
    return F.array_contains(F.from_json(F.lit(json.dumps(list(words))), "array<string>"), word)


def rows(names: str, values: Iterable[tuple]) -> Column:
    """A table of strings as an array of structs; names are given in one string, null stays null."""
    fields = names.split()
    return F.from_json(F.lit(json.dumps([dict(zip(fields, v)) for v in values])), f"array<struct<{','.join(f'{n}:string' for n in fields)}>>")
