"""JSON log bodies: a strict object test, lookups by field name, and leaf values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# One token of a JSON text: a string (with its colon if it is a key), a number or a boolean.
TOKEN = r'(?:"(?:[^"\\]|\\.)*+"(?:\s*:)?|-?\d[0-9.eE+-]*|true|false)'


def json_object(line: Column) -> Column:
    """Fields of a line that is exactly one JSON object, else NULL.

    Reading the line as the only element of an array refuses anything after the object.
    """
    listed = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<map<string,string>>", STRICT)
    return F.when(line.startswith("{") & line.endswith("}") & (F.size(listed) == 1), listed[0])


def lower_keys(fields: Column) -> Column:
    """The same fields under lower-case names. Of names that differ only in case the last one counts."""
    names = F.transform(F.map_keys(fields), F.lower)
    once = F.array_distinct(names)
    last = F.transform(once, lambda name: F.element_at(F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == name), -1)["value"])
    return F.when(F.size(once) == F.size(names), F.map_from_arrays(names, F.map_values(fields))).otherwise(
        F.map_from_arrays(once, last)
    )


def ci_get(lowered: Column, key: str) -> Column:
    """Field of a ``lower_keys`` map by a name in any case."""
    return lowered[key.lower()]


def leaf_texts(line: Column) -> Column:
    """Decoded scalar values at any depth of a JSON text; keys and nulls are left out."""
    tokens = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))
    values = F.filter(tokens, lambda token: ~token.endswith(":"))

    def decode(token: Column) -> Column:
        bare = F.when(token.startswith('"'), F.substr(token, F.lit(2), F.length(token) - 2)).otherwise(token)
        escaped = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>", STRICT)[0]
        return F.when(token.contains("\\"), escaped).otherwise(bare)

    return F.transform(values, decode)
