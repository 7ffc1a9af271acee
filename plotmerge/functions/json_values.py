"""Typed reads from VARIANT values that never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotmerge.functions.binding import let
from plotmerge.functions.text import float_comma, float_plain, parse_int_eu


def parse_strict(text: Column) -> Column:
    """VARIANT of a whole JSON text, NULL if malformed.

    The parser stops after the first value, so the text is parsed as the only
    element of an array: anything after the value then makes it malformed.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(items(wrapped), lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def opened(value: Column, *paths: tuple[str, ...]) -> Column:
    """What is at each path of keys, as a struct of structs; NULL for anything but an object.

    One pass over the object, however many paths. A path that is not there is a NULL; by a
    path expression of its own it would be an exception inside Spark, which is slower than the read.
    """
    tree: dict = {}
    for path in paths:
        level = tree
        for key in path:
            level = level.setdefault(key, {})

    def kind_of(level: dict) -> str:
        names = (f"`{k.replace('`', '``')}`:{kind_of(v)}" for k, v in level.items())
        return f"struct<{','.join(names)}>" if level else "variant"

    return F.try_variant_get(value, "$", kind_of(tree))


def child(value: Column, *keys: str) -> Column:
    out = opened(value, keys)
    for key in keys:
        out = out.getField(key)
    return out


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def members(value: Column) -> Column:
    """Keys and values of an object, NULL for anything else.

    Opens one level only; ``kind`` of an object would describe it to the bottom.
    """
    return F.try_variant_get(value, "$", "map<string,variant>")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def object_only(value: Column) -> Column:
    return let(value, lambda v: F.when(is_object(v), v))


def items(value: Column) -> Column:
    """Array elements, or NULL if the value is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"

# The ``_of`` forms are for values that are columns already: they name the value more than
# once, and Spark compiles them, which it does not do with a ``let``.


def string_of(v: Column) -> Column:
    return F.when(kind(v) == "STRING", _text(v))


def text_of(v: Column) -> Column:
    return F.when(kind(v).rlike(f"{_NUMBER}|^STRING$"), _text(v))


def int_of(v: Column) -> Column:
    number = F.try_variant_get(v, "$", "bigint")
    # Digits alone are never below 0.
    return F.when(kind(v) == "STRING", parse_int_eu(_text(v))).when(
        kind(v).rlike(_NUMBER) & (number >= 0), number
    )


def float_of(v: Column, comma: bool = False) -> Column:
    of_text = float_comma if comma else float_plain
    return F.when(kind(v) == "STRING", of_text(_text(v))).when(
        kind(v).rlike(_NUMBER), F.try_variant_get(v, "$", "double")
    )


def as_string(value: Column) -> Column:
    """The text of a string value; other kinds are NULL."""
    return let(value, string_of)


def as_text(value: Column) -> Column:
    """Strings and numbers as text; booleans, objects, arrays and null are NULL."""
    return let(value, text_of)


def as_int(value: Column) -> Column:
    """Non-negative integer: numbers are truncated, strings keep their digits."""
    return let(value, int_of)


def as_float(value: Column, comma: bool = False) -> Column:
    """Double; strings may use a decimal comma if ``comma``; booleans are NULL."""
    return let(value, lambda v: float_of(v, comma))


def first_or_self(value: Column) -> Column:
    """First element of an array, any other value as it is."""
    return let(
        value,
        lambda v: let(items(v), lambda a: F.when(a.isNull(), v).otherwise(F.get(a, F.lit(0)))),
    )
