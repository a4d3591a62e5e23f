"""Validation of JSON against a subset of JSON Schema, compiled into one column expression over variants.

Known: type, required, properties, additionalProperties (false), items, minimum, maximum, minLength, maxLength, enum,
pattern, minItems, maxItems. Anything else in a schema is an error where it is compiled, not a rule that never fails.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN = {"type", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength", "enum", "pattern", "minItems", "maxItems"}
#: Words in a schema that say nothing about a value.
NOTES = {"$schema", "$id", "title", "description", "default", "examples"}
TYPES = ("object", "array", "string", "boolean", "null", "integer", "number")
_NONE = "array<string>"


def kind_of(value: Column) -> Column:
    """The JSON type of a variant: one of TYPES; a whole number written without a fraction is an integer; null where there is no value."""

    def of(shape: Column) -> Column:
        return (
            F.when(shape.isNull(), None).when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean")
            .when(shape == "VOID", "null").when((shape == "BIGINT") | shape.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").otherwise("number")
        )

    return _let(F.schema_of_variant(value), of)


def _text(value: Column) -> Column:
    return F.to_json(value)


def _errors(rules: list[tuple[Column, Column]]) -> Column:
    """The messages of the rules that are broken, in order."""
    if not rules:
        return F.array().cast(_NONE)
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), message) for broken, message in rules]))


def _checked(schema: dict) -> dict:
    unknown = set(schema) - KNOWN - NOTES
    if unknown or schema.get("additionalProperties", True) not in (True, False):
        raise ValueError(f"not in the subset of JSON Schema: {sorted(unknown) or 'additionalProperties'}")
    return schema


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def errors_of(value: Column, schema: dict, path: Column) -> Column:
    """array<string>: what is wrong with a variant, its own errors before those of its parts; empty if nothing is."""
    _checked(schema)
    say = lambda *parts: F.concat(path, F.lit(": "), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def of(value: Column, kind: Column) -> Column:
        types = [schema["type"]] if isinstance(schema.get("type"), str) else list(schema.get("type", []))
        if bad := set(types) - set(TYPES):
            raise ValueError(f"no type of JSON Schema: {sorted(bad)}")
        fits = F.lit(False)
        for t in types:
            fits = fits | (kind.isin("integer", "number") if t == "number" else kind == t)
        own: list[tuple[Column, Column]] = []
        if "enum" in schema:
            allowed = F.lit(False)
            for option in schema["enum"]:
                allowed = allowed | _equals(value, kind, option)
            own.append((~allowed, say(_text(value), " isn't allowed")))
        number = kind.isin("integer", "number")
        amount = F.when(number, F.try_variant_get(value, "$", "double"))
        if "minimum" in schema:
            own.append((amount < float(schema["minimum"]), say(_text(value), f" < {schema['minimum']}")))
        if "maximum" in schema:
            own.append((amount > float(schema["maximum"]), say(_text(value), f" > {schema['maximum']}")))
        text = F.when(kind == "string", F.try_variant_get(value, "$", "string"))
        if "maxLength" in schema:
            own.append((F.length(text) > schema["maxLength"], say(f"longer than {schema['maxLength']} characters")))
        if "minLength" in schema:
            own.append((F.length(text) < schema["minLength"], say(f"shorter than {schema['minLength']} characters")))
        if "pattern" in schema:
            own.append((~text.rlike(schema["pattern"]), say(f"doesn't match {schema['pattern']}")))
        parts = [_errors(own)]
        properties = schema.get("properties", {})
        if properties or "required" in schema or schema.get("additionalProperties") is False:

            def of_fields(fields: Column) -> Column:
                there = lambda name: F.coalesce(F.map_contains_key(fields, F.lit(name)), F.lit(False))
                found = [_errors([((kind == "object") & ~there(name), say(f"field {name!r} is missing")) for name in schema.get("required", [])])]
                for name, inner in properties.items():
                    part = errors_of(fields[name], inner, F.concat(path, F.lit(f".{name}")))
                    found.append(F.when(there(name), part).otherwise(F.array().cast(_NONE)))
                if schema.get("additionalProperties") is False:
                    strange = F.array_sort(F.array_except(F.coalesce(F.map_keys(fields), F.array().cast(_NONE)), F.array(*[F.lit(n) for n in properties]).cast(_NONE)))
                    found.append(F.transform(strange, lambda n: say("unknown field '", n, "'")))
                return F.concat(*found)

            parts.append(_let(F.when(kind == "object", F.try_variant_get(value, "$", "map<string,variant>")), of_fields))
        if {"items", "minItems", "maxItems"} & set(schema):

            def of_entries(entries: Column) -> Column:
                counts = []
                if "minItems" in schema:
                    counts.append((F.size(entries) < schema["minItems"], say(f"fewer than {schema['minItems']} entries")))
                if "maxItems" in schema:
                    counts.append((F.size(entries) > schema["maxItems"], say(f"more than {schema['maxItems']} entries")))
                found = [_errors([((kind == "array") & broken, message) for broken, message in counts])]
                if "items" in schema:
                    each = F.transform(entries, lambda e, i: errors_of(e, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
                    found.append(F.coalesce(F.flatten(each), F.array().cast(_NONE)))
                return F.concat(*found)

            parts.append(_let(F.when(kind == "array", F.try_variant_get(value, "$", "array<variant>")), of_entries))
        inner = F.concat(*parts)
        if not types:
            return inner
        return F.when(fits, inner).otherwise(F.array(say(f"expected {'/'.join(types)}, got ", kind)))

    return _let(value, lambda v: _let(F.coalesce(kind_of(v), F.lit("null")), lambda kind: of(v, kind)))


def _equals(value: Column, kind: Column, option) -> Column:
    if option is None:
        return kind == "null"
    if isinstance(option, bool):
        return (kind == "boolean") & F.coalesce(F.try_variant_get(value, "$", "boolean") == option, F.lit(False))
    if isinstance(option, (int, float)):
        return kind.isin("integer", "number") & F.coalesce(F.try_variant_get(value, "$", "double") == float(option), F.lit(False))
    if isinstance(option, str):
        return (kind == "string") & F.coalesce(F.try_variant_get(value, "$", "string") == option, F.lit(False))
    raise ValueError(f"not in the subset of JSON Schema: enum of {json.dumps(option)}")


def schema_errors(text: Column, schema: dict) -> Column:
    """array<string>: what is wrong with a JSON text; one error for what is no JSON at all, or null.

    Paths begin with $. A value's own errors come first, then missing fields, those of its fields in the schema's order,
    unknown fields by name, and those of its entries. A value of the wrong type has that error only.
    """
    wrong = lambda parsed: F.when(parsed.isNull(), F.array(F.lit("$: not JSON"))).otherwise(errors_of(parsed, schema, F.lit("$")))
    return _let(F.try_parse_json(text), wrong)
