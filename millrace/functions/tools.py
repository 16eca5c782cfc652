"""Tool calls: arguments held against a schema, and results read out of loosely written text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

#: The types of a schema's properties, by what the parsed value is.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}


def kind_of(value: Column) -> Column:
    """The first word of a parsed value's type; null without a value."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def checked_arguments(arguments, schema: dict) -> Column:
    """struct<arguments, has_error, problems>: arguments as they are, or {} with has_error where they aren't a JSON object.

    problems names what the schema finds wrong: `missing NAME`, `type NAME`, `choice NAME`, in the order of its properties, or
    `no JSON` and `no object`.  Values that the schema doesn't name are no problem; an object that repeats a name is no JSON here.
    schema: {"properties": {name: {"type": ..., "enum": [...]}}, "required": [names]}."""
    for name, rule in schema["properties"].items():
        if rule["type"] not in TYPES:
            raise ValueError(f"{name} has the unknown type {rule['type']}")
    value = F.try_parse_json(text(arguments))

    def problems(v):
        found = []
        for name, rule in schema["properties"].items():
            one = F.try_variant_get(v, "$['" + name + "']", "variant")
            kind = kind_of(one)
            if name in schema.get("required", ()):
                found.append(F.when(one.isNull(), f"missing {name}"))
            found.append(F.when(one.isNotNull() & ~kind.isin(*TYPES[rule["type"]]), f"type {name}"))
            if rule.get("enum"):
                found.append(F.when((kind == "STRING") & ~F.try_variant_get(v, "$['" + name + "']", "string").isin(*rule["enum"]), f"choice {name}"))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    wrong = F.when(value.isNull(), F.array(F.lit("no JSON"))).when(kind_of(value) != "OBJECT", F.array(F.lit("no object")))
    bad = value.isNull() | (kind_of(value) != "OBJECT")
    return F.struct(F.when(bad, "{}").otherwise(text(arguments)).alias("arguments"), bad.alias("has_error"), F.coalesce(wrong, problems(value)).alias("problems"))


def loose_results(parts: Column) -> Column:
    """struct<text, queries, query_count, total_results, status> of a search tool's text parts, in which quotes may be single.

    Of each part the first query (empty without one), the first list of results, up to its first closing bracket, and how many titles there
    are.  Nothing in it is parsed, so that the status is always a success; without parts it is unknown."""
    quoted = F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.translate(p, "'", '"'))
    queries = F.transform(quoted, lambda p: F.regexp_extract(p, r'query"\s*:\s*"([^"]+)"', 1))
    titles = F.aggregate(quoted, F.lit(0), lambda n, p: n + F.regexp_count(p, F.lit(r'"title"\s*:')))
    results = F.array_join(F.transform(quoted, lambda p: F.regexp_extract(p, r'(?s)"results"\s*:\s*(\[.*?\])', 1)), "")
    return F.struct(results.alias("text"), queries.alias("queries"), F.size(queries).alias("query_count"), titles.alias("total_results"), F.when(parts.isNull(), "unknown").otherwise("success").alias("status"))
