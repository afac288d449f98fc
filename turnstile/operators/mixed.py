"""Turns whose content is of several kinds in one column (PRJ3, PRJ12): text, lists, numbers, nulls, objects.

Raw conversation files mix strings and lists of parts, and a column has one type.  Such a column is kept as JSON text and
read as ``VariantType``: every value keeps its own kind, which ``schema_of_variant`` names for a row and
``schema_of_variant_agg`` for a table.  The operators below give a value the text the builders would have written, in
Columns only: no row goes through Python, no schema is inferred by a scan, and a new kind in a file breaks nothing.

A message is an object; ``role`` or else ``from``, ``content`` or else ``value`` is the key that is *present*, so a
present null wins over the other key.  Text that is no JSON counts as no value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .turns import DEFAULT_ROLE_MAP, invert_role_map, literal_map


def parsed(json_text: Column | str) -> Column:
    """Variant of a JSON text; null if it can't be parsed."""
    return F.try_parse_json(F.col(json_text) if isinstance(json_text, str) else json_text)


def kind_of(v: Column) -> Column:
    """``string``, ``list``, ``object``, ``number``, ``boolean``, ``null`` (a present null) or SQL null (no value)."""
    name = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(v), "null").when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean").when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "object")
            .otherwise("number"))


def _float_text(text: Column) -> Column:
    """A double's text as Python writes it: no exponent from 1e-4 to 1e16, else a short mantissa and two digits or more."""
    exponent = F.coalesce(F.nullif(F.regexp_extract(text, "E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(-?[0-9.]+)", 1), r"\.0$", "")
    shown = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    wide = F.concat(mantissa, F.lit("e+"), exponent.cast("string"))
    return (F.when(exponent.between(-4, 15), plain).when(F.abs(exponent) < 100, shown)
            .when(exponent >= 100, wide).otherwise(F.concat(mantissa, F.lit("e"), exponent.cast("string"))))


def scalar_text(v: Column) -> Column:
    """Python's ``str()`` of a JSON value; lists and objects as JSON text."""
    name, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    digits = F.regexp_extract(name, r"^DECIMAL\(([0-9]+),0\)", 1)
    # a decimal without places was written "2.0" unless it is a whole number beyond 64 bits
    return (F.when(F.is_variant_null(v), "None").when(name == "BOOLEAN", F.initcap(text)).when(name == "DOUBLE", _float_text(text))
            .when(digits.isin(*[str(d) for d in range(1, 19)]), F.concat(text, F.lit(".0")))
            .otherwise(text))


def truthy(v: Column) -> Column:
    """Python's ``bool()`` of a JSON value; no value is false."""
    name, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(
        F.when(v.isNull() | F.is_variant_null(v), False).when(name == "STRING", text != "")
        .when(name.startswith("ARRAY"), text != "[]").when(name.startswith("OBJECT"), text != "{}")
        .when(name == "BOOLEAN", text == "true").otherwise(number != 0), F.lit(False))


def content_text(v: Column) -> Column:
    """Content as the token build reads it: a list is its truthy items joined by newlines, falsy content is empty."""
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), truthy)
    joined = F.array_join(F.transform(items, scalar_text), "\n")
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), joined).when(truthy(v), scalar_text(v)).otherwise("")


def _field(message: Column, primary: str, fallback: str) -> Column:
    """The field whose key is present (a present null stays a variant null)."""
    return F.coalesce(*[F.try_variant_get(message, f"$.{k}", "variant") for k in (primary, fallback)])


def message_role(message: Column) -> Column:
    return _field(message, "role", "from")


def message_content(message: Column) -> Column:
    return _field(message, "content", "value")


def normalize_messages(messages: Column, role_map: Mapping[str, Sequence[str]] | None = None) -> Column:
    """PRJ1-3 for an array<variant> of messages: ``array<struct<role, content>>``.

    Roles follow the inverted map; a message that is no object, without a known role or without content is dropped (FLT1).
    """
    roles = literal_map(invert_role_map(DEFAULT_ROLE_MAP if role_map is None else role_map))

    def turn(m: Column) -> Column:
        role, content = message_role(m), message_content(m)
        known = roles[F.lower(F.when(kind_of(role) == "string", scalar_text(role)))]
        return F.struct(known.alias("role"), F.when(content.isNotNull() & ~F.is_variant_null(content), content_text(content)).alias("content"))

    return F.filter(F.transform(messages, turn), lambda t: t["role"].isNotNull() & t["content"].isNotNull())


def concat_messages(messages: Column) -> Column:
    """PRJ12 for an array<variant>: ``"{role}: {content}\\n"`` of every message, values as Python formats them."""
    def line(m: Column) -> Column:
        role, content = message_role(m), message_content(m)
        return F.concat(F.when(role.isNull(), "unknown").otherwise(scalar_text(role)), F.lit(": "),
                        F.when(content.isNull(), "").otherwise(scalar_text(content)), F.lit("\n"))

    return F.array_join(F.transform(messages, line), "")


def conversation_text(v: Column) -> Column:
    """PRJ12: a list of messages is concatenated, any other value is its own text; no value gives null."""
    return (F.when(kind_of(v) == "list", concat_messages(F.try_variant_get(v, "$", "array<variant>")))
            .when(v.isNotNull(), scalar_text(v)))


def content_kinds(df: DataFrame, content: Column, *by: str) -> DataFrame:
    """Rows of every kind of content, with the merged schema of the kind: what a strict schema would have to hold."""
    return (df.select(*by, content.alias("_v")).withColumn("kind", F.coalesce(kind_of(F.col("_v")), F.lit("none"))).groupBy(*by, "kind")
            .agg(F.count(F.lit(1)).alias("rows"), F.expr("schema_of_variant_agg(_v)").alias("merged_schema")))
