"""Turn resolution, role normalisation and conversation-level filters.

PRJ1-12, PRJ23, FLT1-3, FLT5-7.  Every operator is a projection over the turn
array with higher-order functions (``transform``/``filter``/``forall``), so a
conversation never leaves the JVM and no shuffle is introduced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import at

class SourceError(ValueError):
    """A source cannot be used (missing message column, no requested fields...)."""


# Roles mapped by the SFT builders (standard role -> source names)
# and the aliases added to the inverted map only when absent.
DEFAULT_ROLE_MAP = {
    "system": ["system"],
    "user": ["user", "human"],
    "assistant": ["gpt", "assistant", "model"],
}
DEFAULT_ALIASES = [("user", "user"), ("human", "user"), ("assistant", "assistant"),
                   ("gpt", "assistant"), ("system", "system")]

MESSAGE_COLUMN_CANDIDATES = ("messages", "conversations", "conversation")


def invert_role_map(role_map: Mapping[str, Sequence[str]] | None) -> dict[str, str]:
    """``{standard: [aliases]}`` -> ``{alias.lower(): standard}`` plus absent defaults."""
    inverted = {alias.lower(): std for std, aliases in (role_map or {}).items() for alias in aliases}
    for alias, std in DEFAULT_ALIASES:
        inverted.setdefault(alias, std)
    return inverted


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])


def turn_struct_type(df: DataFrame, col: str) -> T.StructType:
    dt = df.schema[col].dataType
    if not isinstance(dt, T.ArrayType) or not isinstance(dt.elementType, T.StructType):
        raise SourceError(f"column {col!r} is not an array of turn structs: {dt.simpleString()}")
    return dt.elementType


def content_as_text(c: Column, dtype: T.DataType) -> Column:
    """Content to one string: strings as-is, lists joined by newline with empty items dropped."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.ArrayType):
        items = F.filter(c.cast(T.ArrayType(T.StringType())), lambda x: x.isNotNull() & (F.length(x) > 0))
        return F.when(c.isNotNull(), F.array_join(items, "\n"))
    return c.cast("string")


def resolve_turn(t: Column, st: T.StructType, mode: str = "strict",
                 property_map: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """(role, content) of one turn following the key-presence rule.

    ``strict``: the ``role`` field is used whenever the struct *has* it (even if
    null), else ``from``; likewise ``content`` else ``value``.  ``lenient``
    falls back per row (``coalesce``).  ``property_map`` (PRJ24, e.g.
    ``{"role": "from", "content": "value"}``) names the fields explicitly.
    """
    names = st.fieldNames()
    dtypes = {f.name: f.dataType for f in st.fields}
    if property_map:
        role_f, content_f = property_map.get("role", "role"), property_map.get("content", "content")
        missing = [f for f in (role_f, content_f) if f not in names]
        if missing:
            raise SourceError(f"mapped message properties {missing} not in turn struct {names}")
        return t[role_f].cast("string"), content_as_text(t[content_f], dtypes[content_f])

    def pick(primary: str, fallback: str, as_text: bool) -> Column:
        conv = (lambda n: content_as_text(t[n], dtypes[n])) if as_text else (lambda n: t[n].cast("string"))
        if mode == "lenient" and primary in names and fallback in names:
            return F.coalesce(conv(primary), conv(fallback))
        if primary in names:
            return conv(primary)
        if fallback in names:
            return conv(fallback)
        return F.lit(None).cast("string")

    return pick("role", "from", False), pick("content", "value", True)


def normalize_conversation(df: DataFrame, field_messages: str = "conversations",
                           role_map: Mapping[str, Sequence[str]] | None = None,
                           mode: str = "strict", property_map: Mapping[str, str] | None = None) -> Column:
    """PRJ1-3 + FLT1: resolved, lower-cased, mapped turns; invalid turns dropped."""
    if field_messages not in df.columns:
        raise SourceError(f"message column {field_messages!r} not found; available: {df.columns}")
    st = turn_struct_type(df, field_messages)
    m = literal_map(invert_role_map(role_map if role_map is not None else DEFAULT_ROLE_MAP))

    def one(t: Column) -> Column:
        role, content = resolve_turn(t, st, mode, property_map)
        return F.struct(m[F.lower(role)].alias("role"), content.alias("content"))

    mapped = F.transform(F.col(field_messages), one)
    return F.filter(mapped, lambda t: t["role"].isNotNull() & t["content"].isNotNull())


def normalize_flat(flat: DataFrame, role_col: str = "role", content_col: str = "text",
                   role_map: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """PRJ2-3 + FLT1 on a flat turn table, before nesting.

    Same per-turn rule as ``normalize_conversation`` but applied row by row, so
    invalid turns are dropped before the ``groupBy`` that nests them and the
    shuffle carries only kept turns.
    """
    m = literal_map(invert_role_map(role_map if role_map is not None else DEFAULT_ROLE_MAP))
    mapped = m[F.lower(F.col(role_col).cast("string"))]
    return (flat.withColumn(role_col, mapped)
            .where(F.col(role_col).isNotNull() & F.col(content_col).isNotNull()))


def load_conversation(df: DataFrame, field_messages: str = "conversations",
                      role_map: Mapping[str, Sequence[str]] | None = None,
                      fields: Sequence[str] | None = None, mode: str = "strict",
                      out: str = "conversations", property_map: Mapping[str, str] | None = None) -> DataFrame:
    """PRJ1-5 + FLT1-2 + FLT7: one source in the normalised conversation layout.

    ``fields`` are the final columns (``conversations`` is always included);
    requested columns that do not exist are dropped, as the reference does.
    """
    conv = normalize_conversation(df, field_messages, role_map, mode, property_map)
    wanted = list(fields) if fields else [out]
    if out not in wanted:
        wanted.append(out)
    extra = [f for f in wanted if f != out and f in df.columns]
    result = df.select(*extra, conv.alias(out)).where(F.size(out) > 0)
    return validate_and_select(result, wanted)


def validate_and_select(df: DataFrame, requested: Sequence[str]) -> DataFrame:
    """PRJ5: keep requested columns that exist; reject the source if none do."""
    final = [c for c in requested if c in df.columns]
    if not final:
        raise SourceError(f"none of the requested fields {list(requested)} exist in {df.columns}")
    return df.select(*final)


def rebuild_clean_schema(df: DataFrame, col: str = "conversations", keep: Sequence[str] = ()) -> DataFrame:
    """PRJ6 + FLT3: keep only ``role``/``content`` of each turn, drop empty examples.

    Turns whose struct lacks either key are dropped (schema-level presence).
    ``keep`` carries extra columns (e.g. an id) through the rebuild.
    """
    st = turn_struct_type(df, col)
    if "role" not in st.fieldNames() or "content" not in st.fieldNames():
        clean = F.array().cast(T.ArrayType(T.StructType([T.StructField("role", T.StringType()),
                                                         T.StructField("content", T.StringType())])))
    else:
        clean = F.transform(F.col(col), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return df.select(*keep, clean.alias(col)).where(F.size(col) > 0)


# --------------------------------------------------------------------------- layout converters

# ShareGPT -> OpenAI role names for the message converters.
SHAREGPT_TO_OPENAI = {"system": "system", "human": "user", "gpt": "assistant"}


def sharegpt_to_messages(col: Column) -> Column:
    """PRJ7: ``{from,value}`` -> ``{role,content}``; unmapped roles pass through."""
    m = literal_map(SHAREGPT_TO_OPENAI)
    return F.transform(col, lambda t: F.struct(F.coalesce(m[t["from"]], t["from"]).alias("role"),
                                               t["value"].alias("content")))


def sharegpt_to_messages_no_system(col: Column) -> Column:
    """PRJ8: keep only human/gpt turns (system and others dropped), renamed."""
    kept = F.filter(col, lambda t: t["from"].isin("human", "gpt"))
    return F.transform(kept, lambda t: F.struct(
        F.when(t["from"] == "human", "user").otherwise("assistant").alias("role"),
        t["value"].alias("content")))


def sharegpt_two_roles(col: Column) -> Column:
    """PRJ9: human -> user, every other role -> assistant."""
    return F.transform(col, lambda t: F.struct(
        F.when(t["from"].eqNullSafe("human"), "user").otherwise("assistant").alias("role"),
        t["value"].alias("content")))


def sharegpt_verbatim(col: Column) -> Column:
    """PRJ10: ``{role=from, content=value}`` without mapping."""
    return F.transform(col, lambda t: F.struct(t["from"].alias("role"), t["value"].alias("content")))


def sample_text(df: DataFrame, text_col: str = "text", conv_col: str = "conversations",
                on_missing: str = "error") -> Column:
    """PRJ11: non-empty ``text`` wins, else ``role: content`` lines with truthiness fallback.

    Role falls back ``role -> from -> 'unknown'`` and content
    ``content -> value -> ''`` whenever the earlier value is null *or empty*.
    Rows with neither input raise (``on_missing='error'``) or give null.
    """
    text = F.col(text_col) if text_col in df.columns else F.lit(None).cast("string")
    conv_text = F.lit(None).cast("string")
    if conv_col in df.columns:
        st = turn_struct_type(df, conv_col)

        def truthy(t: Column, names: Sequence[str], default: str) -> Column:
            cands = [F.nullif(t[n].cast("string"), F.lit("")) for n in names if n in st.fieldNames()]
            return F.coalesce(*cands, F.lit(default))

        lines = F.transform(F.col(conv_col), lambda t: F.concat(
            truthy(t, ("role", "from"), "unknown"), F.lit(": "), truthy(t, ("content", "value"), "")))
        conv_text = F.when(F.col(conv_col).isNotNull(), F.array_join(lines, "\n"))
    missing = F.lit(None).cast("string")
    if on_missing == "error":
        missing = F.raise_error(F.lit("Sample missing 'text' or 'conversations' fields required for formatting"))
    return (F.when(F.length(text) > 0, text)
            .when(conv_text.isNotNull(), conv_text)
            .otherwise(missing))


def plain_concat(df: DataFrame, conv_col: str = "conversations") -> Column:
    """PRJ12 fallback: ``"{role}: {content}\\n"`` per message with key fallback.

    Key presence decides (``role`` else ``from`` else ``unknown``); a present
    null formats as ``None`` like a Python f-string.
    """
    st = turn_struct_type(df, conv_col)
    names = st.fieldNames()

    def keyed(t: Column, primary: str, fallback: str, default: str) -> Column:
        if primary in names:
            return F.coalesce(t[primary].cast("string"), F.lit("None"))
        if fallback in names:
            return F.coalesce(t[fallback].cast("string"), F.lit("None"))
        return F.lit(default)

    lines = F.transform(F.col(conv_col), lambda t: F.concat(
        keyed(t, "role", "from", "unknown"), F.lit(": "), keyed(t, "content", "value", ""), F.lit("\n")))
    return F.array_join(lines, "")


def with_train_flags(col: Column, roles_to_train: Sequence[str] = ("assistant",)) -> Column:
    """PRJ23: add ``train`` per turn (role in ``roles_to_train``; prompts masked)."""
    roles = F.array(*[F.lit(r) for r in roles_to_train])
    return F.transform(col, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"),
                                               F.coalesce(F.array_contains(roles, t["role"]), F.lit(False)).alias("train")))


def is_alternating(col: Column, offset: Column | int = 0, roles_only: bool = False) -> Column:
    """FLT6: ``(role == 'user') == (index % 2 == offset)`` for every turn.

    ``roles_only`` additionally requires every role to be user or assistant
    (the strict ``[INST]`` template).
    """
    off = F.lit(offset) if isinstance(offset, int) else offset

    def ok(t: Column, i: Column) -> Column:
        cond = F.coalesce(t["role"] == "user", F.lit(False)) == ((i % 2) == off)
        if roles_only:
            cond = cond & F.coalesce(t["role"].isin("user", "assistant"), F.lit(False))
        return cond

    return F.forall(F.transform(col, ok), lambda b: b)


def system_offset(col: Column) -> Column:
    """1 when the first turn is a system turn, else 0 (PRJ20 / FLT6 offset)."""
    return F.when(at(col, 1)["role"].eqNullSafe("system"), 1).otherwise(0)


def infer_message_column(df: DataFrame, candidates: Sequence[str] = MESSAGE_COLUMN_CANDIDATES) -> list[str]:
    """FLT5: candidate message columns present in the schema as arrays, in priority order."""
    return [c for c in candidates if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]
