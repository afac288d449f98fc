"""Chat-template renderers (PRJ13-22) as higher-order-function Columns.

Each template is a per-turn piece ``(turn, index) -> string | null`` joined by
``array_join`` (nulls are skipped), so rendering runs inside whole-stage
codegen with no Python and no shuffle.  The literal strings below are the
templates' fixed text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip

# ChatML markers.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
# Llama-3 header markers and default special tokens.
HEADER_START = "<|start_header_id|>"
HEADER_END = "<|end_header_id|>"
EOT = "<|eot_id|>"
LLAMA3_BOS = "<|begin_of_text|>"
DEFAULT_BOS = "<s>"
DEFAULT_EOS = "</s>"


def _join(conv: Column, piece, sep: str = "") -> Column:
    return F.array_join(F.transform(conv, piece), sep)


def _content_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def chatml_strict(conv: Column) -> Column:
    """PRJ13: stripped role/content, empty turns skipped, pieces joined by newline + final newline.

    Null or empty conversations, or nothing left after skipping, render as ``''``.
    """
    def piece(t: Column) -> Column:
        role = ustrip(F.coalesce(t["role"], F.lit("")))
        content = ustrip(F.coalesce(t["content"], F.lit("")))
        return F.when((F.length(role) > 0) & (F.length(content) > 0),
                      F.concat(F.lit(IM_START), role, F.lit("\n"), content, F.lit(IM_END)))

    parts = F.filter(F.transform(conv, piece), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def chatml_piece(role: Column, content: Column) -> Column:
    """One PRJ14 turn: ``<|im_start|>role\\ncontent<|im_end|>\\n``.

    Every piece ends in a newline, so a rendered conversation is the plain
    concatenation of its pieces and additive metrics (characters, regex
    tokens) can be summed per turn without assembling the conversation.
    """
    return F.concat(F.lit(IM_START), _content_text(role), F.lit("\n"), _content_text(content),
                    F.lit(IM_END + "\n"))


def chatml(conv: Column, add_generation_prompt: bool = False) -> Column:
    """PRJ14: ``<|im_start|>role\\ncontent<|im_end|>\\n`` per turn, no stripping."""
    body = _join(conv, lambda t: chatml_piece(t["role"], t["content"]))
    return F.concat(body, F.lit(IM_START + "assistant\n")) if add_generation_prompt else body


def llama2(conv: Column, bos: str = DEFAULT_BOS, eos: str = DEFAULT_EOS, bos_on_system: bool = False) -> Column:
    """PRJ15: system block opens ``[INST]``; user turns after index 1 re-open it with BOS.

    ``bos_on_system`` is the variant whose system block also starts with BOS.
    """
    sys_open = (bos if bos_on_system else "") + "[INST] <<SYS>>\n"

    def piece(t: Column, i: Column) -> Column:
        c = _content_text(t["content"])
        return (F.when((t["role"] == "user") & (i > 1), F.concat(F.lit(bos + "[INST] "), c, F.lit(" [/INST]")))
                .when(t["role"] == "user", F.concat(c, F.lit(" [/INST]")))
                .when(t["role"] == "system", F.concat(F.lit(sys_open), c, F.lit("\n<</SYS>>\n\n")))
                .when(t["role"] == "assistant", F.concat(F.lit(" "), c, F.lit(" " + eos))))
    return _join(conv, piece)


def instruction_ja_piece(t: Column) -> Column:
    """One PRJ16 turn (null for roles the template ignores)."""
    c = _content_text(t["content"])
    return (F.when(t["role"] == "system", F.concat(c, F.lit("\n\n")))
            .when(t["role"] == "user", F.concat(F.lit("### 指示:\n"), c, F.lit("\n\n")))
            .when(t["role"] == "assistant", F.concat(F.lit("### 応答:\n"), c, F.lit("\n\n"))))


def instruction_ja_prompt(variant: str = "swallow") -> str:
    return "### 応答:" if variant == "swallow" else "### 応答:\n"


def instruction_ja(conv: Column, add_generation_prompt: bool = False, variant: str = "swallow") -> Column:
    """PRJ16: ``### 指示`` / ``### 応答`` template; the generation prompt differs per variant."""
    body = _join(conv, instruction_ja_piece)
    return F.concat(body, F.lit(instruction_ja_prompt(variant))) if add_generation_prompt else body


def role_upper_piece(t: Column) -> Column:
    """One PRJ17 turn."""
    return F.concat(F.upper(_content_text(t["role"])), F.lit(": "), _content_text(t["content"]), F.lit("\n"))


def role_upper(conv: Column, add_generation_prompt: bool = False) -> Column:
    """PRJ17: ``ROLE: content\\n`` with the role upper-cased."""
    body = _join(conv, role_upper_piece)
    return F.concat(body, F.lit("ASSISTANT: ")) if add_generation_prompt else body


def vicuna_piece(parity_misspelling: bool = False):
    """One PRJ18 turn (a piece builder; ``parity_misspelling`` gives 'ASISTANT')."""
    label = " ASISTANT:\n" if parity_misspelling else " ASSISTANT:\n"

    def piece(t: Column) -> Column:
        c = _content_text(t["content"])
        return (F.when(t["role"] == "system", F.concat(c, F.lit(" ")))
                .when(t["role"] == "user", F.concat(F.lit("USER:\n"), c, F.lit(" ")))
                .when(t["role"] == "assistant", F.concat(F.lit(label), c, F.lit(" "))))
    return piece


def vicuna(conv: Column, add_generation_prompt: bool = False, parity_misspelling: bool = False) -> Column:
    """PRJ18: ``USER:\\n… ASSISTANT:\\n…``; ``parity_misspelling`` reproduces the source's 'ASISTANT'."""
    body = _join(conv, vicuna_piece(parity_misspelling))
    return F.concat(body, F.lit("ASSISTANT: ")) if add_generation_prompt else body


def inst_strict(conv: Column, bos: str = DEFAULT_BOS, eos: str = DEFAULT_EOS) -> Column:
    """PRJ19 + FLT6: ``struct<text, error>``; roles must alternate user/assistant from index 0."""
    from .turns import is_alternating
    alternating = is_alternating(conv, 0)
    only_ua = F.forall(conv, lambda t: F.coalesce(t["role"].isin("user", "assistant"), F.lit(False)))
    body = _join(conv, lambda t: F.when(t["role"] == "user",
                                        F.concat(F.lit("[INST] "), _content_text(t["content"]), F.lit(" [/INST]")))
                 .otherwise(F.concat(_content_text(t["content"]), F.lit(eos))))
    error = (F.when(~alternating, F.lit("Conversation roles must alternate user/assistant/user/assistant/..."))
             .when(~only_ua, F.lit("Only user and assistant roles are supported!")))
    return F.struct(F.when(error.isNull(), F.concat(F.lit(bos), body)).alias("text"), error.alias("error"))


def inst_with_system(conv: Column, bos: str = DEFAULT_BOS, eos: str = DEFAULT_EOS) -> Column:
    """PRJ20: like PRJ19 but a leading system turn shifts the alternation by one."""
    from .turns import is_alternating, system_offset
    alternating = is_alternating(conv, system_offset(conv))

    def piece(t: Column) -> Column:
        c = _content_text(t["content"])
        return (F.when(t["role"] == "user", F.concat(F.lit(" [INST] "), c, F.lit(" [/INST] ")))
                .when(t["role"] == "assistant", F.concat(c, F.lit(eos)))
                .when(t["role"] == "system", c))
    error = F.when(~alternating, F.lit("Conversation roles must alternate user/assistant/user/assistant/..."))
    return F.struct(F.when(error.isNull(), F.concat(F.lit(bos), _join(conv, piece))).alias("text"),
                    error.alias("error"))


def header_template(conv: Column, bos: str = LLAMA3_BOS, add_generation_prompt: bool = False) -> Column:
    """PRJ21: header markers, stripped content, ``<|eot_id|>``; BOS before turn 0."""
    def piece(t: Column, i: Column) -> Column:
        body = F.concat(F.lit(HEADER_START), _content_text(t["role"]), F.lit(HEADER_END + "\n\n"),
                        ustrip(_content_text(t["content"])), F.lit(EOT))
        return F.when(i == 0, F.concat(F.lit(bos), body)).otherwise(body)
    out = _join(conv, piece)
    if add_generation_prompt:
        out = F.concat(out, F.lit(HEADER_START + "assistant" + HEADER_END + "\n\n"))
    return out


def one_line(text: Column) -> Column:
    """PRJ22: newlines to spaces, one document per line."""
    return F.translate(text, "\n", " ")


TEMPLATES = {
    "chatml_strict": chatml_strict,
    "chatml": chatml,
    "llama2": llama2,
    "instruction_ja": instruction_ja,
    "role_upper": role_upper,
    "vicuna": vicuna,
    "header": header_template,
}


# --------------------------------------------------------------------------- flat turn tables

def chatml_strict_piece(role: Column, content: Column) -> Column:
    """One PRJ13 piece (null when the stripped role or content is empty)."""
    r, c = ustrip(F.coalesce(role, F.lit(""))), ustrip(F.coalesce(content.cast("string"), F.lit("")))
    return F.when((F.length(r) > 0) & (F.length(c) > 0), F.concat(F.lit(IM_START), r, F.lit("\n"), c, F.lit(IM_END)))


def chatml_strict_flat(flat: DataFrame, id_col: str = "conv_id", order_col: str = "turn",
                       role_col: str = "role", content_col: str = "text") -> DataFrame:
    """PRJ13 on a flat turn table: ``id, text, n_turns``.

    Each turn's piece is built on its own row (plain codegen'd expressions, no
    lambdas), then one ``groupBy`` collects ``(order, piece)`` pairs and the
    ordered pieces are joined; same text as ``chatml_strict`` on the nested
    conversation, about twice as fast.
    """
    pieces = flat.select(id_col, order_col, chatml_strict_piece(F.col(role_col), F.col(content_col)).alias("_p"))
    grouped = (pieces.groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct(order_col, "_p"))).alias("_t"),
                    F.count(F.lit(1)).alias("n_turns")))
    ps = F.col("_t")["_p"]
    text = F.when(F.size(F.array_compact(ps)) > 0, F.concat(F.array_join(ps, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return grouped.select(id_col, text.alias("text"), "n_turns")


def render_flat(flat: DataFrame, piece, id_col: str = "conv_id", order_col: str = "turn",
                role_col: str = "role", content_col: str = "text", sep: str = "", suffix: str = "") -> DataFrame:
    """Any per-turn template (pieces that do not depend on the turn's position) on a
    flat turn table: ``id, text``.

    ``piece`` maps a ``struct<role, content>`` Column to the turn's text (null to
    skip); it is evaluated per row with codegen'd expressions before the one
    ``groupBy`` that joins the ordered pieces with ``sep`` and appends ``suffix``.
    """
    t = F.struct(F.col(role_col).alias("role"), F.col(content_col).cast("string").alias("content"))
    pieces = flat.select(id_col, order_col, piece(t).alias("_p"))
    grouped = pieces.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(order_col, "_p"))).alias("_t"))
    text = F.concat(F.array_join(F.col("_t")["_p"], sep), F.lit(suffix)) if suffix else F.array_join(F.col("_t")["_p"], sep)
    return grouped.select(id_col, text.alias("text"))
