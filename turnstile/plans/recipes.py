"""Mix recipes (MIX7, PRF4) as data, and the builders that turn a recipe into one
logical plan: per-source read -> normalise -> slice -> union -> seeded order.

A source that fails (unreadable, missing message column, malformed split)
is isolated: it contributes no rows and gets a row in the ``source_status``
table instead of aborting the build (MIX2, MIX8, FLT7).  ``strict=True``
raises instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mix, turns
from ..operators.mix import SliceSyntaxError, parse_split
from ..sources.tables import load_table


@dataclass(frozen=True)
class SourceSpec:
    name: str
    split: str = "train"
    field_messages: str = "conversations"
    path: str | None = None
    role_map: Mapping[str, Sequence[str]] | None = None
    shuffle_seed: int | None = None
    property_map: Mapping[str, str] | None = None      # e.g. {"role": "from", "content": "value"}

    @property
    def percent(self) -> float | None:
        """Upper percent bound of a valid ``train[:p%]`` split (100 for the whole split)."""
        try:
            spec = parse_split(self.split)
        except SliceSyntaxError:
            return None
        if spec.start is None and spec.stop is None:
            return 100
        return spec.stop if spec.percent and spec.start is None else None


@dataclass
class Recipe:
    sources: list[SourceSpec]
    seed: int = 42
    shuffle: bool = True
    order_cols: Sequence[str] = ("id",)
    strict: bool = True                 # False: a bad source becomes a status row instead of an error
    extra: dict = field(default_factory=dict)


def status_frame(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "source string, status string, message string")


# Split pattern of the document-source recipe used on the driver
# tables, one entry per source in order (the reference mixes full splits with
# 5-50 % slices; one malformed entry shows the MIX2 isolation).
DOCUMENT_SPLITS = ["train", "train[:25%]", "train[:50%]", "train[:10%]", "train[:8%]", "train[:5%]",
                   "train[:20%]", "train[10%]"]


# The slices of the known mixes, one entry per source in order; in the mid-training
# mix the second and third entry are one table read through two message columns.
CATALOG_SPLITS = {
    "instruction-1": ["train", "train", "train[:25%]", "train[:25%]", "train[:8%]", "train[:8%]", "train", "train[:50%]"],
    "instruction-2": ["train", "train", "train[:50%]", "train[:25%]", "train", "train", "train[:25%]", "train", "train",
                      "train[:10%]", "train[:10%]", "train"],
    "mid-training": ["train"] * 16,
    "single-source": ["train"],
}
CATALOG_COLUMNS = {"mid-training": {1: "messages", 2: "original_messages", 3: "original_messages"}}


def catalog_recipe(name: str, sources: Sequence[str], order_cols: Sequence[str] = ("id",)) -> Recipe:
    """A known mix over the caller's sources, in the order of its slices."""
    splits, columns = CATALOG_SPLITS[name], CATALOG_COLUMNS.get(name, {})
    if len(sources) != len(splits):
        raise ValueError(f"recipe {name!r} has {len(splits)} sources, got {len(sources)}")
    return Recipe([SourceSpec(s, split, columns.get(i, "conversations")) for i, (s, split) in enumerate(zip(sources, splits))],
                  order_cols=order_cols)


def document_recipe(names: Sequence[str] = tuple(f"src{i}" for i in range(20))) -> Recipe:
    """Recipe over ``documents`` sources; one of the patterns is malformed, so it isn't strict."""
    specs = [SourceSpec(name, DOCUMENT_SPLITS[i % len(DOCUMENT_SPLITS)]) for i, name in enumerate(names)]
    return Recipe(specs, order_cols=("doc_id",), strict=False)


def build_document_mix(spark: SparkSession, sf_dir: str, recipe: Recipe) -> tuple[DataFrame, DataFrame]:
    """Sources are the ``source`` groups of ``documents``: all slices come from one
    indexed scan (grouped row index), not one job per source."""
    docs = load_table(spark, sf_dir, "documents")
    per_group, status = {}, []
    for s in recipe.sources:
        try:
            per_group[s.name] = parse_split(s.split)
            status.append((s.name, "ok", s.split))
        except SliceSyntaxError as exc:
            if recipe.strict:
                raise
            status.append((s.name, "error", str(exc)))
    named = {s.name for s in recipe.sources}
    for row in docs.groupBy("source").count().collect():           # one row per source
        if row["source"] not in named:
            status.append((row["source"], "not in the recipe", f"{row['count']} rows left out"))
    if not per_group:
        raise ValueError("no source of the recipe could be used")
    mixed = mix.slice_rows(docs, None, list(recipe.order_cols), ["source"], per_group=per_group)
    return mixed, status_frame(spark, status)


def build_conversation_mix(spark: SparkSession, recipe: Recipe,
                           reader: Callable[[SparkSession, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """SFT mix (pipeline A): each source read, normalised (PRJ1-5, FLT1-2), sliced
    (MIX1), optionally shuffled (MIX5), rebuilt (PRJ6) and unioned (MIX3); the
    union is ordered by a seeded hash (MIX6) unless ``shuffle`` is off (MIX15)."""
    parts, status = [], []
    for s in recipe.sources:
        try:
            spec = parse_split(s.split)
            raw = reader(spark, s.path or s.name)
            if s.field_messages not in raw.columns:
                raise turns.SourceError(f"no column {s.field_messages!r} for the messages; there are {raw.columns}")
            raw = mix.slice_rows(raw, spec, list(recipe.order_cols))          # the split is taken at load
            conv = turns.load_conversation(raw, s.field_messages, s.role_map or turns.DEFAULT_ROLE_MAP,
                                           fields=[*recipe.order_cols, "conversations"],
                                           property_map=s.property_map)
            if s.shuffle_seed is not None:
                conv = mix.deterministic_shuffle(conv, list(recipe.order_cols), s.shuffle_seed)
            conv = turns.rebuild_clean_schema(conv, "conversations", keep=list(recipe.order_cols))
            parts.append(conv.withColumn("source", F.lit(s.name)))
            status.append((s.name, "ok", s.split))
        except (turns.SourceError, SliceSyntaxError, AnalysisException) as exc:      # MIX8; a failed job is no bad source
            if recipe.strict or isinstance(exc, AnalysisException) and exc.getCondition() != "PATH_NOT_FOUND":
                raise
            status.append((s.name, "error", str(exc).splitlines()[0][:500]))
    if not parts:
        raise ValueError("no source of the recipe could be used")
    union = mix.concat_sources(parts)
    if recipe.shuffle:
        union = mix.deterministic_shuffle(union, ["source", *recipe.order_cols], recipe.seed)
    return union, status_frame(spark, status)


def build_preference_mix(parts: Sequence[DataFrame], seed: int = 42, shuffle: bool = True,
                         check_empty: bool = True) -> DataFrame:
    """DPO mix (pipeline D): adapters already produced ``id, source, chosen, rejected``;
    union (MIX3), refuse an empty result (MIX9), seeded order (MIX6)."""
    union = mix.concat_sources([p.select("id", "source", "chosen", "rejected") for p in parts])
    if check_empty and union.isEmpty():
        raise ValueError("No data to save")
    return mix.deterministic_shuffle(union, ["source", "id"], seed) if shuffle else union
