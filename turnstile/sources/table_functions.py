"""Sample processors as SQL table functions (SRC11, the extension surface of named datasets).

A processor turns one sample into the fields it names.  ``register_processors`` makes them callable from SQL:

    SELECT * FROM process_samples(TABLE(samples), 'conversation_text')

The schema is worked out when the query is analysed, from the processor's name and the columns of the table: the columns
that are no sample fields pass through, the processor's fields follow.  An unknown name is an error that lists the names
there are, before any row is read.  Rows are sent to Python in Arrow batches, whatever partitions the table has; where a
processor has a Column form (``turns.sample_text``), that is the faster way.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

SAMPLE_FIELDS = ("text", "conversations", "messages")


@dataclass(frozen=True)
class Processor:
    """``run`` gets a sample as a dict (turns are dicts) and returns the values of ``fields``."""

    fields: StructType
    run: Callable[[dict], Sequence]


def _sample_text(sample: dict) -> tuple[str | None]:
    """Non-empty text, else a line for each turn; missing and empty values fall back, as in ``turns.sample_text``."""
    if sample.get("text"):
        return (sample["text"],)
    turns = sample.get("conversations")
    if turns is None:
        return (None,)
    return ("\n".join(f"{t.get('role') or t.get('from') or 'unknown'}: {t.get('content') or t.get('value') or ''}" for t in turns),)


def _turn_counts(sample: dict) -> tuple[int, int]:
    turns = sample.get("conversations") or []
    return len(turns), sum(len(t.get("content") or t.get("value") or "") for t in turns)


TEXT = StructType([StructField("sample_text", StringType())])
PROCESSORS: dict[str, Processor] = {
    "conversation_text": Processor(TEXT, _sample_text),
    "turn_counts": Processor(StructType([StructField("n_turns", LongType()), StructField("n_chars", LongType())]), _turn_counts),
}


def register_processors(spark: SparkSession, processors: Mapping[str, Processor] = PROCESSORS, name: str = "process_samples") -> None:
    """Register the table function ``name(TABLE(rows), processor)`` in the session."""
    known = dict(processors)
    names = sorted(known)
    hidden = SAMPLE_FIELDS

    class ProcessSamples:
        @staticmethod
        def analyze(rows: AnalyzeArgument, processor: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table: TABLE(name) or TABLE(SELECT ...)")
            if not processor.isConstantExpression or processor.value not in known:
                raise ValueError(f"no sample processor {processor.value!r}; there are: {', '.join(names)}")
            kept = [f for f in rows.dataType.fields if f.name not in hidden]
            return AnalyzeResult(StructType([*kept, *known[processor.value].fields.fields]))

        def eval(self, row, processor: str):
            sample = row.asDict(recursive=True)
            yield (*(v for k, v in sample.items() if k not in hidden), *known[processor].run(sample))

    spark.udtf.register(name, udtf(ProcessSamples, useArrow=True))
