"""Edited documents as a stream: the latest text per document, its findings, and diagnostics.

Events are (uri, event, text, seq) with event one of open, change, save, close. Processing order is
arrival order within a document (seq); the last change wins and close deletes. State is keyed by uri
in the state store, so it is spread over executors and survives them with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orelode.plans import rules
from orelode.sources.python_facts import Facts, python_facts

EVENTS = "uri string, event string, text string, seq bigint"
LATEST = "uri string, text string, seq bigint, event string"
#: Rules that look at one document only.
LOCAL = ("complexity", "long-param-list", "large-function", "wide-tuple", "magic-number", "debug-artifact", "noop-statement", "unreachable", "swallow", "broad-except", "boolean-arg", "positional-literals", "inline-import", "private-import", "global-state", "guard-clauses", "builtin-shadow", "unnamed-condition", "loop-pipeline", "suppression", "type-ignore", "noqa")


def latest_texts(events: DataFrame) -> DataFrame:
    """A row whenever a document's text changes: its latest text, or null where it was closed. Works on streams and tables of micro-batches."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, seq = state.get if state.exists else (None, -1)
        last, changed = "", False
        for frame in frames:
            for row in frame.sort_values("seq").itertuples():
                if row.seq > seq:
                    seq, last, changed = row.seq, row.event, True
                    text = None if row.event == "close" else row.text if row.text is not None else text
        if last == "close":
            state.remove()
        elif changed:
            state.update((text, seq))
        if changed:
            yield pd.DataFrame({"uri": [key[0]], "text": [text], "seq": [seq], "event": [last]})

    return events.groupBy("uri").applyInPandasWithState(fold, LATEST, "text string, seq bigint", "append", GroupStateTimeout.NoTimeout)


def latest_batch(events: DataFrame) -> DataFrame:
    """The same over a finished table: one partial maximum per document."""
    last = events.groupBy("uri").agg(F.max_by(F.struct("event", "seq"), "seq").alias("e"), F.max_by("text", F.when(F.col("text").isNotNull(), F.col("seq"))).alias("text"))
    return last.filter("e.event <> 'close'").select("uri", "text", F.col("e.seq").alias("seq"), F.col("e.event").alias("event"))


def diagnostics(documents: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Findings of single documents as editor diagnostics: line from 0, severity 1 (fail) or 2 (warn)."""
    files = documents.filter("text is not null").select(F.col("uri").alias("rel"), F.col("text").alias("content"))
    found = rules.findings(rules.Tables(python_facts(files)), [s for s in LOCAL if s not in (ignored or ())])
    return found.select(F.col("rel").alias("uri"), F.greatest(F.col("line") - 1, F.lit(0)).alias("line0"), F.when(F.col("severity") == "fail", 1).otherwise(2).alias("severity"), "signal", "message")


def publish(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, ignored: list[str] | None = None) -> DataStreamWriter:
    """Each micro-batch's changed documents are scanned and their diagnostics handed to the sink."""

    def batch(df: DataFrame, number: int) -> None:
        sink(diagnostics(df, ignored), number)

    return latest_texts(events).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def fact_rows(uri: str, text: str) -> int:
    """How many facts a text has (used to size batches)."""
    return len(Facts(uri, text).file())
