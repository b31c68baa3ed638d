"""Translation over Structured Streaming.

translate_stream takes whole new conversations; the checkpoint remembers which files are done, so a run that stops is taken up
where it was, and every batch is appended as its own files, so what is done is safe before the next begins.

translate_turns takes turns as they come. A conversation's state, in Spark's state store under the checkpoint, is the last turns
with their translations, and which turns are done; so turns that arrive in later batches, or after a restart, see the context
that they would have seen in one run, and turns that arrive again are not translated again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnengine.functions.text import null_to_empty
from turnengine.operators.build import flatten
from turnengine.operators.translate import CONTEXT, TITLES, Backend, ask, translate
from turnengine.schema import SAMPLE
from turnengine.shipping import ship


def translate_stream(spark: SparkSession, source: str, target: str, checkpoint: str, backend: Backend, system_prompt: str = "") -> StreamingQuery:
    """Translate JSON-lines files of nested conversations as they arrive in source; rows go to target as Parquet."""

    def batch(samples: DataFrame, epoch: int) -> None:
        translate(flatten(samples), backend, system_prompt).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return spark.readStream.schema(SAMPLE).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TRANSLATED_TURN = "conversazione string, turn_index int, turn_ord int, napoletano string, fresh boolean, failed boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TurnTranslator(StatefulProcessor):
    """Of a conversation: recent, the last turns by place with their translations, and done, the places of all turns."""

    def __init__(self, backend: Backend, system_prompt: str = "", context: int = CONTEXT, titles: tuple[str, str] = TITLES):
        self.backend, self.system_prompt, self.context, self.titles = backend, system_prompt, context, titles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "turn_ord int, italiano string, napoletano string")
        self.done = handle.getMapState("done", "turn_ord int", "failed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        recent = sorted(tuple(r) for r in self.recent.get())
        out = []
        # a batch's turns of one conversation, in order: as many as arrived since the last
        for row in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: r.turn_ord):
            place = (int(row.turn_ord),)
            if self.done.containsKey(place):
                continue
            text, failed, new = row.napoletano, False, row.napoletano == ""
            if new:
                before = [(a, b) for at, a, b in recent if at < row.turn_ord][-self.context :] if self.context > 0 else []
                text, failed = ask(self.backend, self.system_prompt, before, row.italiano, self.titles)
            self.done.updateValue(place, (failed,))
            recent = sorted([*recent, (int(row.turn_ord), row.italiano, text)])[-max(self.context, 1) :]
            out.append((key[0], int(row.turn_index), int(row.turn_ord), text, bool(new and not failed), failed))
        if out:
            self.recent.put(recent)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSLATED_TURN.split(", ")])

    def close(self) -> None:
        pass


def translate_turns(turns: DataFrame, target: str, checkpoint: str, backend: Backend, system_prompt: str = "", context: int = CONTEXT) -> StreamingQuery:
    """Translate a stream of turns (conversazione, turn_index, turn_ord, italiano, napoletano); rows of TRANSLATED_TURN go to
    target as Parquet, each turn once.

    Turns of a conversation are expected in order from batch to batch (within one they may come in any); one that comes late is
    translated with those of the last turns that stand before it. Turns are dealt by conversation, since each needs the one before.
    """
    spark = turns.sparkSession
    ship(spark)
    rows = turns.select("conversazione", "turn_index", F.col("turn_ord").cast("int").alias("turn_ord"), null_to_empty(F.col("italiano")).alias("italiano"), null_to_empty(F.col("napoletano")).alias("napoletano"))
    done = rows.groupBy("conversazione").transformWithStateInPandas(TurnTranslator(backend, system_prompt, context), TRANSLATED_TURN, "Append", "none")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the store that keyed processors need; a query keeps the one that it was started with
    try:
        return done.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
