"""Context-aware translation through a pluggable backend."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnengine.functions.ordinal import running_sum
from turnengine.functions.sequence import hot_groups, with_before
from turnengine.functions.text import null_to_empty
from turnengine.sinks.buckets import BucketStore
from turnengine.storage import drop_materialized, materialize

#: Turns before the one to translate that the prompt shows (a fixed value).
CONTEXT = 4
#: What the prompt's two parts are headed by.
TITLES = ("Context:", "Translate:")
#: A backend: chat messages to a translation.
Backend = Callable[[list[dict[str, str]]], str]


def context_window(turns: DataFrame, n: int = CONTEXT) -> DataFrame:
    """turns (with turn_ord) plus context: the up to n turns before, by place in the conversation, in order."""
    if n <= 0:
        return turns.withColumn("context", F.array().cast("array<struct<speaker:string,italiano:string,napoletano:string>>"))
    shown = F.struct("speaker", "italiano", null_to_empty(F.col("napoletano")).alias("napoletano"))
    return with_before(turns, "conversazione", ["turn_ord"], n, hot_groups(turns, "conversazione"), lambda rows, before: rows.withColumn("context", F.collect_list(shown).over(before)))


def context_lines(context: Column) -> Column:
    """One line per turn of the context: its text, and its translation after an arrow if there is one."""
    return F.array_join(F.transform(context, lambda t: F.concat(F.lit("- "), t["italiano"], F.when(t["napoletano"] != "", F.concat(F.lit("  ->  "), t["napoletano"])).otherwise(F.lit("")))), "\n")


def prompt(context: list[tuple[str, str]], text: str, titles: tuple[str, str] = TITLES) -> str:
    """The user's message for a text, in plain Python; build_messages is the same as a column.

    context: text and translation (may be empty) of the turns before.
    """
    lines = [f"- {source}" + (f"  ->  {done}" if done else "") for source, done in context]
    return "\n".join([*([titles[0], *lines, ""] if lines else []), titles[1], text])


def build_messages(turns: DataFrame, system_prompt: str, titles: tuple[str, str] = TITLES) -> DataFrame:
    """turns (with context) plus messages: array of struct(role, content)."""
    context_title, task_title = titles
    user = F.concat(F.when(F.size("context") > 0, F.concat(F.lit(context_title + "\n"), context_lines(F.col("context")), F.lit("\n\n"))).otherwise(F.lit("")), F.lit(task_title + "\n"), F.col("italiano"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return turns.withColumn("messages", F.array(message("system", F.lit(system_prompt)), message("user", user)))


def with_retries(backend: Backend, tries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Backend:
    """backend, asked again after 2, 4, 8 seconds when it fails; the last failure waits too, then raises."""

    def ask(messages: list[dict[str, str]]) -> str:
        error: Exception | None = None
        for attempt in range(1, tries + 1):
            try:
                return backend(messages).strip()
            except Exception as e:  # noqa: BLE001  any failure of the service counts
                error = e
                sleep(base**attempt)
        raise RuntimeError(f"the backend failed {tries} times") from error

    return ask


TRANSLATED = "conversazione string, turn_index int, turn_ord int, napoletano string, fresh boolean, failed boolean"


def translate(turns: DataFrame, backend: Backend, system_prompt: str = "", context: int = CONTEXT, limit: int | None = None, pause: float = 0.0, titles: tuple[str, str] = TITLES, passed: DataFrame | None = None) -> DataFrame:
    """Translations of turns without one. Turn i sees the translations made just before it, so a conversation is
    worked through in order in one task; conversations run in parallel. A turn whose backend fails stays empty.

    turns: conversazione, turn_index, turn_ord, italiano, napoletano. limit: the first so many open turns over all
    conversations, by (conversazione, turn_ord), are tried. passed (conversazione, turn_ord): open turns that are not.
    """
    open_ = null_to_empty(F.col("napoletano")) == ""
    if passed is not None:
        turns = turns.join(passed.select("conversazione", "turn_ord", F.lit(True).alias("passed")), ["conversazione", "turn_ord"], "left")
        open_ = open_ & F.col("passed").isNull()
    work = turns.withColumn("chosen", open_).select("conversazione", "turn_index", F.col("turn_ord").cast("int").alias("turn_ord"), null_to_empty(F.col("italiano")).alias("italiano"), null_to_empty(F.col("napoletano")).alias("napoletano"), "chosen")
    if limit is not None:
        chosen = work.where("chosen").orderBy("conversazione", "turn_ord").limit(limit).select("conversazione", "turn_ord", F.lit(True).alias("chosen"))
        work = work.drop("chosen").join(chosen, ["conversazione", "turn_ord"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn_ord", ignore_index=True)
        done: list[str] = []
        fresh, failed = [], []
        for i, row in enumerate(pdf.itertuples(index=False)):
            text, bad = row.napoletano, False
            new = row.chosen and text == ""
            if new:
                user = prompt([(pdf.italiano[k], done[k]) for k in range(max(0, i - context), i)], row.italiano, titles)
                try:
                    text = backend([{"role": "system", "content": system_prompt}, {"role": "user", "content": user}])
                except Exception:  # noqa: BLE001  a failed turn is skipped
                    bad = True
                if pause:
                    time.sleep(pause)
            done.append(text)
            fresh.append(bool(new and not bad))
            failed.append(bad)
        return pd.DataFrame({"conversazione": pdf.conversazione, "turn_index": pdf.turn_index, "turn_ord": pdf.turn_ord, "napoletano": done, "fresh": fresh, "failed": failed})

    return work.groupBy("conversazione").applyInPandas(run, TRANSLATED)


TRIED = "conversazione string, turn_index int, turn_ord int, napoletano string, failed boolean"


def translate_wave(turns: DataFrame, backend: Backend, system_prompt: str = "", context: int = CONTEXT, per: int | None = None, remaining: int | None = None, pause: float = 0.0, titles: tuple[str, str] = TITLES) -> DataFrame:
    """The turns (TRIED) that one wave tries: the next per open turns of every conversation at once, in order within each.

    remaining: no open turn is tried that has so many open turns before it, over all conversations by (conversazione,
    turn_ord). So a wave never makes a translation that working through the turns one by one would not have made, and yet all
    conversations that the number reaches are worked on in parallel. turns: conversazione, turn_index, turn_ord, italiano,
    napoletano, and failed (true: passed over). A task gets the turns it tries and their contexts, not whole conversations.
    """
    order = Window.partitionBy("conversazione").orderBy("turn_ord")
    open_ = (null_to_empty(F.col("napoletano")) == "") & ~F.col("failed")
    work = turns.select("conversazione", "turn_index", F.col("turn_ord").cast("int").alias("turn_ord"), null_to_empty(F.col("italiano")).alias("italiano"), null_to_empty(F.col("napoletano")).alias("napoletano"), open_.alias("open"))
    most = [F.lit(per)] if per is not None else []
    if remaining is not None:
        counts = work.where("open").groupBy("conversazione").agg(F.count("*").alias("n"))
        quota = running_sum(counts, ["conversazione"], "n", "upto").select("conversazione", (F.lit(remaining) - F.col("upto") + F.col("n")).alias("quota")).where("quota > 0")
        work = work.join(quota, "conversazione")
        most.append(F.col("quota"))
    nth = F.sum(F.col("open").cast("int")).over(order)
    chosen = F.col("open") & (nth <= F.least(*most) if len(most) > 1 else nth <= most[0] if most else F.lit(True))
    work = work.withColumn("place", F.row_number().over(order)).withColumn("chosen", chosen)
    work = work.withColumn("needed", F.max("chosen").over(order.rowsBetween(0, max(context, 0)))).where("needed").select("conversazione", "turn_index", "turn_ord", "place", "italiano", "napoletano", "chosen")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[int, tuple[str, str]] = {}  # by place
        tried = []
        for row in pdf.sort_values("place").itertuples(index=False):
            text = row.napoletano
            if row.chosen:
                before = [seen[k] for k in range(row.place - context, row.place) if k in seen]
                text, failed = ask(backend, system_prompt, before, row.italiano, titles, pause)
                tried.append((row.conversazione, row.turn_index, row.turn_ord, text, failed))
            seen[row.place] = (row.italiano, text)
        return pd.DataFrame(tried, columns=[c.split()[0] for c in TRIED.split(", ")])

    return work.groupBy("conversazione").applyInPandas(run, TRIED)


def ask(backend: Backend, system_prompt: str, before: list[tuple[str, str]], text: str, titles: tuple[str, str] = TITLES, pause: float = 0.0) -> tuple[str, bool]:
    """(translation, whether the backend failed) of a text with its context."""
    try:
        found, failed = backend([{"role": "system", "content": system_prompt}, {"role": "user", "content": prompt(before, text, titles)}]), False
    except Exception:  # noqa: BLE001  a failed turn is skipped
        found, failed = "", True
    if pause:
        time.sleep(pause)
    return found, failed


def translate_in_waves(turns: DataFrame, store: BucketStore, per: int, limit: int | None = None, saved: Callable[[int], None] | None = None, **how: object) -> int:
    """Translate the open turns of turns, wave by wave, in a table that is saved after each; the number of new translations.

    A save rewrites the buckets of the conversations that changed. limit: that many turns are translated, the first that
    can be; turns whose backend fails do not count and are passed over. Whatever stops the run, store has what the
    waves before made. saved is called after each save with the number so far. how: as for translate_wave.
    """
    store.create(turns.withColumn("failed", F.lit(False)))
    made = 0
    while limit is None or made < limit:
        tried = materialize(translate_wave(store.read(), per=per, remaining=None if limit is None else limit - made, **how), "wave")
        told = tried.agg(F.count("*").alias("tried"), F.count_if(~F.col("failed")).alias("made")).first()
        if told["tried"]:
            store.update(tried.drop("turn_index"), ["conversazione", "turn_ord"])
        drop_materialized(tried)
        if not told["tried"]:
            break
        made += told["made"]
        if saved:
            saved(made)
    return made


def resume(turns: DataFrame, earlier: DataFrame) -> DataFrame:
    """turns with translations from an earlier run; turns the earlier run did not know stay open."""
    known = earlier.where(null_to_empty(F.col("napoletano")) != "").select("conversazione", "turn_index", F.col("napoletano").alias("earlier")).dropDuplicates(["conversazione", "turn_index"])
    return turns.join(known, ["conversazione", "turn_index"], "left").withColumn("napoletano", F.coalesce("earlier", "napoletano")).drop("earlier")
