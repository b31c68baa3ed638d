"""Command line: python -m turnengine.cli COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnengine.operators import align, bertscore, build, merge, metrics, patch, quality, translate
from turnengine.schema import CORRECTION, EngineError
from turnengine.sinks import files as sinks
from turnengine.sinks.buckets import BucketStore
from turnengine.sources import files, workbook
from turnengine.sources.chat import ChatBackend
from turnengine.storage import materialize, measured


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnengine")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple, **switches: str) -> None:
        p = sub.add_parser(name)
        for flags, how in options:
            p.add_argument(*flags.split(), **how)
        for flag, text in switches.items():
            p.add_argument("--" + flag.replace("_", "-"), action="store_true", help=text)

    need = {"required": True}
    command("build", ("--corpus", need), ("--out", need), ("--conversations", {"nargs": "*"}), ("--conversation", {}), all="every conversation")
    command("fix", ("--json", need), ("--corrections", need), apply="write the result; otherwise only show it")
    command("translate", ("--input", need), ("--output", need), ("--only", {"nargs": "*"}), ("--key-file", {"default": ".api_key"}), ("--key-env", {"default": "CHAT_API_KEY"}), ("--url", need), ("--model", need), ("--prompt-file", need), ("--context", {"type": int, "default": 4}), ("--limit", {"type": int}), ("--temperature", {"type": float, "default": 0.0}), ("--sleep", {"type": float, "default": 0.0}), ("--save-every", {"type": int, "default": 10, "help": "turns of a conversation between saves"}))
    command("export", ("--json", need), ("--xlsx", need), split="one sheet per conversation")
    command("import", ("--xlsx", need), ("--csv", need), ("--json", need), ("--source", {}), allow_source_edits="take workbooks whose source texts were edited")
    command("verify", ("--xlsx", need), ("--json", need))
    command("score", ("--draft", need), ("--golden", need), ("--out", need), ("--csv", need), ("--only", {"nargs": "*"}), ("--limit", {"type": int}), ("--threshold", {"type": float, "default": metrics.THRESHOLD}), ("--chrf-word-order", {"type": int, "default": 0, "choices": (0, 2)}), ("--bert-model", {"default": bertscore.MODEL}), ("--bert-batch", {"type": int, "default": bertscore.BATCH}), bertscore="add BERTScore; its libraries and model must be installed")
    command("merge", ("--decisions", need), ("--structure", need), ("--out", need), ("--threshold", {"type": float}), ("--preview", {"type": int, "default": 10}), golden_only="always the golden text", no_source="leave out fonte and similarita")
    return top


def _flat(spark: SparkSession, path: str) -> DataFrame:
    """Flat turns of a sample file, with conv_ord and ord in file order."""
    samples = files.read_samples(spark, path).withColumnRenamed("ord", "conv_ord")
    order = samples.select(F.col("id").alias("conversazione"), "conv_ord")
    rows = build.flatten(samples.drop("conv_ord")).join(order, "conversazione")
    return rows.withColumn("ord", F.struct("conv_ord", "turn_ord"))


def _examples(rows: DataFrame, n: int, what: str, total: int | None = None) -> None:
    """The first n rows of a check that only warns, and how many there are."""
    total = rows.count() if total is None else total
    if total:
        print(f"{what}: {total}")
        for r in rows.orderBy(*align.KEY).limit(n).collect():
            print("  " + " | ".join(map(str, r)))


def merge_lines(final: DataFrame, counts: dict, rule: str, n: int) -> list[str]:
    """Console summary of a merge: totals, shares of either source, and the riskiest kept drafts. counts: what was seen when
    final was written (source_aggregates, kept_apart)."""
    per = final.groupBy("conversazione").count().orderBy("conversazione").limit(20).collect()
    lines = [f"turns: {counts['total']} ({', '.join(f'{r[0]} {r[1]}' for r in per)})", f"rule: {rule}"]
    lines += [f"  from {s}: {counts[s]} ({counts[f'{s}_pct'] or 0:.1f}%)" for s in (merge.GOLDEN, merge.DRAFT)]
    if apart := counts["kept_apart"]:
        lines.append(f"kept drafts that differ from the golden text: {apart}; the most distant:")
        for r in merge.riskiest(final, n).collect():
            lines += [f"  [{r['conversazione']} t{r['turn_index']}] {r['similarita']:.1f}%", f"     kept: {r['gemma']}", f"     left: {r['golden']}"]
    return lines


def _codes(spark: SparkSession, turns: DataFrame, only: list[str] | None) -> DataFrame | None:
    if not only:
        return None
    asked, unknown = build.select_conversations(turns.select(F.col("conversazione").alias("code")), conversations=only)
    quality.gate(unknown, "unknown conversations")
    return asked


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "build":
        tokens, meta = files.read_tokens(spark, files.find_transcripts(spark, a.corpus)), files.read_metadata(spark, files.find_metadata(spark, a.corpus))
        asked, unknown = build.select_conversations(tokens.select(F.col("conversazione").alias("code")), a.all, a.conversations, a.conversation)
        quality.gate(unknown, "conversations without a file")
        turns = build.build_turns(tokens, meta, asked).cache()
        if turns.isEmpty():
            print("no turns; nothing is written")
            return
        sinks.write_samples(build.nest(turns.drop("note")), f"{a.out}.json")
        sinks.write_flat(turns, f"{a.out}.csv")
        s = build.dataset_summary(turns).first()
        print(f"conversations: {s['conversations']}, turns: {s['turns']} ({s['turns_per_conversation']:.1f} each), Italian only: {s['italian_only']} ({100 * s['italian_only'] / s['conversations']:.1f}%)")
    elif a.command == "fix":
        turns = _flat(spark, a.json)
        table = spark.read.schema(CORRECTION).csv(a.corrections, header=True, escape='"', multiLine=True)
        status = patch.correction_status(turns, table)
        for r in status.orderBy("conversazione", "turn_index").toLocalIterator():
            print(f"[{r['conversazione']} t{r['turn_index']}] {r['status']}: {r['text']}")
        if a.apply and not status.where("status = 'modified'").isEmpty():
            sinks.write_samples(build.nest(patch.corrected(turns, table).drop("note")), a.json)
    elif a.command == "translate":
        turns = materialize(_flat(spark, a.output if files.exists(spark, a.output) else a.input), "turns")  # the output is written anew
        store = BucketStore(spark, f"{a.output}.state")
        if store.exists():  # an earlier run was stopped before it wrote its output
            turns = materialize(translate.resume(turns, store.read()), "turns")
        asked = _codes(spark, turns, a.only)
        work = turns if asked is None else turns.join(asked.select(F.col("code").alias("conversazione")), "conversazione", "left_semi")
        if build.todo_turns(work).isEmpty():
            print("nothing to translate")
            return
        backend = translate.with_retries(ChatBackend(a.url, a.model, files.load_key(a.key_file, a.key_env), a.temperature))
        with open(a.prompt_file, encoding="utf-8") as f:
            system = f.read()
        try:
            n = translate.translate_in_waves(work, store, a.save_every, a.limit, backend=backend, system_prompt=system, context=a.context, pause=a.sleep)
        finally:
            if store.exists():
                sinks.save(translate.resume(turns, store.read()), a.output)
                store.remove()
        print(f"translated: {n}")
    elif a.command == "export":
        sinks.write_workbook(_flat(spark, a.json), a.xlsx, a.split)
    elif a.command == "import":
        source = _flat(spark, a.source) if a.source and files.exists(spark, a.source) else None
        rows = workbook.read_workbook(spark, a.xlsx)
        if rows.isEmpty():
            raise EngineError("the workbook has no rows")
        turns = quality.import_rows(rows, source, a.allow_source_edits)
        sinks.write_flat(turns, a.csv)
        sinks.write_samples(build.nest(turns.drop("note")), a.json)
        for r in build.conversation_counts(turns).orderBy("conversazione").toLocalIterator():
            print(f"  {r['conversazione']}: {r['turns']} turns" + (f", {r['notes']} with a note" if r["notes"] else ""))
    elif a.command == "verify":
        rows = workbook.read_workbook(spark, a.xlsx)
        quality.gate(quality.structural(rows), "structural problems")
        mine = quality.rows_to_turns(rows).withColumn("turn_ord", F.col("turn_index"))
        quality.gate(quality.verify(mine, _flat(spark, a.json)), "differences", shown=20)
    elif a.command == "score":
        if a.bertscore:
            bertscore.require()
        draft, golden = _flat(spark, a.draft), _flat(spark, a.golden)
        asked = _codes(spark, draft, a.only)
        aligned, seen = measured(align.align_all(draft, golden), "aligned", **align.alignment_counts())
        pairs = align.pairs_of(aligned, asked)
        pairs = align.first_pairs(pairs, a.limit) if a.limit else pairs
        if not seen["pairs"] or pairs.isEmpty():
            raise EngineError("no aligned turns")
        pairs = bertscore.add_bertscore(pairs, a.bert_model, a.bert_batch) if a.bertscore else pairs
        decided = metrics.decisions(pairs, a.threshold, a.chrf_word_order, F.col("bertscore") if a.bertscore else None, keep_counts=True)
        scored, summary, corpus = metrics.written_scores(decided, a.chrf_word_order)
        differing = align.source_mismatch(pairs).select(*align.KEY)
        n_differing = seen["source_differs"] if asked is None and not a.limit else differing.count()
        checks = zip(("draft only", "golden only", "source text differs"), (*align.misaligned_of(aligned), differing), (seen["draft_only"], seen["golden_only"], n_differing), strict=True)
        warned, n_warned = [], 0
        for what, rows, n in checks:
            n_warned += n
            warned += [f"{what} {r['conversazione']} {r['turn_index']}" for r in rows.orderBy(*align.KEY).limit(sinks.SHOWN).collect()] if n else []
        about = sinks.About(a.draft, a.golden, a.threshold, a.chrf_word_order, a.bert_model if a.bertscore else None)
        print("\n".join(sinks.write_report(scored, summary, corpus, about, warned, a.out, n_warned)))
        sinks.write_scores(scored, a.csv)
    elif a.command == "merge":
        samples, structure, decided = files.read_samples(spark, a.structure), _flat(spark, a.structure), files.read_decisions(spark, a.decisions)
        final, seen = measured(merge.merge(structure.drop("ord"), decided, a.threshold, a.golden_only), "final", **merge.source_aggregates(), kept_apart=F.count_if(merge.is_kept_apart()), mismatched=F.count_if(merge.is_mismatched()))
        _examples(merge.undecided(structure, decided), 5, "turns without a decision, left out")
        if seen["mismatched"]:
            _examples(merge.merged_mismatch(final), 5, "source texts that differ from the scored ones", seen["mismatched"])
        sinks.write_final(final, f"{a.out}.csv", not a.no_source)
        sinks.write_samples(merge.regroup(samples, final.drop("note") if not a.no_source else final.drop("note", "fonte")), f"{a.out}.json")
        rule = "always golden" if a.golden_only else "the decisions' own" if a.threshold is None else f"golden below {a.threshold}"
        print("\n".join(merge_lines(final, seen, rule, a.preview)))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("turnengine").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args)
    except EngineError as e:
        raise SystemExit(str(e)) from e


if __name__ == "__main__":
    main()
