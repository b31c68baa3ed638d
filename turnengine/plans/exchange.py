"""Corpus files made of the test tables: written by the sinks, read back by the sources.

The folder is the one that the session shares between driver and executors.
"""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnengine import cli
from turnengine.functions.text import null_to_empty
from turnengine.operators import align, build, merge, metrics, quality, translate
from turnengine.plans import adapters as data
from turnengine.schema import FLAT_COLUMNS, FINAL_COLUMNS, EngineError
from turnengine.sinks import files as sinks
from turnengine.shipping import ship
from turnengine.sinks.buckets import BucketStore
from turnengine.sources import files, workbook
from turnengine.storage import measured, shared_dir
from turnengine.streaming import translate as translate_stream


def folder(spark: SparkSession) -> str:
    """A new folder, removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base and urlparse(base).scheme in ("", "file"):
        base = urlparse(base).path
    elif spark.sparkContext.master.startswith("local"):
        base = tempfile.gettempdir()
    else:
        raise EngineError("single-file exports need spark.checkpoint.dir to be a folder that the driver can write as files")
    path = os.path.join(base, f"exchange-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, True)
    return path


def _command(spark: SparkSession, *words: str) -> None:
    """A command of the command line, without what it prints."""
    with contextlib.redirect_stdout(io.StringIO()):
        cli.run(spark, cli.parser().parse_args(words))


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed turns: the source text as translation, with a leading apostrophe where k = 7 conv_id + turn is divisible
    by 11, and a note where 3 divides k."""
    k = F.col("conv_id") * 7 + F.col("turn")
    turns = data.structure(spark, sf_dir).withColumn("napoletano", F.concat(F.when(k % 11 == 0, "'").otherwise(""), "italiano")).withColumn("note", F.when(k % 3 == 0, "checked").otherwise(""))
    return turns.select(*FLAT_COLUMNS)


def write_transcripts(spark: SparkSession, sf_dir: str, path: str, texts: Callable[[str, list[str]], dict[str, str]]) -> None:
    """Transcripts, written by tasks to the shared folder: texts gives the files (name, text) of a conversation's code and lines."""
    ship(spark)
    line = F.concat_ws("\t", F.lit("0"), "speaker", "tu", F.lit("x"), "form", "type", "variation", "feats")
    told = data.tokens(spark, sf_dir).groupBy("conversazione").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda t: t["line"]).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for code, lines in zip(batch.column(0), batch.column(1), strict=True):
                for name, text in texts(code.as_py(), lines.as_py()).items():
                    made = f"{path}/{name}.{uuid.uuid4().hex}"  # a task that runs again puts the same file in its place
                    with open(made, "w", encoding="utf-8") as f:
                        f.write(text)
                    os.replace(made, f"{path}/{name}")
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    told.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as files and back. Each has a header and, as its second line, one with too few fields; where conv_id
    mod 10 is 3 there is an older file with the same code, which the later name overrides."""
    path = folder(spark)
    os.mkdir(f"{path}/tsv")

    def texts(code: str, lines: list[str]) -> dict[str, str]:
        older = {f"{code}.a.vert.tsv": "header\n" + "\t".join("older" * 8) + "\n"} if int(code) % 10 == 3 else {}
        return older | {f"{code}.b.vert.tsv": "\n".join(["header", lines[0], "short\tline", *lines[1:]]) + "\n"}

    write_transcripts(spark, sf_dir, f"{path}/tsv", texts)
    return files.read_tokens(spark, files.find_transcripts(spark, path))


def metadata_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as a file and back: a byte-order mark, one more column, and an older row of each code first."""
    path = folder(spark)
    os.mkdir(f"{path}/metadata")
    rows = data.metadata(spark, sf_dir).toPandas()
    with open(f"{path}/metadata/conversations.tsv", "w", encoding="utf-8-sig") as f:
        f.write("other\tlanguages\tmacro-region\tcollection-region\tcode\n")
        f.writelines(f"o\told\told\told\t{r.code}\n" for r in rows.itertuples())
        f.writelines(f'"\t{r.languages}\t{r.macro_regione}\t{r.regione}\t{r.code}\n' for r in rows.itertuples())
    return files.read_metadata(spark, files.find_metadata(spark, path))


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested conversations as an array, as JSON lines and, one alone, as an object, all read back flat."""
    path, nested = folder(spark), build.nest(review(spark, sf_dir))
    sinks.write_samples(nested, f"{path}/array.json")
    sinks.write_samples(nested.orderBy("id").limit(1), f"{path}/object.json")
    nested.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/lines")
    parts = [build.flatten(files.read_samples(spark, f"{path}/{name}")).withColumn("kind", F.lit(name.split(".")[0])) for name in ("array.json", "lines", "object.json")]
    return parts[0].union(parts[1]).union(parts[2]).select("kind", *FLAT_COLUMNS)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = files.read_csv(spark, path).drop("ord")
    return rows.select(*[null_to_empty(F.col(c)).alias(c) for c in rows.columns])


def saved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a save leaves: the CSV with notes, the JSON without."""
    path = folder(spark)
    sinks.save(review(spark, sf_dir), f"{path}/saved.json")
    json = build.flatten(files.read_samples(spark, f"{path}/saved.json"))
    return read_csv(spark, f"{path}/saved.csv").withColumn("kind", F.lit("csv")).unionByName(json.select(*[F.col(c).cast("string").alias(c) for c in FLAT_COLUMNS], F.lit("json").alias("kind")))


def score_file(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """A score table as a file and back as decisions."""
    path = folder(spark)
    sinks.write_scores(scored, f"{path}/scores.csv")
    return files.read_decisions(spark, f"{path}/scores.csv").drop("ord")


def report_file(spark: SparkSession, draft: DataFrame, golden: DataFrame) -> DataFrame:
    """The paragraphs of a report: alignment written once, scores written once, and what both passes saw."""
    path = folder(spark)
    about = sinks.About("draft.json", "golden.json", metrics.THRESHOLD)
    aligned, seen = measured(align.align_all(draft, golden), "aligned", **align.alignment_counts())
    scored, summary, corpus = metrics.written_scores(metrics.decisions(align.pairs_of(aligned), keep_counts=True))
    warned = [f"draft only {r['conversazione']} {r['turn_index']}" for r in align.misaligned_of(aligned)[0].orderBy(*align.KEY).limit(sinks.SHOWN).collect()]
    sinks.write_report(scored, summary, corpus, about, warned, f"{path}/report.txt", seen["draft_only"])
    return spark.read.text(f"{path}/report.txt", lineSep="\n\n").select(F.rtrim("value", F.lit("\n")).alias("paragraph"))


def final_files(spark: SparkSession, sf_dir: str, scored: DataFrame) -> DataFrame:
    """The merge command over files: its CSV with and without source, and its JSON."""
    path, parts = folder(spark), []
    sinks.write_scores(scored, f"{path}/scores.csv")
    sinks.write_samples(build.nest(data.structure(spark, sf_dir)), f"{path}/structure.json")
    for name, options in (("with", []), ("without", ["--no-source"])):
        _command(spark, "merge", "--decisions", f"{path}/scores.csv", "--structure", f"{path}/structure.json", "--out", f"{path}/{name}", *options)
        rows = read_csv(spark, f"{path}/{name}.csv")
        parts.append(rows.select(F.lit(name).alias("kind"), *[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in FINAL_COLUMNS]))
    json = build.flatten(files.read_samples(spark, f"{path}/with.json"))
    parts.append(json.select(F.lit("json").alias("kind"), *[F.col(c).cast("string").alias(c) if c in json.columns else F.lit("").alias(c) for c in FINAL_COLUMNS]))
    whole = parts[0].union(parts[1]).union(parts[2])
    return whole.withColumn("similarita", F.round(F.when(F.col("similarita") != "", F.col("similarita")).cast("double"), 2))


def regrouped(spark: SparkSession, sf_dir: str, scored: DataFrame) -> DataFrame:
    """Conversations of a merge from which every decision of those with conv_id mod 4 = 1 is missing."""
    samples = build.nest(data.structure(spark, sf_dir)).withColumn("ord", F.col("id").cast("bigint"))
    final = merge.merge(data.structure(spark, sf_dir), scored.where("conversazione % 4 <> 1"))
    return merge.regroup(samples, final.drop("note")).select("id", "regione", "macro_regione", "languages", "n_turni_italiani", F.size("turni").alias("n"), F.array_join(F.transform("turni", lambda t: F.concat(t["turn_index"].cast("string"), F.lit(":"), t["fonte"])), "|").alias("turns"))


def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export command over a file, in both layouts, and the rows of the workbooks."""
    path, parts = folder(spark), []
    sinks.write_samples(build.nest(review(spark, sf_dir)), f"{path}/in.json")
    for kind, options in (("single", []), ("split", ["--split"])):
        _command(spark, "export", "--json", f"{path}/in.json", "--xlsx", f"{path}/{kind}.xlsx", *options)
        parts.append(workbook.read_workbook(spark, f"{path}/{kind}.xlsx").withColumn("kind", F.lit(kind)))
    return parts[0].union(parts[1])


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import command over an exported workbook: its CSV and its JSON."""
    path = folder(spark)
    turns = review(spark, sf_dir)
    sinks.write_samples(build.nest(turns), f"{path}/in.json")
    sinks.write_workbook(turns, f"{path}/w.xlsx")
    _command(spark, "import", "--xlsx", f"{path}/w.xlsx", "--csv", f"{path}/out.csv", "--json", f"{path}/out.json", "--source", f"{path}/in.json")
    json = build.flatten(files.read_samples(spark, f"{path}/out.json"))
    return read_csv(spark, f"{path}/out.csv").withColumn("kind", F.lit("csv")).unionByName(json.select(*[F.col(c).cast("string").alias(c) for c in FLAT_COLUMNS], F.lit("json").alias("kind")))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates of import and verify say of flawed rows: the number of items shown, and whether more are left out."""
    rows = data.workbook_rows(spark, sf_dir)
    drifted = data.edited(spark, sf_dir), data.structure(spark, sf_dir)
    found = []
    for name, violations in (("structural", quality.structural(rows)), ("drift", quality.drift(*drifted)), ("none", quality.drift(drifted[1], drifted[1]))):
        try:
            quality.gate(violations, name)
            found.append((name, 0, False))
        except EngineError as e:
            found.append((name, str(e).count("; ") + 1, str(e).endswith(" and more")))
    return spark.createDataFrame(found, "gate string, shown int, more boolean")


def fixed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fix command over files."""
    path = folder(spark)
    sinks.write_samples(build.nest(data.structure(spark, sf_dir).withColumn("napoletano", F.col("italiano"))), f"{path}/in.json")
    data.corrections(spark, sf_dir).write.csv(f"{path}/corrections", header=True)
    _command(spark, "fix", "--json", f"{path}/in.json", "--corrections", f"{path}/corrections", "--apply")
    return build.flatten(files.read_samples(spark, f"{path}/in.json")).select("conversazione", "turn_index", "napoletano")


def built_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build command over transcripts and metadata: conversations in the order asked for."""
    path = folder(spark)
    os.mkdir(f"{path}/in")
    write_transcripts(spark, sf_dir, f"{path}/in", lambda code, lines: {f"{code}.vert.tsv": "\n".join(["header", *lines])})
    with open(f"{path}/in/conversations.tsv", "w", encoding="utf-8") as f:
        f.write("code\tcollection-region\tmacro-region\tlanguages\n")
        f.writelines(f"{r.code}\t{r.regione}\t{r.macro_regione}\t{r.languages}\n" for r in data.metadata(spark, sf_dir).toPandas().itertuples())
    _command(spark, "build", "--corpus", f"{path}/in", "--out", f"{path}/out", "--conversations", "7", "3", "10")
    csv = files.read_csv(spark, f"{path}/out.csv").withColumnRenamed("ord", "at").fillna("")
    places = csv.groupBy("conversazione").agg(F.min("at").alias("at"))  # three rows
    places = places.select("conversazione", F.row_number().over(Window.orderBy("at")).alias("place"))
    return csv.join(places, "conversazione").select("place", *FLAT_COLUMNS)


def toy(messages: list[dict[str, str]]) -> str:
    """A backend that shows what it was given: the length of its prompt, and the end of the text."""
    user = messages[1]["content"]
    return f"{len(user)}:{user[-20:]}"


class Flaky:
    """toy, but every message fails twice before it is answered."""

    def __init__(self) -> None:
        self.asked: dict[str, int] = {}

    def __call__(self, messages: list[dict[str, str]]) -> str:
        key = messages[1]["content"]
        self.asked[key] = self.asked.get(key, 0) + 1
        if self.asked[key] % 3:
            raise OSError("busy")
        return toy(messages)


def refusing(messages: list[dict[str, str]]) -> str:
    """toy, but texts whose length is divisible by 5 always fail."""
    text = messages[1]["content"].split("Translate:\n")[-1]
    if len(text) % 5 == 0:
        raise OSError("refused")
    return toy(messages)


def translated_file(spark: SparkSession, turns: DataFrame, system_prompt: str, limit: int, per: int) -> DataFrame:
    """A run of the translation command's loop, stopped at its limit: the file made of its last save."""
    path = folder(spark)
    store = BucketStore(spark, f"{path}/state", buckets=8)
    translate.translate_in_waves(turns, store, per, limit, backend=refusing, system_prompt=system_prompt)
    sinks.save(store.read().drop("failed"), f"{path}/out.json")
    return build.flatten(files.read_samples(spark, f"{path}/out.json")).select("conversazione", "turn_index", "napoletano")


def translated_stream(spark: SparkSession, turns: DataFrame, system_prompt: str) -> DataFrame:
    """Turns that arrive in four deliveries, the next part of every conversation in each, one micro-batch a delivery; the stream
    is stopped after each and taken up from its checkpoint. The last also holds turns that came before. A delivery has a file
    for each part of the table, so that no task reads or writes it whole."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = "conversazione string, turn_index int, turn_ord long, italiano string, napoletano string"
    rows = turns.select("conversazione", "turn_index", "turn_ord", "italiano", "napoletano")
    quarter = F.least(F.floor(F.col("turn_ord") / 2), F.lit(3))
    for k in range(4):
        again = rows.where((quarter < k) & (F.lit(k) == 3) & (F.col("turn_ord") % 3 == 0))
        rows.where(quarter == k).union(again).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        query = translate_stream.translate_turns(stream, f"{path}/out", f"{path}/checkpoint", toy, system_prompt)
        query.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("conversazione", "turn_index", "napoletano", "fresh")
