"""Single-file exports. Tasks write the text of their rows to the shared folder, and the driver copies it into one file, so no row
is sent to it (of a workbook, tasks write the deflated bytes); files appear whole or not at all.

These are hand-over formats for people, as large as a person can read. Data sets go to df.write instead.
"""

from __future__ import annotations

import base64
import csv
import io
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnengine.functions.ordinal import running_sum, with_ordinal
from turnengine.operators.bertscore import bert_text
from turnengine.operators.build import file_order, nest
from turnengine.operators.metrics import WEIGHTS
from turnengine.schema import FLAT_COLUMNS, META_SHEET, SCORE_COLUMNS, TURN_SHEET, EngineError
from turnengine.shipping import ship
from turnengine.sinks import zipped
from turnengine.sources.workbook import CONVERSATIONS, FIXED, LISTS, MAX_TITLE, SINGLE, sheet_file, sheet_head, sheet_row, sheet_tail
from turnengine.storage import materialize, scratch, shared_dir


#: Warnings that a report lists (a fixed value).
SHOWN = 30
#: Rows that are rendered as one text.
_BATCH = 1000
#: Bytes that a task puts in order, about.
_COPIED = 32 << 20


def _append(texts: DataFrame, target: str, glue: str, encoded: bool = False) -> None:
    """The texts (one string column, in order), each with glue behind it, at the end of a file. Tasks write them to the shared
    folder; the driver copies their files one behind the other, a few MB at a time. encoded: every partition's is base64."""
    spark = texts.sparkSession
    made = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = jvm.org.apache.hadoop.fs.Path(made)
    files = parts.getFileSystem(hadoop)
    try:
        texts.write.option("lineSep", glue).option("maxRecordsPerFile", 0).option("compression", "none").text(made)
        out = jvm.java.io.FileOutputStream(target, True)
        try:
            for part in sorted((x.getPath() for x in files.listStatus(parts)), key=lambda x: x.getName()):
                if part.getName().startswith("part-"):
                    stream = files.open(part)
                    try:
                        plain = jvm.java.util.Base64.getMimeDecoder().wrap(jvm.java.io.BufferedInputStream(stream, 1 << 16)) if encoded else stream
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(plain, out, 1 << 22, False)
                    finally:
                        stream.close()
        finally:
            out.close()
    finally:
        files.delete(parts, True)


def _assembled(texts: DataFrame, path: str, before: str, glue: str, finish: Callable[[IO], None] | None = None) -> None:
    """before and the texts, as _append() takes them, as one file. finish gets the file, open at its end."""
    target = os.path.abspath(f"{path}.tmp")
    with open(target, "wb") as f:
        f.write(before.encode())
    _append(texts, target, glue)
    if finish is not None:
        with open(target, "r+b") as f:
            f.seek(0, os.SEEK_END)
            finish(f)
    os.replace(target, path)


def _rendered(rows: DataFrame, render_: Callable[[list[dict]], str]) -> DataFrame:
    """A text for each batch of rows."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([render_(batch.slice(at, _BATCH).to_pylist())], pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def sample_text(sample: dict, indent: str = "") -> str:
    """A conversation as JSON: metadata one field a line, one compact turn a line."""
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    head = [f'{indent}  {dump(k)}: {dump(v)},' for k, v in sample.items() if k != "turni"]
    turns = [f"{indent}    {dump(t)}" for t in sample["turni"]]
    listed = f'{indent}  "turni": [' + ("\n" + ",\n".join(turns) + f"\n{indent}  ]" if turns else "]")
    return "\n".join([indent + "{", *head, listed, indent + "}"])


def write_samples(samples: DataFrame, path: str, turn_fields: list[str] | None = None) -> None:
    """Nested conversations as JSON: one is an object, any other number an array; by conv_ord if there is one, else by id."""
    inner = ("ord", "conv_ord")

    def texts(rows: list[dict]) -> str:
        plain = ({k: v for k, v in r.items() if k not in inner} for r in rows)
        found = (r | {"turni": [{k: v for k, v in t.items() if v is not None and (turn_fields is None or k in turn_fields)} for t in r["turni"] or []]} for r in plain)
        return ",\n".join(sample_text(r, "  ") for r in found)

    rows = samples.orderBy("conv_ord" if "conv_ord" in samples.columns else "id")

    def finish(f: IO) -> None:
        if f.tell() == 2:
            f.write(b"]\n")
            return
        f.seek(-2, os.SEEK_END)
        f.truncate()
        f.seek(0)
        starts = (line for line in f if line == b"  {\n")  # the first line of a conversation, and no other
        if next(starts) and next(starts, None):
            f.seek(0, os.SEEK_END)
            f.write(b"\n]\n")
            return
        f.seek(2)
        text = f.read().decode()  # one conversation; its line breaks are those of sample_text
        f.seek(0)
        f.truncate()
        f.write(("\n".join(line.removeprefix("  ") for line in text.split("\n")) + "\n").encode())

    _assembled(_rendered(rows, texts), path, "[\n", ",\n", finish)


def write_csv(rows: DataFrame, path: str, fields: list[str], order: list[str]) -> None:
    """CSV with a byte-order mark and a header; other columns are left out."""

    def lines(rows_: list[dict]) -> str:
        out = io.StringIO(newline="")
        csv.writer(out).writerows([["" if v is None else v for v in r.values()] for r in rows_])
        return out.getvalue().removesuffix("\r\n")

    head = io.StringIO(newline="")
    csv.writer(head).writerow(fields)
    _assembled(_rendered(rows.orderBy(*order).select(*fields), lines), path, "\ufeff" + head.getvalue(), "\r\n")


def write_flat(turns: DataFrame, path: str) -> None:
    write_csv(turns, path, FLAT_COLUMNS, file_order(turns))


def save(turns: DataFrame, path: str) -> None:
    """Flat turns as nested JSON without notes, and beside it as CSV with them."""
    write_samples(nest(turns.drop("note")), path)
    write_flat(turns, f"{os.path.splitext(path)[0]}.csv")


def write_scores(scored: DataFrame, path: str) -> None:
    """The score table; scores to four places."""
    scores = {c: F.round(c, 4) for c in ("bertscore", "bleu", "rouge", "chrf", "similarita")}
    rows = scored.withColumns(scores).withColumn("sostituire", F.initcap(F.col("sostituire").cast("string")))
    write_csv(rows, path, SCORE_COLUMNS, ["ord"])


def write_final(final: DataFrame, path: str, with_source: bool = True) -> None:
    write_csv(final, path, [*FLAT_COLUMNS, *(["fonte", "similarita"] if with_source else [])], file_order(final))


@dataclass(frozen=True)
class About:
    """What a report says of its run."""

    hypothesis: str
    reference: str
    threshold: float
    word_order: int = 0
    bert_model: str | None = None


def report_lines(summary: DataFrame, corpus: DataFrame, about: About, warnings: list[str], n_warnings: int | None = None, shown: int = SHOWN) -> list[str]:
    """Head of the report: the run's parameters, counts, means, corpus scores, and the first warnings with the number
    left out. n_warnings: how many there are in all, where warnings are only the first."""
    s, c = summary.first(), corpus.first()
    mean = {k: s[f"mean_{k}"] or 0.0 for k in ("chrf", "bleu", "rouge", "similarita", "bertscore")}
    mass = 1.0 if about.bert_model else 1.0 - WEIGHTS["bertscore"]
    weights = ", ".join(f"{k} {w / mass:.0%}" for k, w in WEIGHTS.items() if about.bert_model or k != "bertscore")
    n_warnings = len(warnings) if n_warnings is None else n_warnings
    lines = [
        f"hypothesis: {about.hypothesis}", f"reference: {about.reference}", f"pairs: {s['pairs']}", f"BERTScore: {about.bert_model or 'off'}",
        f"chrF word order: {about.word_order}" + (" (chrF++)" if about.word_order else ""), f"weights: {weights}", f"threshold: replace below {about.threshold:.1f}%", "",
        f"mean BERTScore F1: {mean['bertscore'] / 100:.4f}" if about.bert_model else "mean BERTScore F1: n/d",
        f"mean sentence BLEU: {mean['bleu']:.2f}", f"mean ROUGE-L F1: {mean['rouge'] / 100:.4f}", f"mean sentence chrF: {mean['chrf']:.2f}",
        f"corpus BLEU: {c['corpus_bleu'] or 0:.2f}", f"corpus chrF: {c['corpus_chrf'] or 0:.2f}", f"mean similarity: {mean['similarita']:.2f} %",
        f"to replace: {s['to_replace']}/{s['pairs']} ({100 * s['to_replace'] / max(s['pairs'], 1):.1f}%)", f"identical: {s['identical']}",
    ]
    if n_warnings:
        listed = warnings[:shown]
        lines += ["", f"warnings: {n_warnings}", *(f"  - {w}" for w in listed), *([f"  ... and {n_warnings - len(listed)} more"] if n_warnings > len(listed) else [])]
    return lines


def write_report(scored: DataFrame, summary: DataFrame, corpus: DataFrame, about: About, warnings: list[str], path: str, n_warnings: int | None = None) -> list[str]:
    """The report: its head, which is returned, then one block per pair in draft order."""
    head = report_lines(summary, corpus, about, warnings, n_warnings)
    note = F.when(F.col("note") != "", F.concat(F.lit("\n  note: "), F.col("note"))).otherwise("")
    block = F.format_string(
        "[%s | turn %d | tu_id %s | speaker %s]\n  it: %s\n  draft: %s\n  golden: %s\n  chrF %.2f  BLEU %.2f  ROUGE-L %.4f  BERTScore %s  similarity %.2f %%  %s%s",
        "conversazione", "turn_index", "tu_id", "speaker", "italiano", "gemma", "golden", "chrf", "bleu", F.col("rouge") / 100, bert_text(F.col("bertscore"), about.bert_model is not None), "similarita", F.when(F.col("sostituire"), "REPLACE").otherwise("keep"), note,
    )

    def finish(f: IO) -> None:
        f.seek(-1, os.SEEK_END)  # an empty line stands between blocks only
        f.truncate()

    _assembled(scored.orderBy("ord").select(block.alias("value")), path, "\n".join(head) + "\n\n", "\n\n", finish)
    return head


_PIECE = "ord long, crc long, length long, blob binary"
_PIECE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _piece(*told: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(told, _PIECE_TYPES, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])


def _pieces(rows: DataFrame, number: str, render_: Callable[[dict], str]) -> DataFrame:
    """The texts of numbered rows, deflated: a piece for each run of rows that follow each other. Few pieces where the rows are as
    with_ordinal() gives them, but right in any order."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(batch.schema.get_field_index(number)).to_pylist()
            at = 0
            for i in range(1, len(told) + 1):
                if i == len(told) or i - at == _BATCH or told[i] != told[i - 1] + 1:
                    text = "".join(map(render_, batch.slice(at, i - at).to_pylist())).encode()
                    yield _piece(told[at], zlib.crc32(text), len(text), zipped.deflated(text))
                    at = i

    return materialize(rows.mapInArrow(run, _PIECE), "pieces")


def _in_order(rows: DataFrame, size: int, blob: Callable[[dict], bytes]) -> DataFrame:
    """The bytes of rows by ord, as text for _append(); size, about that of all, tells how many tasks make it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = b""
        for batch in batches:
            for at in range(batch.num_rows):
                left += blob(batch.slice(at, 1).to_pylist()[0])
                cut = len(left) - len(left) % 3  # so that the base64 of a partition is one text
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(left[:cut]).decode()])], names=["value"])
                left = left[cut:]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(left).decode()])], names=["value"])

    return rows.repartitionByRange(1 + size // _COPIED, "ord").sortWithinPartitions("ord").mapInArrow(run, "value string")


class _Archive:
    """A zip file in the making; its entries' bytes come from the driver, if they are few, or from tasks."""

    def __init__(self, path: str) -> None:
        self._path, self._target = path, os.path.abspath(f"{path}.tmp")
        self._at, self._count, self._listed = 0, 0, b""
        with open(self._target, "wb"):
            pass

    def _write(self, *raw: bytes) -> None:
        with open(self._target, "ab") as f:
            for r in raw:
                f.write(r)
                self._at += len(r)

    def add(self, name: str, head: str, pieces: DataFrame | None = None, tail: str = "") -> None:
        """An entry of a text from the driver, with the texts of _pieces() and another text behind it."""
        told = [] if pieces is None else pieces.select("crc", "length", F.length("blob").alias("packed"), "ord").orderBy("ord").collect()  # a row for _BATCH
        ends = [x.encode() for x in (head, tail)]
        first, last = [zipped.deflated(x) for x in ends]
        crc = zipped.joined_crc([(zlib.crc32(ends[0]), len(ends[0])), *((r["crc"], r["length"]) for r in told), (zlib.crc32(ends[1]), len(ends[1]))])
        size = sum(r["packed"] for r in told)
        entry = zipped.Entry(name, crc, len(first) + size + len(last) + len(zipped.LAST), sum(map(len, ends)) + sum(r["length"] for r in told))
        self._listed += entry.listed(self._at)
        self._count += 1
        self._write(entry.header(), first)
        if told:
            _append(_in_order(pieces.select("ord", "blob"), size, lambda r: r["blob"]), self._target, "\n", encoded=True)
            self._at += size
        self._write(last, zipped.LAST)

    def close(self, entries: DataFrame | None = None, name: Callable[[int], str] | None = None) -> None:
        """The directory, before it whole entries (ord, crc, length, blob with the header) with the name of each number."""
        at, size = self._at, 0
        if entries is not None and (seen := entries.agg(F.count("*").alias("n"), F.sum(F.length("blob")).alias("size")).first())["n"]:
            _append(_in_order(entries.select("ord", "blob"), seen["size"], lambda r: r["blob"]), self._target, "\n", encoded=True)
            self._at += seen["size"]
            self._count += seen["n"]
        start = self._at
        self._write(self._listed)
        if entries is not None and seen["n"]:
            told = running_sum(entries.select("ord", "crc", "length", F.length("blob").cast("bigint").alias("size")), ["ord"], "size", "end")

            def listed(r: dict) -> bytes:
                entry = zipped.Entry(name(r["ord"]), r["crc"], 0, r["length"])
                entry = replace(entry, packed=r["size"] - len(entry.header()))
                return entry.listed(at + r["end"] - r["size"])

            _append(_in_order(told, 100 * seen["n"], listed), self._target, "\n", encoded=True)
            self._at = os.path.getsize(self._target)
        self._write(zipped.end(self._count, self._at - start, start))
        os.replace(self._target, self._path)


def _sheets(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Entries of an archive, a sheet for each number in sheet, of rows in order of sheet and place; a task deflates a sheet as its
    rows come, so it holds no more than the bytes of one (which, by the format, has at most 1,048,576 rows)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, crc, length, packer, out = None, 0, 0, 0, None, []

        def put(text: str) -> None:
            nonlocal crc, length
            raw = text.encode()
            crc, length = zlib.crc32(raw, crc), length + len(raw)
            out.append(packer.compress(raw))

        def made() -> pa.RecordBatch:
            put(sheet_tail(fields, n))
            out.append(packer.flush())
            entry = zipped.Entry(sheet_file(now), crc, sum(map(len, out)), length)
            return _piece(now, crc, length, entry.header() + b"".join(out))

        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                for row in batch.slice(at, _BATCH).to_pylist():
                    if row["sheet"] != now:
                        if now is not None:
                            yield made()
                        now, n, crc, length, packer, out = row["sheet"], 0, 0, 0, zlib.compressobj(wbits=-15), []
                        put(sheet_head(fields))
                    n += 1
                    put(sheet_row(n + 1, row, fields))
        if now is not None:
            yield made()

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartition(tasks, "sheet").sortWithinPartitions("sheet", "place").mapInArrow(run, _PIECE), "sheets")


def write_workbook(turns: DataFrame, path: str, split: bool = False) -> None:
    """Flat turns as a workbook for review: one sheet, or one per conversation and one that lists them. No row is sent to the
    driver: tasks render and deflate the rows, and the driver copies their bytes."""
    order = file_order(turns)
    with scratch():
        if not split:
            numbered = with_ordinal(turns.select(*FLAT_COLUMNS, F.struct(*order).alias("place")), ["place"], "n")
            pieces = _pieces(numbered.drop("place"), "n", lambda r: sheet_row(r["n"] + 1, r, FLAT_COLUMNS))
            archive = _archive_of(path, None, SINGLE)
            archive.add(sheet_file(1), sheet_head(FLAT_COLUMNS), pieces, sheet_tail(FLAT_COLUMNS, numbered.count()))
            archive.close()
            return
        rows = materialize(turns.select(*FLAT_COLUMNS, F.struct(*order).alias("place")), "turns")
        meta = ("regione", "macro_regione", "languages")
        heads = rows.groupBy("conversazione").agg(F.min_by(F.struct(*meta), "place").alias("head"), F.count("*").alias("n_turni_italiani"), F.min("place").alias("place"))
        title = F.substring("conversazione", 1, MAX_TITLE).alias("title")
        if not heads.select(title).union(heads.sparkSession.createDataFrame([(CONVERSATIONS,)], "title string")).groupBy("title").count().where("count > 1").isEmpty():
            raise EngineError(f"several conversations share the first {MAX_TITLE} characters of their names, or one has the title of the list")
        heads = with_ordinal(heads.select(F.col("conversazione").alias("id"), "head.*", "n_turni_italiani", title, "place"), ["place"], "n").drop("place")
        archive = _archive_of(path, heads, CONVERSATIONS)
        pieces = _pieces(heads, "n", lambda r: sheet_row(r["n"] + 1, r, META_SHEET))
        archive.add(sheet_file(1), sheet_head(META_SHEET), pieces, sheet_tail(META_SHEET, 0))
        numbers = heads.select(F.col("id").alias("conversazione"), (F.col("n") + 1).alias("sheet"))
        archive.close(_sheets(rows.join(numbers, "conversazione").select(*TURN_SHEET, "sheet", "place"), TURN_SHEET), sheet_file)


def _archive_of(path: str, sheets: DataFrame | None, first: str) -> _Archive:
    """A workbook with the files that list its sheets: the first, and those of a table (title, n from 1)."""
    archive = _Archive(path)
    for name, head, line, tail in LISTS:
        lines = None if sheets is None else _pieces(sheets.select("title", "n"), "n", lambda r, line=line: line(r["n"] + 1, r["title"]))
        archive.add(name, head + line(1, first), lines, tail)
    for name, text in FIXED.items():
        archive.add(name, text)
    return archive
