"""Transcripts, metadata, nested samples and decision tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnengine.functions.text import null_to_empty, strip_ws, to_bool
from turnengine.operators.align import dedupe_last
from turnengine.schema import DECISION_REQUIRED, META_HEADERS, SAMPLE, SCORE_COLUMNS, EngineError
from turnengine.sources import splits


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may hold wildcards, names anything; on any file system Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def find_metadata(spark: SparkSession, folder: str) -> str:
    for path in (f"{folder}/metadata/conversations.tsv", f"{folder}/conversations.tsv"):
        if exists(spark, path):
            return path
    raise EngineError(f"no conversations.tsv under {folder}")


def find_transcripts(spark: SparkSession, folder: str) -> str:
    """The pattern of the token files: in the folder tsv if there are any, else in the folder itself."""
    for path in (f"{folder}/tsv/*.vert.tsv", f"{folder}/*.vert.tsv"):
        if exists(spark, path):
            return path
    raise EngineError(f"no token files under {folder}")


def read_tokens(spark: SparkSession, pattern: str) -> DataFrame:
    """Token rows of transcript files. A file is one conversation, so it is read whole and its lines numbered.

    The first line is dropped, and so are lines of fewer than eight fields. The code is the file name up to its
    first dot; of several files with one code the last path wins.
    """
    files = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.split("_metadata.file_name", r"\.")[0].alias("conversazione"))
    last = files.groupBy("conversazione").agg(F.max("path").alias("path"))
    lines = files.join(last, ["conversazione", "path"], "left_semi").select("conversazione", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "line")).where("pos > 0")
    c = F.split("line", "\t")
    fields = {"speaker": 1, "tu": 2, "form": 4, "type": 5, "variation": 6, "feats": 7}
    return lines.where(F.size(c) > 7).select("conversazione", F.col("pos").cast("long").alias("pos"), *[c[i].alias(n) for n, i in fields.items()])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """code, regione, macro_regione, languages; columns by header name, the last row of a code wins."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    named = {c.lstrip("﻿"): c for c in raw.columns}
    if lost := [h for h in META_HEADERS if h not in named]:
        raise EngineError(f"{path} lacks the columns {lost}")
    rows = raw.select(*[null_to_empty(F.col(f"`{named[h]}`")).alias(n) for h, n in META_HEADERS.items()]).withColumn("ord", F.monotonically_increasing_id())
    return dedupe_last(rows, ["code"], "ord").drop("ord")


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is a JSON object by itself."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    try:
        return bool(first) and isinstance(json.loads(first[0]["value"].lstrip("﻿")), dict)
    except ValueError:
        return False


def read_samples(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Nested conversations of a JSON object, an array of objects, or JSON lines, with ord, which rises in file order. Files of
    every layout are read by as many tasks as they have splits."""
    if is_json_lines(spark, path) if lines is None else lines:
        return spark.read.schema(SAMPLE).json(path, mode="FAILFAST").withColumn("ord", F.monotonically_increasing_id())
    rows = splits.read_records(spark, path, splits.JsonPieces())
    return rows.select(F.from_json("record", SAMPLE, {"mode": "FAILFAST"}).alias("sample"), "ord").select("sample.*", "ord")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with a header, all text, with ord, which rises in file order; fields may hold line breaks, which
    stay as they are. Columns are those of the first header; every file is read by as many tasks as it has splits."""
    columns = [c.lstrip("\ufeff") for c in spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, encoding="UTF-8").columns]
    if not columns:
        raise EngineError(f"{path} is empty")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    rows = splits.read_records(spark, path, splits.CsvPieces(), skip_first=True)
    return rows.select(F.from_csv("record", schema, {"escape": '"', "multiLine": "true"}).alias("row"), "ord").select("row.*", "ord")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decision rows of a score CSV, with ord; similarita and sostituire typed, text without edge white space."""
    raw = read_csv(spark, path)
    columns = raw.columns
    if lost := sorted(set(DECISION_REQUIRED) - set(columns)):
        raise EngineError(f"{path} lacks the columns {lost}")
    texts = [null_to_empty(F.col(c)).alias(c) if c in columns else F.lit("").alias(c) for c in SCORE_COLUMNS if c not in ("turn_index", "similarita", "sostituire")]
    return raw.select(*texts, strip_ws(F.col("turn_index")).try_cast(T.IntegerType()).alias("turn_index"), strip_ws(F.col("similarita")).try_cast(T.DoubleType()).alias("similarita"), to_bool(F.col("sostituire")).alias("sostituire"), "ord")


def load_key(path: str, variable: str) -> str:
    """An API key: of a file (JSON, KEY=VALUE lines or the bare key), or of the environment if there is no file."""
    if not os.path.exists(path):
        if key := os.environ.get(variable, "").strip():
            return key
        raise EngineError(f"neither {path} nor {variable} has a key")
    with open(path, encoding="utf-8-sig") as f:
        text = f.read().strip()
    try:
        found = json.loads(text)
        if isinstance(found, dict):
            return str(found.get("api_key") or found.get(variable) or next(iter(found.values()))).strip()
    except (ValueError, StopIteration):
        pass
    for line in text.splitlines():
        name, eq, value = line.partition("=")
        if eq and name.strip() in (variable, "api_key", "API_KEY"):
            return value.strip().strip("\"'")
    return text
