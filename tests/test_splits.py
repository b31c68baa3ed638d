"""Splittable readers: the same records at every way of cutting a file."""

import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyarrow as pa
from turnengine.operators import build
from turnengine.schema import FLAT_COLUMNS, SAMPLE, EngineError
from turnengine.sources import files, splits


@pytest.fixture
def cut(spark):
    """Sets the size of a split."""

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


TEXTS = ["plain", 'q"uo"te', "multi\nline\n\nend", "", '"', '""\n"', "a,b", "çé日本", "}{][", "\\", '\\"}', "'o"]
ROWS = [[TEXTS[i % 12], TEXTS[(5 * i + 3) % 12], str(i)] for i in range(36)]


def text_of(rows, newline="\r\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=newline).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("newline", ["\r\n", "\n"])
def test_csv_at_every_split(spark, tmp_path, cut, newline):
    path = tmp_path / "a.csv"
    path.write_bytes(("﻿" + text_of([["x", "y", "z"], *ROWS], newline)).encode())
    whole = [tuple(v or "" for v in r) for r in spark.read.csv(str(path), header=True, multiLine=True, escape='"').collect()]
    assert whole == list(map(tuple, ROWS))
    for size in (23, 37, 200):
        cut(size)
        rows = files.read_csv(spark, str(path))
        assert [tuple(v or "" for v in r)[:3] for r in rows.orderBy("ord").collect()] == whole
        if size == 23:
            assert splits._pieces(spark, str(path), splits.CsvPieces()).rdd.getNumPartitions() > 8


def samples(n):
    turn = lambda i, k: {"turn_index": k + 1, "tu_id": str(k), "speaker": TEXTS[i % 12], "italiano": TEXTS[(i + k) % 12], "napoletano": TEXTS[(i * k) % 12]}
    return [{"id": f"c{i:03}", "regione": "r", "macro_regione": "m", "languages": "l", "n_turni_italiani": i % 4, "turni": [turn(i, k) for k in range(i % 4)]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("n", [0, 1, 14])
def test_json_at_every_split(spark, tmp_path, cut, n, indent):
    path = tmp_path / "a.json"
    given_ = samples(n + 1)[1:]  # some have no turns
    path.write_text(json.dumps(given_ if n != 1 else given_[0], indent=indent, ensure_ascii=False) + ("\n" if indent else ""))
    whole = spark.read.schema(SAMPLE).json(str(path), multiLine=True).collect() if n else []
    for size in (83, 200) if n == 14 else (40,):
        cut(size)
        rows = files.read_samples(spark, str(path), lines=False)
        assert [tuple(r)[:-1] for r in rows.orderBy("ord").collect()] == list(map(tuple, whole))
    assert n != 14 or len(whole) == 14


def test_several_files_and_records_over_many_splits(spark, tmp_path, cut):
    for i in range(3):
        given_ = samples(6)
        given_[3 + i]["turni"][0:0] = [{"turn_index": 1, "italiano": "long } text \" of many splits\n" * 40}]
        (tmp_path / f"{i}.json").write_text(json.dumps([x | {"id": f"{i}-{x['id']}"} for x in given_], indent=1))
        (tmp_path / f"{i}.csv").write_text(text_of([["x", "y"], *([f"{i}", x["turni"][0]["italiano"] if x["turni"] else ""] for x in given_)], "\n"))
    cut(250)
    made = [json.loads((tmp_path / f"{i}.json").read_text()) for i in range(3)]
    rows = files.read_samples(spark, str(tmp_path / "*.json"), lines=False).orderBy("ord").collect()
    assert [(r.id, [t.italiano for t in r.turni]) for r in rows] == [(x["id"], [t["italiano"] for t in x["turni"]]) for m in made for x in m]
    flat = files.read_csv(spark, str(tmp_path / "*.csv")).orderBy("ord").collect()  # no header among the rows
    assert [(r.x, r.y or "") for r in flat] == [(str(i), x["turni"][0]["italiano"] if x["turni"] else "") for i in range(3) for x in made[i]]


def test_fragments_are_not_parsed_by_a_filter_on_what_they_hold(spark, tmp_path, cut):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(samples(14), indent=1))
    cut(200)
    rows = build.flatten(files.read_samples(spark, str(path), lines=False))  # Spark parses for its filter before it drops fragments
    assert sorted((r.conversazione, r.italiano) for r in rows.collect()) == sorted((x["id"], t["italiano"]) for x in samples(14) for t in x["turni"])


def test_bad_files(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"id": "a"}, {"id": "b"')
    (tmp_path / "open.json").write_text('[{"id": "a"}, {"id": "b}')
    (tmp_path / "numbers.json").write_text("[1, 2]")
    (tmp_path / "mixed.json").write_text('[{"id": "a"}, 7, {"id": "b"}]')
    for name in ("cut", "open"):
        with pytest.raises(EngineError, match="cut off"):
            files.read_samples(spark, str(tmp_path / f"{name}.json"), lines=False).collect()
    for name in ("numbers", "mixed"):
        with pytest.raises(Exception, match="list of objects"):
            files.read_samples(spark, str(tmp_path / f"{name}.json"), lines=False).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a",\n\r é', max_size=6), min_size=2, max_size=2), min_size=1, max_size=6))
def test_lines_of_csv_are_told_apart(rows):
    lines = text_of(rows, "\n").removesuffix("\n").split("\n")
    state, _ = splits.CsvPieces().scan(pa.array(lines)).follow(0, 0)
    records, held = [], []
    for line, s in zip(lines, state, strict=True):
        held.append(line)
        if s == 0:
            records.append("\n".join(held))
            held = []
    assert not held and [next(csv.reader(io.StringIO(r + "\n", newline=""))) for r in records] == rows


def test_large_file_is_read_by_many_tasks(spark, tmp_path, cut):
    path = tmp_path / "big.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(FLAT_COLUMNS)
        out.writerows([f"c{i // 100}", "r", "m", "l", i % 100, i, "A", f'one, "two"\nthree {i}', "", "n"] for i in range(60_000))
    cut(1 << 19)
    rows = files.read_csv(spark, str(path))
    told = rows.select("tu_id", (F.col("italiano") == F.concat(F.lit('one, "two"\nthree '), "tu_id")).alias("right"), "ord", F.spark_partition_id().alias("task"))
    found = told.agg(F.count("*").alias("n"), F.count_if("right").alias("right"), F.count_distinct("tu_id").alias("ids"), F.count_distinct("task").alias("tasks")).first()
    assert tuple(found)[:3] == (60_000,) * 3 and found.tasks > 4
