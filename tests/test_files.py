"""Readers, writers, workbook and command line, through real files."""

import csv
import io
import json
import threading
import zipfile
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnengine import cli
from turnengine.operators import bertscore, build, metrics, translate
from turnengine.schema import EngineError
from turnengine.sinks import files as sinks
from turnengine.sinks import zipped
from turnengine.sinks.buckets import BucketStore
from turnengine.sources import files, workbook
from turnengine.sources.chat import ChatBackend
from turnengine.streaming.translate import translate_stream


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata/conversations.tsv").write_text("﻿code\tcollection-region\tmacro-region\tlanguages\nK1\told\told\told\nK1\tCampania\tSud\titalian\n", encoding="utf-8")
    (tmp_path / "tsv").mkdir()
    row = lambda *c: "\t".join(["0", c[0], c[1], "x", *c[2:]])
    lines = ["header", row("A", "1", "ciao", "linguistic", "none", "_"), "short\tline", row("B", "2", "l'", "linguistic", "none", "SpaceAfter=No"), row("B", "2", "amico", "linguistic", "none", "")]
    (tmp_path / "tsv/K1.a.vert.tsv").write_text("\n".join(lines[:2]) + "\n", encoding="utf-8")
    (tmp_path / "tsv/K1.b.vert.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return tmp_path


def test_build_command_and_readers(spark, corpus):
    cli.main(["build", "--corpus", str(corpus), "--conversation", "K1", "--out", str(corpus / "out")])
    sample = json.loads((corpus / "out.json").read_text(encoding="utf-8"))
    assert [t["italiano"] for t in sample["turni"]] == ["ciao", "l'amico"] and sample["regione"] == "Campania" and sample["n_turni_italiani"] == 2
    assert (corpus / "out.csv").read_bytes().startswith(b"\xef\xbb\xbfconversazione,")
    with pytest.raises(SystemExit):
        cli.main(["build", "--corpus", str(corpus), "--conversation", "K9", "--out", str(corpus / "x")])
    with pytest.raises(EngineError):
        files.find_metadata(spark, str(corpus / "tsv"))


def test_sample_formats(spark, tmp_path):
    one = {"id": "a", "regione": "r", "turni": [{"turn_index": 1, "italiano": "x, \"q\"\ny", "napoletano": None}]}
    for name, text, n in (("o", json.dumps(one, indent=1), 1), ("a1", json.dumps([one]), 1), ("a2", json.dumps([one, one]), 2), ("l", json.dumps(one) + "\n\n" + json.dumps(one) + "\n", 2), ("s", json.dumps(one), 1)):
        (tmp_path / name).write_text(text)
        rows = build.flatten(files.read_samples(spark, str(tmp_path / name)))
        assert rows.count() == n, name
        assert rows.first()["italiano"] == one["turni"][0]["italiano"] and rows.first()["napoletano"] == ""


TURNS = "conversazione string, regione string, macro_regione string, languages string, turn_index int, tu_id string, speaker string, italiano string, napoletano string, note string"


@pytest.mark.parametrize("split", [False, True])
def test_workbook_round_trip(spark, tmp_path, split):
    rows = [("a", "r", "m", "l", 1, "1", "A", 'x "y", z', "'o", "n"), ("a", "r", "m", "l", 2, "2", "B", "è\nu", "nap", ""), ("b", "", "", "", 1, "7", "A", "<&>", "k", "")]
    turns = spark.createDataFrame(rows, TURNS)
    sinks.write_workbook(turns, str(tmp_path / "w.xlsx"), split)
    back = workbook.read_workbook(spark, str(tmp_path / "w.xlsx")).orderBy("pos").drop("pos").collect()
    assert [tuple(r) for r in back] == [tuple(str(c) for c in r) for r in rows]
    sinks.write_samples(build.nest(turns), str(tmp_path / "w.json"))
    cli.main(["verify", "--xlsx", str(tmp_path / "w.xlsx"), "--json", str(tmp_path / "w.json")])
    cli.main(["import", "--xlsx", str(tmp_path / "w.xlsx"), "--csv", str(tmp_path / "i.csv"), "--json", str(tmp_path / "i.json"), "--source", str(tmp_path / "w.json")])
    other = turns.withColumn("napoletano", F.lit("changed"))
    sinks.write_samples(build.nest(other), str(tmp_path / "o.json"))
    with pytest.raises(SystemExit):
        cli.main(["verify", "--xlsx", str(tmp_path / "w.xlsx"), "--json", str(tmp_path / "o.json")])


def test_missing_column_and_layout():
    with pytest.raises(EngineError):
        workbook.flat_rows(workbook.render({"Golden": (["turn_index"], [])}))
    with pytest.raises(EngineError):
        workbook.flat_rows(workbook.render({"other": (["x"], [])}))
    assert workbook.as_text(3.0) == "3" and workbook.as_text(None) == "" and workbook.as_text(" x ") == "x"


def test_score_merge_fix_commands(spark, tmp_path):
    turn = lambda i, it, nap: {"turn_index": i, "tu_id": str(i), "speaker": "A", "italiano": it, "napoletano": nap}
    write = lambda name, *turns: (tmp_path / name).write_text(json.dumps([{"id": "a", "regione": "r", "macro_regione": "m", "languages": "l", "n_turni_italiani": len(turns), "turni": list(turns)}]))
    write("draft.json", turn(1, "uno", "why not"), turn(2, "due", 'stessa "frase", qui'), turn(4, "x", "y"))
    write("golden.json", turn(1, "uno", "pecché no"), turn(2, "due", 'stessa "frase", qui'))
    write("structure.json", turn(1, "uno", ""), turn(2, "due!", ""), turn(3, "tre", ""))
    whole = json.loads((tmp_path / "structure.json").read_text())
    (tmp_path / "structure.json").write_text(json.dumps([whole[0] | {"id": "z"}, *whole, {"id": "b", "n_turni_italiani": 0, "turni": []}]))
    p = lambda n: str(tmp_path / n)
    cli.main(["score", "--draft", p("draft.json"), "--golden", p("golden.json"), "--out", p("report.txt"), "--csv", p("scores.csv")])
    report = (tmp_path / "report.txt").read_text()
    assert "pairs: 2" in report and "  - draft only a 4" in report and "warnings: 1" in report and "corpus chrF: " in report and "tu_id 1 | speaker A" in report and "to replace: 1/2 (50.0%)" in report and "REPLACE" in report
    assert "BERTScore n/d" in report and "weights: chrf 57%, bleu 21%, rouge 21%" in report
    with pytest.raises(SystemExit, match="BERTScore needs"):
        cli.main(["score", "--draft", p("draft.json"), "--golden", p("golden.json"), "--out", p("r"), "--csv", p("c"), "--bertscore"])
    decided = {r.turn_index: r for r in files.read_decisions(spark, p("scores.csv")).collect()}
    assert decided[1].sostituire and not decided[2].sostituire and decided[2].gemma == 'stessa "frase", qui'
    cli.main(["merge", "--decisions", p("scores.csv"), "--structure", p("structure.json"), "--out", p("final")])
    final = json.loads((tmp_path / "final.json").read_text())
    assert [(s["id"], s["n_turni_italiani"]) for s in final] == [("z", 0), ("a", 2), ("b", 0)]  # the file's order, and those that lost all turns
    final = final[1]
    assert [(t["turn_index"], t["napoletano"], t["fonte"]) for t in final["turni"]] == [(1, "pecché no", "golden"), (2, 'stessa "frase", qui', "gemma4")]
    (tmp_path / "fix.csv").write_text("conversazione,turn_index,ord,old,new\na,1,1,why,pecché\n")
    cli.main(["fix", "--json", p("draft.json"), "--corrections", p("fix.csv"), "--apply"])
    assert json.loads((tmp_path / "draft.json").read_text())["turni"][0]["napoletano"] == "pecché not"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(EngineError):
        files.read_decisions(spark, p("bad.csv"))


def test_a_score_run_scores_every_pair_once(spark, tmp_path, monkeypatch):
    turn = lambda i, nap: {"turn_index": i, "tu_id": str(i), "speaker": "A", "italiano": f"t{i}", "napoletano": nap}
    for name, shift in (("draft", 0), ("golden", 3)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"id": f"c{c}", "turni": [turn(i + shift, f"some words {i + shift}") for i in range(20)]} for c in range(5)]))
    scored = spark.sparkContext.accumulator(0)
    sides, overlaps = metrics._characters, metrics._overlaps

    @F.pandas_udf("array<long>")
    def counting(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        scored.add(len(hyp))
        return pd.Series(list(overlaps(*[sides(["".join(t.split()) for t in side]) for side in (hyp, ref)], 6)))

    monkeypatch.setattr(metrics, "char_counts", counting)
    paths = {k: str(tmp_path / k) for k in ("draft.json", "golden.json", "report.txt", "scores.csv")}
    cli.main(["score", "--draft", paths["draft.json"], "--golden", paths["golden.json"], "--out", paths["report.txt"], "--csv", paths["scores.csv"]])
    assert scored.value == 85  # of 85 pairs, with report, summary, corpus scores and table
    report = (tmp_path / "report.txt").read_text()
    assert "pairs: 85" in report and "warnings: 30" in report and "identical: 85" in report and "corpus chrF: 100.00" in report


def test_key(tmp_path, monkeypatch):
    path = tmp_path / "key"
    monkeypatch.setenv("K", "env")
    assert files.load_key(str(path), "K") == "env"
    for text in ('{"api_key": "v"}', "# x\nK = 'v'", "v\n"):
        path.write_text(text)
        assert files.load_key(str(path), "K") == "v"
    monkeypatch.delenv("K")
    with pytest.raises(EngineError):
        files.load_key(str(tmp_path / "none"), "K")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sample = {"id": "a", "turni": [{"turn_index": 1, "italiano": "x"}, {"turn_index": 2, "italiano": "y"}]}
    for n in (1, 2):
        (tmp_path / f"in/{n}.json").write_text(json.dumps(sample | {"id": f"c{n}"}) + "\n")
        translate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda m: "T").awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.conversazione, r.turn_index, r.napoletano) for r in rows) == [("c1", 1, "T"), ("c1", 2, "T"), ("c2", 1, "T"), ("c2", 2, "T")]


def sample(name, *texts):
    return {"id": name, "turni": [{"turn_index": i, "tu_id": str(i), "speaker": "A", "italiano": t, "napoletano": ""} for i, t in enumerate(texts, 1)]}


@pytest.fixture
def chat_server():
    """A chat endpoint: it refuses texts with "refuse", and answers with the last line of the prompt in upper case."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.headers.get("Authorization"), body))
            text = body["messages"][-1]["content"].split("\n")[-1]
            self.send_response(500 if "refuse" in text else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": f"  {text.upper()} "}}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/chat", asked
    server.shutdown()


def test_translate_command(spark, tmp_path, chat_server, monkeypatch):
    url, asked = chat_server
    (tmp_path / "in.json").write_text(json.dumps([sample("z", "uno", "due"), sample("b", "tre", "quattro")]))
    (tmp_path / "prompt").write_text("system")
    monkeypatch.setenv("CHAT_API_KEY", "k")
    command = ["translate", "--input", str(tmp_path / "in.json"), "--output", str(tmp_path / "out.json"), "--key-file", str(tmp_path / "no"), "--url", url, "--model", "m", "--prompt-file", str(tmp_path / "prompt"), "--save-every", "2"]
    cli.main([*command, "--limit", "3"])
    read = lambda: [(s["id"], [t["napoletano"] for t in s["turni"]]) for s in json.loads((tmp_path / "out.json").read_text())]
    assert read() == [("z", ["UNO", ""]), ("b", ["TRE", "QUATTRO"])]  # by name and turn, in the file's order
    assert (tmp_path / "out.csv").exists() and asked[0][0] == "Bearer k" and asked[0][1]["messages"][0] == {"role": "system", "content": "system"}
    cli.main(command)  # takes the output up where it was
    assert read()[0] == ("z", ["UNO", "DUE"]) and len(asked) == 4


def test_chat_backend_raises_on_errors(chat_server):
    with pytest.raises(OSError):
        ChatBackend(chat_server[0], "m")([{"role": "user", "content": "refuse"}])


def test_limit_counts_successes_and_saves_survive_an_interrupt(spark, tmp_path):
    turns = spark.createDataFrame([("a", i, i, f"t{i}", "") for i in range(6)], "conversazione string, turn_index int, turn_ord int, italiano string, napoletano string")
    saved = []

    def backend(messages):
        text = messages[1]["content"].split("\n")[-1]
        if text in ("t0", "t2"):
            raise OSError("no")
        return text.upper()

    store = BucketStore(spark, str(tmp_path / "state"), buckets=4)
    read = lambda: [r.napoletano for r in store.read().orderBy("conversazione", "turn_ord").collect()]
    assert translate.translate_in_waves(turns, store, 2, limit=3, saved=lambda n: saved.append(read()), backend=backend) == 3
    assert read() == ["", "T1", "", "T3", "T4", ""] and len(saved) == 3

    def stop(n):
        saved.append(read())
        if len(saved) == 5:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        translate.translate_in_waves(turns, store, 2, saved=stop, backend=backend)
    assert saved[-1] == read() == ["", "T1", "", "T3", "", ""]


def test_bertscore_through_a_stand_in(spark, tmp_path, monkeypatch):
    """The model's path with stand-in libraries: F1 of 0.5 for every pair of texts that are not empty."""
    (tmp_path / "torch.py").write_text("class cuda:\n    is_available = staticmethod(lambda: False)\n")
    (tmp_path / "bert_score.py").write_text(
        "import numpy as np\n\n\nclass F1(np.ndarray):\n    def numpy(self):\n        return np.asarray(self)\n\n\n"
        "class BERTScorer:\n    def __init__(self, model_type, batch_size, device):\n        assert (model_type, batch_size, device) == ('m', 2, 'cpu')\n\n"
        "    def score(self, a, b):\n        return None, None, np.full(len(a), 0.5).view(F1)\n"
    )
    for name in ("torch.py", "bert_score.py"):
        spark.sparkContext.addPyFile(str(tmp_path / name))
    pairs = spark.createDataFrame([("a", 1, "x", "x", ""), ("a", 2, "", "y", "")], "conversazione string, turn_index int, gemma string, golden string, note string")
    scored = bertscore.add_bertscore(pairs, "m", 2)
    rows = metrics.decisions(scored, bertscore=F.col("bertscore")).orderBy("turn_index").select("bertscore", "similarita", bertscore.bert_text(F.col("bertscore"), True).alias("shown")).collect()
    assert [tuple(r) for r in rows] == [(50.0, pytest.approx(0.4 * 100 + 0.3 * 50 + 0.15 * 100 + 0.15 * 100), "0.5000"), (0.0, 0.0, "0.0000")]


def test_workbook_layout(spark, tmp_path):
    name = "a" * 40
    turns = spark.createDataFrame([(name, "r", "m", "l", 1, "1", "A", "x", "y", "n")], TURNS)
    sinks.write_workbook(turns, str(tmp_path / "w.xlsx"), split=True)
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet2.xml").decode()
        assert name[:31] in z.read("xl/workbook.xml").decode() and name not in z.read("xl/workbook.xml").decode()
    for part in ('state="frozen"', "<autoFilter", 'type="textLength"', 'width="60"', 'autoFilter="0" sort="0"'):
        assert part in sheet
    assert workbook.read_workbook(spark, str(tmp_path / "w.xlsx")).first()["conversazione"] == name
    with pytest.raises(EngineError):
        sinks.write_workbook(turns.union(turns.withColumn("conversazione", F.lit(name + "b"))), str(tmp_path / "w.xlsx"), split=True)


def test_requested_order_is_kept(spark, corpus):
    for code in ("K0", "K5"):
        (corpus / f"tsv/{code}.vert.tsv").write_text((corpus / "tsv/K1.b.vert.tsv").read_text(encoding="utf-8"), encoding="utf-8")
    cli.main(["build", "--corpus", str(corpus), "--conversations", "K5", "K1", "K0", "--out", str(corpus / "out")])
    assert [s["id"] for s in json.loads((corpus / "out.json").read_text(encoding="utf-8"))] == ["K5", "K1", "K0"]


def test_exports_send_no_rows_to_the_driver(spark, tmp_path, monkeypatch):
    """One file each, whatever the number of partitions: none, one and many rows; only tasks see them."""
    from pyspark.sql import DataFrame

    for name in ("toLocalIterator", "collect", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: pytest.fail("rows were sent to the driver"))
    rows = spark.range(3000, numPartitions=5).selectExpr("cast(id as string) as id", "id as conv_ord", "'a\n  {\nb' as regione", "array(named_struct('turn_index', 1, 'italiano', 'x \"}')) as turni")
    for n in (0, 1, 3000):
        sinks.write_samples(rows.where(f"conv_ord < {n}"), str(tmp_path / "a.json"))
        found = json.loads((tmp_path / "a.json").read_text())
        assert ([found["id"]] if n == 1 else [x["id"] for x in found]) == [str(i) for i in range(n)]
        sinks.write_csv(rows.where(f"conv_ord < {n}"), str(tmp_path / "a.csv"), ["id", "regione"], ["conv_ord"])
        with open(tmp_path / "a.csv", encoding="utf-8-sig", newline="") as f:
            assert list(csv.reader(f)) == [["id", "regione"], *([str(i), "a\n  {\nb"] for i in range(n))]


@pytest.mark.parametrize("split", [False, True])
def test_workbooks_send_no_rows_to_the_driver(spark, tmp_path, monkeypatch, split):
    """More rows than a piece has and more sheets than a part has, in partitions of another order than the workbook's."""
    from pyspark.sql import DataFrame

    turns = spark.range(2500, -1, -1, numPartitions=5).selectExpr(
        "cast(id % 300 as string) as conversazione", "'r' as regione", "'m' as macro_regione", "'l' as languages", "cast(id div 300 + 1 as int) as turn_index",
        "cast(id as string) as tu_id", "'A' as speaker", "concat('<&> è ', id) as italiano", "concat(\"'\", id) as napoletano", "'' as note", "300 - id % 300 as conv_ord", "id div 300 as turn_ord",
    )
    want = [{c: r[c] for c in workbook.FLAT_COLUMNS} for r in turns.orderBy("conv_ord", "turn_ord").collect()]
    collect, most = DataFrame.collect, [0]

    def counted(df):
        rows = collect(df)
        most[0] = max(most[0], len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    for name in ("toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: pytest.fail("rows were sent to the driver"))
    sinks.write_workbook(turns, str(tmp_path / "w.xlsx"), split)
    back = workbook.read_workbook(spark, str(tmp_path / "w.xlsx"))
    assert most[0] < 50
    monkeypatch.undo()
    assert [r.asDict() for r in back.orderBy("pos").collect()] == [{k: str(v) for k, v in r.items()} | {"pos": i} for i, r in enumerate(want)]
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert z.testzip() is None
        if not split:  # what a small workbook made in memory holds
            with zipfile.ZipFile(io.BytesIO(workbook.render({"Golden": (workbook.FLAT_COLUMNS, want)}))) as small:
                assert {n: z.read(n) for n in z.namelist()} == {n: small.read(n) for n in small.namelist()}
        else:
            assert z.read("xl/worksheets/sheet2.xml").count(b"<row ") == 9 and b'name="299"' in z.read("xl/workbook.xml")


def test_archives_of_pieces_and_of_many_entries():
    texts = [b"a" * 100_000, b"", "è".encode() * 7]
    assert zipped.joined_crc([(zlib.crc32(t), len(t)) for t in texts]) == zlib.crc32(b"".join(texts))
    blob = b"".join(map(zipped.deflated, texts)) + zipped.LAST
    assert zlib.decompress(blob, -15) == b"".join(texts)
    entries = [zipped.Entry(f"{i}", zlib.crc32(b"x"), len(zipped.deflated(b"x")) + 2, 1) for i in range(70_000)]  # more than the plain format counts
    body, listed = bytearray(), bytearray()
    for e in entries:
        listed += e.listed(len(body))
        body += e.header() + zipped.deflated(b"x") + zipped.LAST
    raw = bytes(body + listed) + zipped.end(len(entries), len(listed), len(body))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert len(z.namelist()) == 70_000 and z.read("69999") == b"x"
    wide = zipped.Entry("w", 1, 5 << 30, 6 << 30)  # sizes and places over 4 GB
    with zipfile.ZipFile(io.BytesIO(wide.listed(7 << 30) + zipped.end(1, len(wide.listed(7 << 30)), 0))) as z:
        assert (z.infolist()[0].compress_size, z.infolist()[0].file_size, z.infolist()[0].header_offset) == (5 << 30, 6 << 30, 7 << 30)


def test_rows_of_a_sheet_are_read_as_they_are_asked_for():
    """The first row comes before most of a large sheet is read, and damage shows at the end."""
    rows = [{"turn_index": i, "tu_id": f"{i * 2_654_435_761 % 1_000_003}"} for i in range(20_000)]
    raw = workbook.render({"Golden": (workbook.FLAT_COLUMNS, rows)})

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    f = Counted(raw)
    places = workbook.Places(f)
    ((title, place, meta),) = workbook.turn_sheets(f, places, list)
    f.taken = 0
    found = workbook.turn_rows(f, place, title, meta, list)
    assert next(found)["turn_index"] == "0" and f.taken < place.size / 3
    assert sum(1 for _ in found) == 19_999
    with pytest.raises(EngineError, match="damaged"):
        list(workbook.turn_rows(f, place._replace(crc=place.crc ^ 1), title, meta, list))


def test_workbooks_of_other_programs_and_stores(spark, tmp_path):
    """Shared texts, stored files, cells without a name, blank rows, and a store that only Spark reads."""
    texts = [*workbook.FLAT_COLUMNS, "a", "ciao"]
    cell = lambda i: f'<c t="s"><v>{i}</v></c>'
    sheet = f'<row>{"".join(map(cell, range(10)))}</row><row/><row r="3">{cell(10)}<c r="E3"><v>1</v></c><c r="H3" t="s"><v>11</v></c></row>'
    spaces = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w", zipfile.ZIP_STORED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {spaces}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {spaces}>{''.join(f'<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>' for t in texts)}</sst>")
        for name, head, line, tail in workbook.LISTS:
            z.writestr(name, head + line(1, "Golden") + tail)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./w", tmp_path.as_uri())
    want = ("a", "", "", "", "1", "", "", "ciao", "", "", 0)
    for path in (str(tmp_path / "w.xlsx"), "viewfs://store/w/w.xlsx"):
        assert [tuple(r) for r in workbook.read_workbook(spark, path).collect()] == [want]


def test_a_workbook_is_parsed_once_for_an_import(spark, tmp_path, monkeypatch):
    turns = spark.createDataFrame([("a", "r", "m", "l", i, f"{i}", "A", f"t{i}", "x", "") for i in range(1, 6)], TURNS)
    sinks.write_workbook(turns, str(tmp_path / "w.xlsx"))
    read = workbook.read_workbook

    def gone(*args):
        rows = read(*args)
        (tmp_path / "w.xlsx").unlink()
        return rows

    monkeypatch.setattr(workbook, "read_workbook", gone)
    cli.main(["import", "--xlsx", str(tmp_path / "w.xlsx"), "--csv", str(tmp_path / "i.csv"), "--json", str(tmp_path / "i.json")])
    assert [t["turn_index"] for t in json.loads((tmp_path / "i.json").read_text())["turni"]] == [1, 2, 3, 4, 5]
