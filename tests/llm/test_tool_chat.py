"""Tool-call linking against a plain implementation."""

from pathlib import Path
import json
import random

import pytest

from turnengine.llm import tool_chat as C
from turnengine.llm.common import drop_materialized as drop_table
from turnengine.llm.common import materialize as plain

DATA = Path("/root/testdata")

SCHEMA = "conv_id long, turn long, role string, content string, calls array<struct<call_id:string,name:string,arguments:string,depends_on:array<string>>>, result_of string, level string, status string"


def link(spark, rows, schemas=C.DEMO_SCHEMAS):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return C.link_tool_calls(df, schemas).collect()


def call(i, name="search", arguments='{"query": "q"}', deps=()):
    return (i, name, arguments, None if deps is None else list(deps))


def test_order_and_status(spark):
    rows = [
        (1, 0, "user", "hi", None, None),
        (1, 1, "tool", "early", None, "a"),  # a result before its call
        (1, 2, "assistant", None, [call("a"), call("b", deps=["a", "a"]), call("b"), call(None, deps=None)], None),
        (1, 3, "tool", "rb", None, "b"),
        (1, 4, "tool", "rb again", None, "b"),
        (1, 5, "tool", "?", None, "nobody"),
        (1, 6, "assistant", "", [call("c", deps=["b", "zz"]), call("x", deps=["y"]), call("y", deps=["x"]), call("w", deps=["x"])], None),
        (2, 0, "assistant", "", [call("a")], None),
        (None, 0, "tool", "t", None, "a"),
    ]
    out = link(spark, rows)
    nodes = {(r.conv_id, r.node, r.call_id, r.turn, r.place): r for r in out}
    status = lambda *k: nodes[k].status
    assert status(1, "call", "a", 2, 0) == "linked" and status(1, "call", "b", 2, 1) == "linked" and status(1, "call", "b", 2, 2) == "repeated" and status(1, "call", None, 2, 3) == "no_id"
    assert status(1, "result", "b", 3, -1) == "linked" and status(1, "result", "b", 4, -1) == "repeated" and status(1, "result", "nobody", 5, -1) == "no_call"
    assert status(1, "call", "c", 6, 0) == "lost_dependency" and {status(1, "call", k, 6, p) for k, p in (("x", 1), ("y", 2), ("w", 3))} == {"cycle"}
    assert status(2, "call", "a", 0, 0) == "no_result" and status(None, "result", "a", 0, -1) == "no_call"
    place = {k: (r.topo_turn, r.topo_level, r.turn, r.place) for k, r in nodes.items() if k[0] == 1}
    before = [((1, "call", "a", 2, 0), (1, "result", "a", 1, -1)), ((1, "result", "a", 1, -1), (1, "call", "b", 2, 1)), ((1, "call", "b", 2, 1), (1, "result", "b", 3, -1)), ((1, "result", "b", 3, -1), (1, "call", "c", 6, 0))]
    assert all(place[a] < place[b] for a, b in before)
    assert len(out) == 3 + 9 + 1 + 5  # 2 assistant, 1 user and conversation 2's message; 9 calls; results


def test_arguments_and_canonical_json(spark):
    tool = {"t": {"i": ("integer", True), "n": ("number", False), "s": ("string", False), "b": ("boolean", False), "a": ("array", False), "o": ("object", False)}}
    cases = [
        ('{"i": 1}', ""), ('{ "o": {"z": 1, "y": [2, null]}, "i": 3, "a": [] }', ""), ('{"n": 1.5, "s": "é\\n\\"", "b": true, "i": 0}', ""), ("{}", "missing:i"), ('{"i": "1"}', "type:i"), ('{"i": 1, "q": 1, "p": 2}', "unknown:p,unknown:q"),
        ('{"i": 1.5, "n": "x", "s": 1, "b": 0, "a": {}, "o": []}', "type:a,type:b,type:i,type:n,type:o,type:s"), ("[1]", "not_an_object"), ('{"i": ', "not_an_object"), (None, "not_an_object"), ("", "not_an_object"), ('{"i": null}', "type:i"),
        ('{"i": 1} tail', "not_an_object"), ('{"i": 1}}', "not_an_object"), ('{"i": 1},{"i": 2}', "not_an_object"), ('{"i": 1}],[{}', "not_an_object"), ('{"i": 1, "i": 2}', "duplicate_key"), ('{"i": 1, "o": {"z": 1, "z": 2}}', "not_an_object"), (' {"i": 1}\n', ""),
    ]
    rows = link(spark, [(1, 0, "assistant", "", [call(str(k), "t", text) for k, (text, _) in enumerate(cases)] + [call("u", "unknown")], None)], tool)
    calls = {r.call_id: r for r in rows if r.node == "call"}
    for k, (text, errors) in enumerate(cases):
        r = calls[str(k)]
        assert r.arg_errors == errors and r.args_valid == (errors == ""), text
        parsed = json.loads(r.canonical)
        if errors in ("not_an_object", "duplicate_key"):
            assert parsed["arguments"] == ([1] if text == "[1]" else text or "")
        else:
            value = json.loads(text)
            assert parsed["arguments"] == value
            assert r.canonical == json.dumps({"arguments": value, "id": str(k), "name": "t", "role": "assistant", "type": "call"}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert calls["u"].arg_errors == "unknown_tool"


def test_field_names_nested_schemas_and_whole_numbers(spark):
    point = {"type": "object", "fields": {"x": ("number", True), "tag.s": ({"type": "string", "enum": ["a", "b c"]}, False)}}
    tool = {"t": {
        "user.name": ("string", True), "it's \"q\"?": ("integer", False), "n": ({"type": "integer", "min": 0, "max": 10}, False), "mode": ({"type": "string", "enum": ["on", "off"]}, False),
        "points": ({"type": "array", "items": point}, False), "grid": ({"type": "array", "items": {"type": "array", "items": "integer"}}, False),
    }}
    cases = [
        ({"user.name": "x"}, ""), ({"user": {"name": "x"}}, "missing:user.name,unknown:user"), ({"user.name": 1}, "type:user.name"), ({"user.name": "x", "it's \"q\"?": 3}, ""), ({"user.name": "x", "it's \"q\"?": "3"}, "type:it's \"q\"?"),
        ('{"user.name": "x", "n": 1.0}', ""), ('{"user.name": "x", "n": 1e1}', ""), ('{"user.name": "x", "n": 1.5}', "type:n"), ({"user.name": "x", "n": 11}, "range:n"), ({"user.name": "x", "n": -1}, "range:n"), ({"user.name": "x", "n": 10}, ""),
        ({"user.name": "x", "mode": "on"}, ""), ({"user.name": "x", "mode": "ON"}, "enum:mode"), ({"user.name": "x", "mode": None}, "type:mode"),
        ({"user.name": "x", "points": []}, ""), ({"user.name": "x", "points": [{"x": 1}, {"x": 2.5, "tag.s": "b c"}]}, ""),
        ({"user.name": "x", "points": [{"x": 1}, {"tag.s": "c"}, 7, {"x": "1", "y": 0}]}, "enum:points[].tag.s,missing:points[].x,type:points[],type:points[].x,unknown:points[].y"),
        ({"user.name": "x", "grid": [[1, 2], [3.0]]}, ""), ({"user.name": "x", "grid": [[1], ["2"], 3]}, "type:grid[],type:grid[][]"),
    ]
    texts = [c if isinstance(c, str) else json.dumps(c) for c, _ in cases]
    rows = link(spark, [(1, 0, "assistant", "", [call(str(k), "t", text) for k, text in enumerate(texts)], None)], tool)
    found = {r.call_id: r for r in rows if r.node == "call"}
    assert [found[str(k)].arg_errors for k in range(len(cases))] == [errors for _, errors in cases]
    assert '{"n":1,"user.name":"x"}' in found["5"].canonical  # what is valid as an integer is written as one


def test_rows_that_repeat_are_repeats(spark):
    rows = [(1, 0, "assistant", "", [call("a"), call("a")], None)] * 3 + [(1, 1, "tool", "r", None, "a")] * 2
    status = sorted((r.node, r.status) for r in link(spark, rows))
    assert status == [("call", "linked")] + [("call", "repeated")] * 5 + [("message", "plain")] * 3 + [("result", "linked"), ("result", "repeated")]


def test_levels_against_plain_search(spark):
    """Random graphs with chains, several dependencies and cycles, one long chain, and a very long text."""
    rng = random.Random(3)
    deps = {(1, f"n{i}"): {f"n{rng.randrange(i)}" for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))} for i in range(1, 60)} | {(1, "n0"): set()}
    deps |= {(2, f"k{i}"): {f"k{i - 1}"} if i else set() for i in range(300)}
    deps |= {(3, "a"): {"b"}, (3, "b"): {"c"}, (3, "c"): {"a"}, (3, "d"): {"c"}, (3, "e"): {"d", "f"}, (3, "f"): set()}
    turns = {k: rng.randrange(500) for k in deps}
    rows = [(conv, turns[conv, name], "assistant", "long text " * 20_000 if name == "n0" else "", [call(name, deps=sorted(of))], None) for (conv, name), of in deps.items()]
    found = {(r.conv_id, r.call_id): (r.status, r.topo_level, r.topo_turn) for r in link(spark, rows) if r.node == "call"}
    known: dict = {}
    while more := {k: (max((known[k[0], d][0] + 2 for d in of), default=0), max((known[k[0], d][1] for d in of), default=0)) for k, of in deps.items() if k not in known and all((k[0], d) in known for d in of)}:
        known |= {k: (level, max(turn, turns[k])) for k, (level, turn) in more.items()}
    assert {k: ("no_result", *known[k]) if k in known else ("cycle", 0, turns[k]) for k in deps} == found


def ladder(levels: int, width: int) -> dict[str, list[str]]:
    """Calls by level, each of which depends on all of the level before."""
    return {f"{k}.{i}": [f"{k - 1}.{j}" for j in range(width)] if k else [] for k in range(levels) for i in range(width)}


@pytest.mark.parametrize(("levels", "width", "rounds"), [(1000, 2, 20), (12, 12, 12)])
def test_rounds_of_calls_with_several_dependencies(spark, monkeypatch, levels, width, rounds):
    """A deep narrow graph takes few rounds; a wide one grows in none. Calls on and behind a cycle beside them."""
    written = []
    monkeypatch.setattr(C, "materialize", lambda df, tag: written.append((tag, plain(df, tag))) or written[-1][1])
    monkeypatch.setattr(C, "drop_materialized", lambda df: None)  # until they are counted
    deps = ladder(levels, width)
    odd = {"x": ["y", "0.0"], "y": ["x", "0.1"], "z": ["x", f"{levels - 1}.0"]}
    found = {r.call_id: r for r in link(spark, [(1, int(k.partition(".")[0]), "assistant", "", [call(k, deps=of)], None) for k, of in deps.items()] + [(1, 5, "assistant", "", [call(k, deps=of)], None) for k, of in odd.items()])}
    assert all((found[k].topo_level, found[k].topo_turn) == (2 * int(k.partition(".")[0]), int(k.partition(".")[0])) for k in deps)
    assert {found[k].status for k in odd} == {"cycle"}
    assert sum(tag == "call-levels" for tag, _ in written) <= rounds + 2
    edges = sum(len(of) for of in (*deps.values(), *odd.values()))
    assert max(df.count() for tag, df in written if tag == "call-pending") <= C.WIDEST * edges
    for _, df in written:
        drop_table(df)


def test_empty(spark):
    assert link(spark, []) == []


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet")
    rows = table.collect()
    out = C.link_tool_calls(C.demo_messages(table), C.DEMO_SCHEMAS).collect()
    asks = [r for r in rows if r.role == "assistant"]
    answers = {(r.conv_id, f"{'x' if (r.conv_id + r.turn) % 17 == 0 else 'c'}{r.turn - 1}") for r in rows if r.role != "assistant" and r.turn and (r.conv_id + r.turn) % 13}
    linked = {(r.conv_id, r.call_id) for r in out if r.node == "result" and r.status == "linked"}
    assert linked == answers & {(r.conv_id, f"c{r.turn}") for r in asks}
    assert len(out) == len(rows) - len(answers) + len(asks) + len(answers)
    place = {(r.conv_id, r.node, r.call_id): (r.topo_turn, r.topo_level, r.turn, r.place) for r in out if r.node != "message"}
    for conv, name in linked:
        assert place[conv, "call", name] < place[conv, "result", name]
        n = int(name[1:])
        if n % 8 in (3, 5, 7) and (conv, f"c{n - 2}") in linked:
            assert place[conv, "result", f"c{n - 2}"] < place[conv, "call", name]
    for r in out:
        assert json.dumps(json.loads(r.canonical), ensure_ascii=False, sort_keys=True, separators=(",", ":")) == r.canonical
