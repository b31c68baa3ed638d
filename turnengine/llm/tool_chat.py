"""Tool-call linking for chat data, in DataFrame functions only.

Messages: conv_id, turn, role, content, calls (array of struct<call_id, name, arguments, depends_on>), result_of (the
call a message answers, or null). Each message, call and result becomes a node:

- Calls and results meet in a shuffled hash join on (conversation, identifier). The first call of an identifier, by
  turn and place, is the call, the first result is its result; others are kept and marked as repeats.
- Order: a result comes after its call, and a call after the results of the calls it depends on. topo_level is the
  longest such path before a node and topo_turn the largest turn on it; sorting by (topo_turn, topo_level, turn,
  place) is a topological order that keeps to the turns where it can. Chains of calls with one dependency each are
  contracted by pointer doubling, in as many rounds as the logarithm of their length. Calls with several dependencies
  are peeled: a round resolves those whose dependencies are all resolved and lets the rest jump over each other, which
  halves their paths; a jump that would make over WIDEST rows an edge is left out, so that no round grows beyond the
  edges, and such wide graphs take up to a round a level. What never resolves lies on or behind a cycle and is
  marked. There is no per-conversation task: a conversation of any length is spread over the cluster.
- Arguments are parsed as JSON and checked against the tool's schema: an object, no field missing, none unknown, each
  of its type, among its values, within its range, and so on into elements and fields. Whole numbers are integers however
  they are written, as the canonical form writes them. canonical is the node as compact JSON with keys in order and characters unescaped where JSON allows.

Defined cases: null content is an empty string, very long content is one string; a call without identifier cannot be
linked; a null or malformed argument string, or one with anything but white space behind its object, is not an object;
one that repeats a key is a duplicate_key (deeper down: not an object); the canonical form of these holds the raw
string; a dependency on an unknown call is
marked and ignored; a null conv_id is a conversation of its own; repeated messages are repeats of their calls and
results, also where turn and place repeat (one row of equals is taken as the first); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import drop_materialized, materialize

#: A type (string, integer, number, boolean, array, object), or {type, enum: values, min, max, items: spec of every element,
#: fields: those of an object}.
Spec = str | dict
#: Field: (spec, whether it is required), and those of each tool by its name.
Fields = dict[str, tuple[Spec, bool]]
Schemas = dict[str, Fields]

_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_object(fields: dict[str, Column]) -> Column:
    """Compact JSON of an object from its fields' JSON, keys in order."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(sorted(fields.items())):
        parts += [F.lit(f'{"," if i else ""}"{name}":'), value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def parse_arguments(arguments: Column) -> Column:
    """A text as a variant, or null unless the whole of it is one JSON value without repeated keys.

    Spark's parser ignores what follows a value. So the text is parsed as the first of two elements of an array; the
    second, which the text cannot know, is only found behind a first that ended where the text did.
    """
    seal = F.md5(arguments)
    both = F.try_parse_json(F.concat(F.lit("["), arguments, F.lit(',"'), seal, F.lit('"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == seal, F.try_variant_get(both, "$[0]", "variant"))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _has_type(value: Column, kind: str) -> Column:
    """Whether a variant is of a type. A number whose value is whole is an integer, however it is written (1.0, 1e3)."""
    schema = F.schema_of_variant(value)
    if kind == "integer":
        number = _as(value, "double")
        return F.coalesce(schema.rlike(f"^{_TYPES['integer']}$") | (schema.rlike(f"^{_TYPES['number']}$") & (number == F.floor(number))), F.lit(False))
    return F.coalesce(schema.rlike(f"^{_TYPES[kind]}$"), F.lit(False))


def _none() -> Column:
    return F.array().cast("array<string>")


def _value_errors(value: Column, spec: Spec, path: str) -> Column:
    """Array of errors of a value: type, and if that is right enum, range, and those of items and fields."""
    spec = {"type": spec} if isinstance(spec, str) else spec
    deeper: list[Column] = []
    if "enum" in spec:
        allowed = [json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in spec["enum"]]
        deeper.append(F.when(~F.to_json(value).isin(allowed), F.array(F.lit(f"enum:{path}"))))
    low, high, number = spec.get("min"), spec.get("max"), _as(value, "double")
    if low is not None or high is not None:
        out = (number < low if low is not None else F.lit(False)) | (number > high if high is not None else F.lit(False))
        deeper.append(F.when(F.coalesce(out, F.lit(False)), F.array(F.lit(f"range:{path}"))))
    if "items" in spec:
        each = F.transform(_as(value, "array<variant>"), lambda v: _value_errors(v, spec["items"], f"{path}[]"))
        deeper.append(F.array_sort(F.array_distinct(F.flatten(each))))
    if "fields" in spec:
        deeper.append(_field_errors(value, F.json_object_keys(F.to_json(value)), spec["fields"], f"{path}."))
    if not deeper:
        return F.when(_has_type(value, spec["type"]), _none()).otherwise(F.array(F.lit(f"type:{path}")))
    found = F.concat(*[F.coalesce(d.cast("array<string>"), _none()) for d in deeper])
    return F.when(_has_type(value, spec["type"]), found).otherwise(F.array(F.lit(f"type:{path}")))


def _field_errors(value: Column, keys: Column, fields: Fields, at: str = "") -> Column:
    """Array of errors of an object's fields, in their order, then the unknown ones. Fields are looked up by name in a map, so
    any name will do."""
    values, errors = _as(value, "map<string,variant>"), []
    for field, (spec, required) in sorted(fields.items()):
        has = F.array_contains(keys, F.lit(field))
        errors.append(F.when(has, _value_errors(F.try_element_at(values, F.lit(field)), spec, at + field)).otherwise(F.array(F.lit(f"missing:{at}{field}")) if required else _none()))
    known = F.array(*[F.lit(f) for f in sorted(fields)]).cast("array<string>")
    return F.concat(*errors, F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit(f"unknown:{at}"), k)))


def argument_errors(name: Column, arguments: Column, schemas: Schemas, parsed: Column) -> Column:
    """Array of errors of a call's arguments: unknown_tool, not_an_object, duplicate_key, or, by field, missing:f, type:f,
    enum:f, range:f, unknown:f; fields of objects are named f.g, elements of arrays f[].

    parsed: parse_arguments(arguments).
    """
    keys = F.json_object_keys(arguments)
    found = F.when(F.size(keys) > F.size(F.array_distinct(keys)), F.array(F.lit("duplicate_key"))).when(keys.isNull() | parsed.isNull(), F.array(F.lit("not_an_object")))
    for tool, fields in sorted(schemas.items()):
        found = found.when(name == tool, _field_errors(parsed, keys, fields))
    return found.otherwise(F.array(F.lit("unknown_tool")))


_CALL = ["conv", "call_id"]
#: Rows that a jump over calls with several dependencies may make, for each of their edges.
WIDEST = 8


def _chains(singles: DataFrame) -> DataFrame:
    """(conv, call_id, head, dist, acc) of calls with one dependency, by pointer doubling.

    singles: conv, call_id, head (the dependency), dist, acc (the largest turn on the way). Afterwards head is the first
    call before it that has none or several dependencies; a head that is itself in singles is on a cycle.
    """
    chains = materialize(singles, "call-chains")
    rounds = chains.count().bit_length() + 1  # after so many every chain without a cycle has reached its head
    for _ in range(rounds):
        behind = chains.select("conv", F.col("call_id").alias("head"), F.col("head").alias("h"), F.col("dist").alias("d"), F.col("acc").alias("a"))
        more = chains.join(behind, ["conv", "head"], "left").select("conv", "call_id", F.coalesce("h", "head").alias("head"), (F.col("dist") + F.coalesce("d", F.lit(0))).alias("dist"), F.greatest("acc", "a").alias("acc"), F.col("h").isNotNull().alias("moved"))
        more = materialize(more, "call-chains")
        drop_materialized(chains)
        chains = more
        if chains.where("moved").isEmpty():
            break
    return chains


def _peel(edges: DataFrame, done: DataFrame) -> list[DataFrame]:
    """done and, round by round, what it resolves: tables of (conv, call_id, level, after).

    edges: conv, call_id, own, dep, dist, acc of calls with several dependencies. A round resolves the calls all of whose
    paths end at resolved ones, drops them, and then lets the others jump: an edge to an open call gives way to that
    call's own edges, the longest of each pair of ends, so that paths halve. Where calls fan out so widely that a jump
    would make more than WIDEST rows an edge, the round goes without. If nothing is resolved, what is left is on or
    behind a cycle.
    """
    resolved, latest = [done], done
    pending = materialize(edges.withColumns({"level": F.lit(None).cast("bigint"), "after": F.lit(None).cast("bigint")}), "call-pending")
    most = WIDEST * pending.count()
    while not pending.isEmpty():
        ready = latest.select("conv", F.col("call_id").alias("dep"), F.col("level").alias("l"), F.col("after").alias("a"))
        level, after = F.coalesce("level", F.col("l") + F.col("dist")), F.coalesce("after", F.when(F.col("l").isNotNull(), F.greatest("acc", "a")))
        filled = materialize(pending.join(ready, ["conv", "dep"], "left").select(*_CALL, "own", F.when(level.isNull(), F.col("dep")).alias("dep"), "dist", "acc", level.alias("level"), after.alias("after")), "call-pending")
        drop_materialized(pending)
        known = filled.groupBy(_CALL).agg(F.count_if(F.col("level").isNull()).alias("open"), F.max("level").alias("level"), F.max(F.greatest("own", "after")).alias("after")).where("open = 0")
        latest = materialize(known.select(*_CALL, "level", "after"), "call-levels")
        if latest.isEmpty():
            drop_materialized(filled)
            drop_materialized(latest)
            break
        resolved.append(latest)
        pending = materialize(filled.join(latest.select(_CALL), _CALL, "left_anti"), "call-pending")
        drop_materialized(filled)
        fan = pending.groupBy("conv", F.col("call_id").alias("dep")).agg(F.count("*").alias("n"))
        rows = pending.join(fan, ["conv", "dep"], "left").agg(F.sum(F.coalesce("n", F.lit(1)))).first()[0] or 0
        if 0 < rows <= most:
            jumped = materialize(_jump(pending), "call-pending")
            drop_materialized(pending)
            pending = jumped
    return resolved


def _jump(pending: DataFrame) -> DataFrame:
    """Edges of twice the reach. Those with a level are at their end (dep is null) and stay, one a call."""
    onward = pending.select("conv", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("own").alias("o"), F.col("dist").alias("d"), F.col("acc").alias("c"), F.col("level").alias("l"), F.col("after").alias("a"), F.lit(True).alias("met"))
    far = pending.join(onward, ["conv", "dep"], "left").select(
        *_CALL, "own", F.when(F.col("met"), F.col("next")).otherwise(F.col("dep")).alias("dep"), (F.col("dist") + F.coalesce("d", F.lit(0))).alias("dist"), F.greatest("acc", "o", "c").alias("acc"),
        F.coalesce("level", F.col("dist") + F.col("l")).alias("level"), F.coalesce("after", F.when(F.col("l").isNotNull(), F.greatest("acc", "o", "a"))).alias("after"),
    )
    return far.groupBy(*_CALL, "own", "dep").agg(*[F.max(c).alias(c) for c in ("dist", "acc", "level", "after")])


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level, reach, lost): level and largest turn up to each first call; lost dependencies.

    calls: conv, call_id, depends_on, call_turn, result_turn of first calls. Calls on cycles have a null level.
    """
    calls = calls.withColumn("own", F.greatest("call_turn", "result_turn"))
    edges = calls.select(*_CALL, F.explode(F.array_distinct("depends_on")).alias("dep"))
    known = calls.select("conv", F.col("call_id").alias("dep"), F.lit(1).alias("is_call"))
    stored = edges = materialize(edges.join(known.hint("shuffle_hash"), ["conv", "dep"], "left"), "call-edges")
    lost = edges.where("is_call is null").groupBy(_CALL).agg(F.count("*").alias("lost"))
    edges = edges.where("is_call is not null").drop("is_call")
    fan = edges.groupBy(_CALL).agg(F.count("*").alias("n"), F.min("dep").alias("head"))
    singles = fan.where("n = 1").join(calls.select(*_CALL, "own"), _CALL).select(*_CALL, "head", F.lit(2).cast("bigint").alias("dist"), F.col("own").alias("acc"))
    chains = _chains(singles)
    behind = chains.select("conv", F.col("call_id").alias("dep"), "head", F.col("dist").alias("d"), "acc")
    several = edges.join(fan.where("n > 1").select(_CALL), _CALL, "left_semi").join(calls.select(*_CALL, "own"), _CALL).join(behind, ["conv", "dep"], "left").select(*_CALL, "own", F.coalesce("head", "dep").alias("dep"), (F.coalesce("d", F.lit(0)) + 2).cast("bigint").alias("dist"), "acc")
    roots = materialize(calls.join(fan.select(_CALL), _CALL, "left_anti").select(*_CALL, F.lit(0).cast("bigint").alias("level"), F.col("own").alias("after")), "call-levels")
    parts = _peel(several, roots)
    done = parts[0]
    for part in parts[1:]:
        done = done.union(part)
    heads = done.select("conv", F.col("call_id").alias("head"), "level", F.col("after").alias("a"))
    done = materialize(done.union(chains.join(heads, ["conv", "head"]).select(*_CALL, F.col("level") + F.col("dist"), F.greatest("acc", "a"))), "call-levels")
    reach = edges.join(done.select("conv", F.col("call_id").alias("dep"), "after"), ["conv", "dep"]).groupBy(_CALL).agg(F.max("after").alias("after"))
    found = calls.select(*_CALL, "call_turn").join(done.select(*_CALL, "level"), _CALL, "left").join(reach, _CALL, "left").join(lost, _CALL, "left")
    found = materialize(found.select(*_CALL, F.col("level").cast("int").alias("level"), F.when(F.col("level").isNotNull(), F.greatest("call_turn", "after")).alias("reach"), F.coalesce("lost", F.lit(0)).alias("lost")), "call-found")
    for spent in (*parts, chains, done, stored):
        drop_materialized(spent)
    return found


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per message, call and result: conv_id, turn, place, node, call_id, status, args_valid, arg_errors,
    topo_turn, topo_level, canonical.

    status: of messages plain; of calls linked, no_result, repeated, no_id, cycle, and lost_dependency where one is
    unknown; of results linked, no_call, repeated.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    # written once, so that a row is known by its number wherever it is used
    base = materialize(messages.select(F.monotonically_increasing_id().alias("row"), "conv_id", conv.alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("content", F.lit("")).alias("content"), "calls", "result_of"), "messages")
    calls = base.select("row", "conv_id", "conv", "turn", F.posexplode("calls").alias("place", "call")).select("row", "conv_id", "conv", "turn", "place", "call.*")
    results = base.where("result_of is not null")
    first_call = calls.where("call_id is not null").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "place", "row", "arguments", "name", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))).alias("f"), F.count("*").alias("n_calls"))
    first_result = results.groupBy("conv", F.col("result_of").alias("call_id")).agg(F.min(F.struct("turn", "row")).alias("r")).select("conv", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.row").alias("result_row"))
    linked = materialize(first_call.join(first_result.hint("shuffle_hash"), ["conv", "call_id"], "left").select("conv", "call_id", F.col("f.turn").alias("call_turn"), F.col("f.place").alias("call_place"), F.col("f.row").alias("call_row"), F.col("f.depends_on").alias("depends_on"), "result_turn", "result_row"), "calls-linked")
    levels = _levels(linked)
    known = materialize(linked.drop("depends_on").join(levels, ["conv", "call_id"]), "calls-known")
    drop_materialized(levels)
    drop_materialized(linked)

    no = F.lit(None)
    plain = base.where("result_of is null").select("conv_id", "turn", F.lit(-1).alias("place"), F.lit("message").alias("node"), no.cast("string").alias("call_id"), F.lit("plain").alias("status"), no.cast("boolean").alias("args_valid"), no.cast("string").alias("arg_errors"), F.col("turn").alias("topo_turn"), F.lit(0).alias("topo_level"), json_object({"content": json_string(F.col("content")), "role": json_string(F.col("role"))}).alias("canonical"))

    errors = argument_errors(F.col("name"), F.col("arguments"), schemas, F.col("parsed"))
    arguments = F.when(F.col("parsed").isNotNull(), F.to_json("parsed")).otherwise(json_string(F.col("arguments")))
    is_first = (F.col("row") == F.col("call_row")) & (F.col("place") == F.col("call_place"))
    call_status = (
        F.when(F.col("call_id").isNull(), "no_id").when(~is_first, "repeated").when(F.col("level").isNull(), "cycle").when(F.col("lost") > 0, "lost_dependency").when(F.col("result_turn").isNull(), "no_result").otherwise("linked")
    )
    ordered = is_first & F.col("level").isNotNull()
    call_rows = calls.join(known.hint("shuffle_hash"), ["conv", "call_id"], "left").withColumn("parsed", parse_arguments(F.col("arguments"))).withColumn("errors", errors).select(
        "conv_id", "turn", "place", F.lit("call").alias("node"), "call_id", call_status.alias("status"), (F.size("errors") == 0).alias("args_valid"), F.concat_ws(",", "errors").alias("arg_errors"),
        F.when(ordered, F.col("reach")).otherwise(F.col("turn")).alias("topo_turn"), F.when(ordered, F.col("level")).otherwise(F.lit(0)).alias("topo_level"),
        json_object({"arguments": arguments, "id": json_string(F.col("call_id")), "name": json_string(F.col("name")), "role": F.lit('"assistant"'), "type": F.lit('"call"')}).alias("canonical"),
    )
    has_call = F.col("call_turn").isNotNull()
    result_rows = results.withColumnRenamed("result_of", "call_id").join(known.hint("shuffle_hash"), ["conv", "call_id"], "left").select(
        "conv_id", "turn", F.lit(-1).alias("place"), F.lit("result").alias("node"), "call_id", F.when(~has_call, "no_call").when(F.col("row") != F.col("result_row"), "repeated").otherwise("linked").alias("status"), no.cast("boolean").alias("args_valid"), no.cast("string").alias("arg_errors"),
        F.greatest("turn", F.coalesce("reach", "call_turn", "turn")).alias("topo_turn"), F.coalesce(F.col("level") + 1, F.when(has_call, F.lit(1)).otherwise(F.lit(0))).alias("topo_level"),
        json_object({"content": json_string(F.col("content")), "id": json_string(F.col("call_id")), "role": F.lit('"tool"'), "type": F.lit('"result"')}).alias("canonical"),
    )
    return plain.unionByName(call_rows).unionByName(result_rows)


#: The tools of the query over plain conversations.
DEMO_SCHEMAS: Schemas = {
    "fetch": {"url": ("string", True)},
    "score": {"text": ("string", True), "weight": ("number", False)},
    "search": {"limit": ("integer", False), "query": ("string", True)},
}


def demo_messages(conversations: DataFrame) -> DataFrame:
    """Tool traffic derived from plain conversations by fixed rules, all rows used.

    Every assistant turn t also makes the call c{t}, to the tool that (conv_id + t) mod 3 names (fetch, score,
    search), with its own text in the arguments; where (7 conv_id + t) mod 11 is 0 the arguments lack the text, 1:
    the text is a number, 2: there is an extra field, 3: the last brace is missing. In turns t with t mod 8 in
    (3, 5, 7) the call depends on c{t-2}. Every other turn is the result of c{t-1}, or of x{t-1} where
    (conv_id + t) mod 17 is 0; turn 0 and turns with (conv_id + t) mod 13 = 0 are plain.
    """
    conv, turn = F.coalesce(F.col("conv_id"), F.lit(0)), F.coalesce(F.col("turn"), F.lit(0)).cast("bigint")
    tool = F.element_at(F.array(F.lit("fetch"), F.lit("score"), F.lit("search")), (F.pmod(conv + turn, F.lit(3)) + 1).cast("int"))
    field = F.element_at(F.array(F.lit("url"), F.lit("text"), F.lit("query")), (F.pmod(conv + turn, F.lit(3)) + 1).cast("int"))
    flaw = F.pmod(conv * 7 + turn, F.lit(11))
    more = F.when(tool == "search", F.concat(F.lit('"limit": '), turn.cast("string"))).when(tool == "score", F.concat(F.lit('"weight": '), turn.cast("string"), F.lit(".5")))
    main = F.when(flaw == 0, no_text()).when(flaw == 1, F.concat(F.lit('"'), field, F.lit('": 7'))).otherwise(F.concat(F.lit('"'), field, F.lit('": '), json_string(F.col("text"))))
    extra = F.when(flaw == 2, F.lit('"zz": true'))
    arguments = F.concat(F.lit("{ "), F.concat_ws(" , ", extra, main, more), F.when(flaw == 3, F.lit("")).otherwise(F.lit(" }")))
    depends = F.when(F.pmod(turn, F.lit(8)).isin(3, 5, 7), F.array(F.concat(F.lit("c"), (turn - 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    call = F.struct(F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    asks = F.col("role") == "assistant"
    answers = ~F.coalesce(asks, F.lit(False)) & (turn > 0) & (F.pmod(conv + turn, F.lit(13)) != 0)
    return conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("content"), F.when(asks, F.array(call)).alias("calls"),
        F.when(answers, F.concat(F.when(F.pmod(conv + turn, F.lit(17)) == 0, F.lit("x")).otherwise(F.lit("c")), (turn - 1).cast("string"))).alias("result_of"),
    )


def no_text() -> Column:
    return F.lit(None).cast("string")
