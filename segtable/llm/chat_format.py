"""Tool-call linking in conversations, and their messages as canonical JSON.

A message of a conversation is text. An assistant's text may hold calls,
``<tool_call>{"id", "name", "arguments"}</tool_call>``; a message of role ``tool`` is a
result, a JSON object with ``tool_call_id`` and ``content``. An argument of the form
``{"$result": id}`` stands for another call's result.

Calls and results meet in a hash join on conversation and identifier: the first call
of an id and the first result that names it are linked; messages with a later call of
an id, or a later result for it, are marked ``repeated`` and link nothing by that.
Messages are ordered topologically: a result follows its call and a call the results it
uses; every message keeps its turn unless one it depends on comes later, and then it
takes that one's turn, a step behind. The dependencies of a conversation are solved in
one pass over them if there are at most ``SHORT``; longer conversations are peeled level
by level with joins, so no conversation, however long, is gathered in one task. What is
left when nothing moves is a cycle (and what waits for it), which keeps its turns and is
marked. The place of a message is the pair (order_turn, order_step).

Arguments are checked against the tool's schema, where a reference to a result fits
anything. A schema with a keyword that is not checked here is refused (``KEYWORDS``).

Canonical JSON has sorted keys, no spaces, and whole floats as integers.

Cases: null texts have null content; null roles, ids and turns stay null, and rows
with a null conversation or turn link with nothing; JSON that cannot be read leaves
the text as content with the problem ``malformed``; repeated rows are repeated in the
result and linked once; an empty table stays empty; other columns do not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_SURROGATE = re.compile("[\ud800-\udfff]")
_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: Keywords of a schema that are checked, and those that say nothing about values.
KEYWORDS = ("type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "required", "properties", "additionalProperties", "items", "minItems", "maxItems")
ANNOTATIONS = ("title", "description", "default", "examples", "$schema", "$id", "$comment")
#: Conversations of at most so many dependencies are ordered in one pass.
SHORT = 20_000


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole floats are written as integers, lone surrogates as escapes."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def check_schema(schema, at: str = "$") -> None:
    """Refuse a schema that :func:`faults` would not check in full."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object")
    unknown = sorted(set(schema) - {*KEYWORDS, *ANNOTATIONS})
    if unknown:
        raise ValueError(f"{at}: keywords that are not checked: {', '.join(unknown)}")
    strange = [k for k in _kinds(schema) if k not in _KINDS and k not in ("number", "integer")]
    if strange:
        raise ValueError(f"{at}: unknown types: {strange}")
    for name, below in schema.get("properties", {}).items():
        check_schema(below, f"{at}.{name}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")
    if isinstance(schema.get("additionalProperties"), dict):
        check_schema(schema["additionalProperties"], f"{at}.*")


def _kinds(schema: dict) -> list[str]:
    kind = schema.get("type", [])
    return kind if isinstance(kind, list) else [kind]


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _is(value, kind: str) -> bool:
    if kind == "number":
        return _number(value)
    if kind == "integer":
        return _number(value) and (isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS[kind])


def _same(a, b) -> bool:
    """JSON equality: true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def is_reference(value) -> bool:
    return isinstance(value, dict) and set(value) == {"$result"} and isinstance(value["$result"], str)


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``, by its ``KEYWORDS``; a reference to a result breaks nothing."""
    if is_reference(value):
        return []
    kinds, out = _kinds(schema), []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: not the constant")
    if _number(value):
        low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        if value < schema.get("minimum", value) or value > schema.get("maximum", value) or (low is not None and value <= low) or (high is not None and value >= high):
            out.append(f"{at}: out of range")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: not of the pattern")
    if isinstance(value, dict):
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif other is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(other, dict):
                out += faults(value[k], other, f"{at}.{k}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: wrong number of items")
        for k, v in enumerate(value if "items" in schema else []):
            out += faults(v, schema["items"], f"{at}[{k}]")
    return out


def references(value) -> Iterator[str]:
    """Identifiers of results that arguments stand for."""
    if is_reference(value):
        yield value["$result"]
    elif isinstance(value, dict):
        for v in value.values():
            yield from references(v)
    elif isinstance(value, list):
        for v in value:
            yield from references(v)


def parse(role: str | None, text: str | None, tools: dict) -> tuple:
    """content, calls as (id, name, canonical arguments, faults, references), id of a result, problem."""
    if text is None:
        return None, [], None, None
    if role == "tool":
        try:
            value = json.loads(text)
            if isinstance(value, dict) and isinstance(value.get("tool_call_id"), str):
                return canonical(value.get("content")), [], value["tool_call_id"], None
        except (ValueError, RecursionError):
            pass
        return canonical(text), [], None, "malformed"
    if role != "assistant" or "<tool_call>" not in text:
        return canonical(text), [], None, None
    calls, problem = [], None
    for body in _CALL.findall(text):
        try:
            call = json.loads(body)
            if not isinstance(call, dict) or "name" not in call:
                raise ValueError("no call")
            name, arguments = call["name"], call.get("arguments", {})
            known = isinstance(name, str) and name in tools
            wrong = faults(arguments, tools[name]) if known else ["unknown tool"]
            made = canonical(arguments)
        except (ValueError, RecursionError):
            problem = "malformed"
            continue
        calls.append((call["id"] if isinstance(call.get("id"), str) else None, name if isinstance(name, str) else canonical(name), made, wrong, sorted(set(references(arguments)))))
    return canonical(_CALL.sub("", text).strip()), calls, None, problem


def message(role: str | None, content: str | None, calls: list[tuple], result_id: str | None, name: str | None) -> str:
    """One message as canonical JSON, from parts that are canonical already."""
    parts = [f'"content":{content if content is not None else "null"}']
    if name is not None:
        parts.append(f'"name":{canonical(name)}')
    parts.append(f'"role":{canonical(role)}')
    if result_id is not None:
        parts.append(f'"tool_call_id":{canonical(result_id)}')
    if calls:
        shown = [f'{{"arguments":{a},"faults":{canonical(w)},"id":{canonical(i)},"linked":{canonical(linked)},"name":{canonical(n)}}}' for i, n, a, w, linked in calls]
        parts.append(f'"tool_calls":[{",".join(shown)}]')
    return "{" + ",".join(parts) + "}"


_PARSED = (
    "conv_id long, turn long, role string, content string, "
    "calls array<struct<id:string,name:string,arguments:string,faults:array<string>,refs:array<string>>>, result_id string, problem string, key long"
)


def _parsed(df: DataFrame, tools: dict) -> DataFrame:
    call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("faults", pa.list_(pa.string())), ("refs", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(r, t, tools) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            calls = pa.array([[dict(zip(("id", "name", "arguments", "faults", "refs"), c, strict=True)) for c in r[1]] for r in rows], pa.list_(call))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([r[0] for r in rows], pa.string()), calls, pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()), batch.column(4)],
                names=["conv_id", "turn", "role", "content", "calls", "result_id", "problem", "key"],
            )

    return df.mapInArrow(run, _PARSED)


_PLACES = "key long, order_turn long, order_step long, cyclic boolean"


def places(edges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(key, order_turn, order_step, cyclic) of each message of one conversation whose place is not its turn.

    ``edges`` are (key, before, turn, before_turn).
    """
    at, after, waits = {}, {}, {}
    for key, before, turn, before_turn in edges:
        at[key], at[before] = (turn, 0), (before_turn, 0)
        after.setdefault(before, []).append(key)
        waits[key] = waits.get(key, 0) + 1
    own, ready = dict(at), [k for k in at if k not in waits]
    for key in ready:  # grows while it is read
        for later in after.get(key, ()):
            at[later] = max(at[later], (at[key][0], at[key][1] + 1))
            waits[later] -= 1
            if not waits[later]:
                ready.append(later)
    done = set(ready)
    return [(k, *at[k], False) if k in done else (k, own[k][0], 0, True) for k in at if k not in done or at[k] != own[k]]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`places` of each conversation; rows (conv_id, key, before, turn, before_turn) come ordered by conversation."""
    held, last = [], None

    def out() -> pa.RecordBatch:
        rows = places(held)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["key", "order_turn", "order_step", "cyclic"])

    for batch in batches:
        for conv, *edge in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and conv != last:
                yield out()
                held.clear()
            held.append(tuple(edge))
            last = conv
    if held:
        yield out()


def _ordered(messages: DataFrame, needs: DataFrame) -> DataFrame:
    """key -> (order_turn, order_step, cyclic) of every message of ``needs`` (key, before) whose place is not its turn."""
    turns = messages.select("conv_id", "key", "turn").distinct()
    late = needs.join(turns, "key").join(turns.select(F.col("key").alias("before"), F.col("turn").alias("before_turn")), "before")
    edges, _ = save(late.select("conv_id", "key", "before", "turn", "before_turn").distinct(), "chat-edges")
    long = edges.groupBy("conv_id").count().where(F.col("count") > SHORT).select("conv_id")
    long, path = save(long, "chat-long")
    if long.isEmpty():
        short = edges
    else:  # each has more than SHORT dependencies, so there are as many times fewer
        short = edges.join(long, "conv_id", "left_anti")
    solved = short.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_placed, _PLACES)
    return solved if long.isEmpty() else solved.unionByName(_peeled(edges.join(long, "conv_id", "left_semi").drop("conv_id")))


def _peeled(edges: DataFrame) -> DataFrame:
    """:func:`places` by joins, a level a round."""
    edges, _ = save(edges, "chat-long-edges")
    turns = edges.select("key", "turn").distinct()
    # A message may have to move if something before it is at its turn or later, or may move itself.
    placed, _ = save(edges.where("before_turn < turn").limit(0).select("key", F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_step"), F.lit(False).alias("cyclic")), "chat-places")
    moving = edges.where("before_turn >= turn").select("key").distinct()
    while True:  # whoever may move, and all that depend on them
        more, _ = save(moving.unionByName(edges.join(moving.withColumnRenamed("key", "before"), "before", "left_semi").select("key")).distinct(), "chat-moving")
        grown = more.count()
        if grown == moving.count():
            break
        moving = more
    todo = moving
    while not todo.isEmpty():
        held = edges.join(todo, "key", "left_semi")
        waiting = held.join(todo.withColumnRenamed("key", "before"), "before", "left_semi").select("key").distinct()
        ready = held.join(waiting, "key", "left_anti")
        known = placed.select(F.col("key").alias("before"), "order_turn", "order_step")
        bound = ready.join(known, "before", "left").select("key", "turn", F.struct(F.coalesce("order_turn", "before_turn").alias("t"), (F.coalesce("order_step", F.lit(0)) + 1).alias("s")).alias("at"))
        own = F.struct(F.col("turn").alias("t"), F.lit(0).cast("long").alias("s"))
        step = bound.groupBy("key", "turn").agg(F.max("at").alias("at")).select("key", F.greatest(own, F.col("at")).alias("at"))
        done, _ = save(step.select("key", F.col("at.t").alias("order_turn"), F.col("at.s").cast("long").alias("order_step"), F.lit(False).alias("cyclic")), "chat-step")
        if done.isEmpty():
            rest = todo.join(turns, "key").select("key", F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_step"), F.lit(True).alias("cyclic"))
            return placed.unionByName(rest)
        placed, _ = save(placed.unionByName(done), "chat-places")
        todo, _ = save(todo.join(done, "key", "left_anti"), "chat-todo")
    return placed


_OUT = "conv_id long, turn long, order_turn long, order_step long, role string, n_calls long, n_linked long, n_invalid long, message string, problem string, repeated boolean"


def _written(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, out = [], batch.to_pylist()
            for r in out:
                linked = set(r["linked"] or [])
                calls = [(c["id"], c["name"], c["arguments"], c["faults"], k in linked) for k, c in enumerate(r["calls"])]
                made.append((len(calls), len(linked) + (r["call_name"] is not None), sum(bool(c[3]) for c in calls), message(r["role"], r["content"], calls, r["result_id"], r["call_name"])))
            numbers = [pa.array([m[k] for m in made], pa.int64()) for k in range(3)]
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            yield pa.RecordBatch.from_arrays(
                [column("conv_id"), column("turn"), column("order_turn"), column("order_step"), column("role"), *numbers, pa.array([m[3] for m in made], pa.string()), column("problem"), column("repeated")],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )

    return df.mapInArrow(run, _OUT)


def format_chat(df: DataFrame, tools: dict[str, dict], conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each message: its place, what it calls and what is linked, and the message as canonical JSON."""
    for name, schema in tools.items():
        check_schema(schema, name)
    named = df.select(F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    tied = (F.col("role") == "tool") | ((F.col("role") == "assistant") & F.col("text").contains("<tool_call>"))
    tied = F.coalesce(tied, F.lit(False))
    alone = _parsed(named.where(~tied).withColumn("key", F.lit(0).cast("long")), tools)
    none = {"order_turn": F.col("turn"), "order_step": F.lit(0).cast("long"), "linked": F.array().cast("array<int>"), "call_name": F.lit(None).cast("string"), "repeated": F.lit(False)}

    parsed = _parsed(named.where(tied).withColumn("key", F.xxhash64("conv_id", "turn", "role", "text")), tools)
    messages, _ = save(parsed, "chat-messages")
    where_ = "conv_id is not null and turn is not null"
    calls = messages.where(where_).select("conv_id", "turn", "key", F.posexplode("calls").alias("k", "call"))
    first_calls = calls.where("call.id is not null").groupBy("conv_id", F.col("call.id").alias("call_id")).agg(F.min(F.struct("turn", "key", "k", F.col("call.name").alias("name"))).alias("c"))
    first_results = messages.where(where_).where("result_id is not null").groupBy("conv_id", F.col("result_id").alias("call_id")).agg(F.min(F.struct("turn", "key")).alias("r"))
    links, _ = save(first_calls.join(first_results.hint("shuffle_hash"), ["conv_id", "call_id"]).select("conv_id", "call_id", F.col("c.key").alias("call_key"), "c.k", "c.name", F.col("r.key").alias("result_key")), "chat-links")
    uses = calls.select("conv_id", "key", F.explode("call.refs").alias("call_id")).join(links, ["conv_id", "call_id"]).select("key", F.col("result_key").alias("before"))
    needs = links.select(F.col("result_key").alias("key"), F.col("call_key").alias("before")).unionByName(uses)
    moved = _ordered(messages.where(where_), needs)

    linked = links.groupBy(F.col("call_key").alias("key")).agg(F.collect_set("k").alias("linked"))
    named_results = links.groupBy(F.col("result_key").alias("key")).agg(F.min("name").alias("call_name"))
    firsts = first_calls.groupBy(F.col("c.key").alias("key")).agg(F.collect_set("c.k").alias("firsts"))
    later = messages.where(where_).select("conv_id", "key", F.col("result_id").alias("call_id")).join(links.select("conv_id", "call_id", "result_key"), ["conv_id", "call_id"]).where("key != result_key")
    later = later.select("key", F.lit(True).alias("known")).distinct()
    whole = messages.join(linked, "key", "left").join(named_results, "key", "left").join(moved, "key", "left").join(firsts, "key", "left").join(later, "key", "left")
    unlinked = F.col("result_id").isNotNull() & F.col("call_name").isNull()
    named_twice = F.exists("calls", lambda c: c["id"].isNotNull()) & (F.size(F.filter("calls", lambda c: c["id"].isNotNull())) > F.size(F.coalesce("firsts", F.array().cast("array<int>"))))
    repeated = F.coalesce(named_twice, F.lit(False)) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull() | (unlinked & F.coalesce("known", F.lit(False)))
    problem = F.coalesce("problem", F.when(F.col("cyclic"), F.lit("cycle")), F.when(unlinked, F.lit("unlinked result")))
    whole = whole.withColumns({"order_turn": F.coalesce("order_turn", "turn"), "order_step": F.coalesce("order_step", F.lit(0).cast("long")), "problem": problem, "repeated": repeated}).drop("cyclic", "firsts", "known")
    return _written(alone.withColumns(none)).unionByName(_written(whole))
