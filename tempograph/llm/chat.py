"""Chat formatting: tool calls linked to results, ordered, checked against schemas, and written as canonical JSON.

A turn's text is plain text, or a JSON object with some of these fields:
`content`; `tool_calls`, a list of {id, name, arguments, depends_on};
`tool_call_id`, which makes the turn the result of that call; `tools`, a list
of {name, parameters} that declares the conversation's tools, `parameters`
being a JSON schema. `depends_on` lists calls whose results a call needs.
Other fields of a message, a call or a tool are kept as they are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import store
from tempograph.llm.components import components

FIELDS = ("content", "tool_calls", "tool_call_id", "tools")
TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: JSON that is nested deeper is plain text; a schema that is, is a bad one.
DEPTH = 100
#: Turns with calls or results of one conversation, and then of one group of linked turns, that a task orders at once.
GROUP = 100_000
#: Keywords of schemas that say nothing about a value.
NOTES = frozenset("$comment $id $schema default deprecated description examples format readOnly title writeOnly".split())


class BadSchema(ValueError):
    """A schema that is none; its text says where."""


class Unsupported(ValueError):
    """A schema keyword that is not checked; its text says where."""


def deeper(value, limit: int = DEPTH) -> bool:
    """Whether lists and objects are nested over `limit` deep."""
    level = [value]
    for _ in range(limit + 1):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v) if isinstance(x, (dict, list))]
        if not level:
            return False
    return True


def parsed(text: str):
    """The JSON value of a text; ValueError where it is none or nested too deep. Of repeated names the last counts."""
    try:
        value = json.loads(text)
    except RecursionError:
        raise ValueError("nested too deep") from None
    if deeper(value):
        raise ValueError("nested too deep")
    return value


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole floats are integers; NaN and infinities null; lone surrogates U+FFFD."""

    def plain(v):
        if isinstance(v, dict):
            return {plain(str(k)): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float):
            return None if not math.isfinite(v) else int(v) if v == int(v) and abs(v) < 2**53 else v
        if isinstance(v, str):
            return clean(v)
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def clean(text: str) -> str:
    """Text in which halves of surrogate pairs that stand alone are U+FFFD."""
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _same(a, b) -> bool:
    return canonical(a) == canonical(b) and isinstance(a, bool) == isinstance(b, bool)


def _wanted(schema: dict, key: str, ok, path: str):
    """schema[key], which must pass `ok`; None where the key is not there."""
    if key not in schema:
        return None
    if not ok(schema[key]):
        raise BadSchema(f"{path}: {key}")
    return schema[key]


def _natural(value) -> bool:
    return _is_number(value) and value >= 0 and (isinstance(value, int) or value.is_integer())


def problems(value, schema, path: str = "$") -> list[str]:
    """Where a value does not fit a JSON schema.

    Checked are type, enum, const, the bounds of numbers, multipleOf, lengths,
    items, uniqueItems, properties, required, additionalProperties and the
    logical keywords. Another keyword raises Unsupported, a malformed one
    BadSchema.
    """
    if isinstance(schema, bool):
        return [] if schema else [path]
    if not isinstance(schema, dict):
        raise BadSchema(path)
    found: list[str] = []
    known = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties",
             "uniqueItems", "items", "properties", "required", "additionalProperties", "allOf", "anyOf", "oneOf", "not"}
    other = sorted(set(schema) - known - NOTES)
    if other:
        raise Unsupported(f"{path}: {other[0]}")
    number = _is_number(value)

    def fits(kind):
        if kind == "number":
            return number
        if kind == "integer":
            return number and (isinstance(value, int) or value.is_integer())
        return isinstance(value, TYPES[kind]) and not (kind != "boolean" and isinstance(value, bool))

    kind = lambda k: isinstance(k, str) and (k in TYPES or k in ("number", "integer"))
    kinds = _wanted(schema, "type", lambda k: kind(k) or (isinstance(k, list) and k and all(map(kind, k))), path)
    if kinds is not None and not any(map(fits, kinds if isinstance(kinds, list) else [kinds])):
        found.append(f"{path}: type")
    listed = _wanted(schema, "enum", lambda x: isinstance(x, list), path)
    if listed is not None and not any(_same(value, e) for e in listed):
        found.append(f"{path}: enum")
    if "const" in schema and not _same(value, schema["const"]):
        found.append(f"{path}: const")
    for key, wrong in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b), ("exclusiveMinimum", lambda b: value <= b), ("exclusiveMaximum", lambda b: value >= b)):
        limit = _wanted(schema, key, _is_number, path)
        if limit is not None and number and wrong(limit):
            found.append(f"{path}: {key}")
    step = _wanted(schema, "multipleOf", lambda x: _is_number(x) and x > 0, path)
    if step is not None and number:
        whole = value % step == 0 if isinstance(value, int) and isinstance(step, int) else math.isfinite(value) and float(value / step).is_integer()
        if not whole:
            found.append(f"{path}: multipleOf")
    for sort, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems"), (dict, "minProperties", "maxProperties")):
        least, most = _wanted(schema, low, _natural, path), _wanted(schema, high, _natural, path)
        if isinstance(value, sort):
            found += [f"{path}: {low}"] * (least is not None and len(value) < least) + [f"{path}: {high}"] * (most is not None and len(value) > most)
    unique = _wanted(schema, "uniqueItems", lambda x: isinstance(x, bool), path)
    if unique and isinstance(value, list) and len({(canonical(v), isinstance(v, bool)) for v in value}) < len(value):
        found.append(f"{path}: uniqueItems")
    fields = _wanted(schema, "properties", lambda x: isinstance(x, dict), path) or {}
    needed = _wanted(schema, "required", lambda x: isinstance(x, list) and all(isinstance(k, str) for k in x), path) or []
    if isinstance(value, dict):
        found += [f"{path}.{k}: required" for k in needed if k not in value]
        for k, v in value.items():
            found += problems(v, fields[k] if k in fields else schema.get("additionalProperties", True), f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += problems(v, schema["items"], f"{path}[{i}]")
    for key in ("allOf", "anyOf", "oneOf"):
        parts = _wanted(schema, key, lambda x: isinstance(x, list) and x, path)
        if parts is not None:
            good = sum(not problems(value, s, path) for s in parts)
            if not (good == len(parts) if key == "allOf" else good == 1 if key == "oneOf" else good):
                found.append(f"{path}: {key}")
    if "not" in schema and not problems(value, schema["not"], path):
        found.append(f"{path}: not")
    return found


def judged(ident: str, arguments: str, schema: str) -> list[str]:
    """Issues of a call's arguments: `invalid`, `bad_schema` or `unsupported_schema`, each with the call and a path."""
    try:
        return [f"invalid: {ident}: {clean(p)}" for p in problems(parsed(arguments), parsed(schema))]
    except BadSchema as e:
        return [f"bad_schema: {ident}: {clean(str(e))}"]
    except Unsupported as e:
        return [f"unsupported_schema: {ident}: {clean(str(e))}"]
    except (ValueError, RecursionError, OverflowError):
        return [f"bad_schema: {ident}: $"]


def _call(call) -> tuple[dict | None, object, list[str]]:
    """A call to link, what stands for it in the message, and issues."""
    if not isinstance(call, dict):
        return None, call, ["bad_call"]
    arguments = call.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = parsed(arguments)
        except ValueError:
            pass
    shown = call | {"arguments": arguments}
    if call.get("id") is None:
        return None, shown, [f"call_without_id: {clean(str(call.get('name', '')))}"]
    needs = call.get("depends_on")
    needs = sorted({clean(str(n)) for n in needs}) if isinstance(needs, list) else []
    shown |= {"id": clean(str(call["id"])), "name": clean(str(call.get("name", "")))}
    if isinstance(call.get("depends_on"), list):
        shown = {k: v for k, v in shown.items() if k != "depends_on"} | ({"depends_on": needs} if needs else {})
    return {"id": shown["id"], "name": shown["name"], "arguments": canonical(arguments), "needs": needs}, shown, []


def read_turn(role, text) -> tuple[str, list[dict], str | None, list[dict], list[str]]:
    """Canonical JSON of a turn, its calls, the call it answers, the tools it declares, and issues of its own.

    Fields that are not such as the module describes are kept; a call that is
    no object (`bad_call`) or has no id (`call_without_id`) stays in the
    message but is not linked.
    """
    fields = None
    if text and text.lstrip()[:1] == "{":
        try:
            fields = parsed(text)
        except ValueError:
            fields = None
        if not isinstance(fields, dict) or not any(f in fields for f in FIELDS):
            fields = None
    if fields is None:
        return canonical({"role": role, "content": text}), [], None, [], []
    message, calls, tools, issues = fields | {"role": role, "content": fields.get("content")}, [], [], []
    if "role" in fields and fields["role"] != role:
        # the column decides; what the text says is kept
        message["text_role"] = fields["role"]
    if isinstance(fields.get("tool_calls"), list):
        message["tool_calls"] = []
        for listed in fields["tool_calls"]:
            call, shown, wrong = _call(listed)
            message["tool_calls"].append(shown)
            issues += wrong
            calls += [call] if call else []
    answer = fields.get("tool_call_id")
    answer = None if answer is None else clean(answer if isinstance(answer, str) else canonical(answer))
    if answer is not None:
        message["tool_call_id"] = answer
    if isinstance(fields.get("tools"), list):
        for tool in fields["tools"]:
            if isinstance(tool, dict) and tool.get("name") is not None:
                tools.append({"name": clean(str(tool["name"])), "schema": canonical(tool.get("parameters", {}))})
    return canonical(message), calls, answer, tools, issues


CALLS = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string()))]))
TOOLS = pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())]))
PARSED = (
    "conv_id long, turn long, role string, th long, json string, calls array<struct<id:string,name:string,arguments:string,needs:array<string>>>, answer string, "
    "tools array<struct<name:string,schema:string>>, wrong array<string>"
)


def _parse(turns: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            kinds = (pa.string(), CALLS, pa.string(), TOOLS, pa.list_(pa.string()))
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "th")), *new], names=["conv_id", "turn", "role", "th", "json", "calls", "answer", "tools", "wrong"])

    return turns.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("th"), "text").mapInArrow(run, PARSED)


def _validated(calls: DataFrame) -> DataFrame:
    """Adds `wrong`: issues of the arguments against the schema; none where there is no schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong = [judged(i, a, s) if s else [] for i, a, s in zip(*(batch.column(c).to_pylist() for c in ("id", "arguments", "schema")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wrong, pa.list_(pa.string()))], names=[*batch.schema.names, "wrong"])

    return calls.mapInArrow(run, calls.withColumn("wrong", F.array().cast("array<string>")).schema)


def topological(turn: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place (at, step) of nodes 0..n-1 whose edges run from src to dst; step is -1 on a cycle or behind one.

    A node stands at its own turn, or right behind the last node that it
    needs if that is later. All nodes whose needs are placed are placed
    together, so each node and edge is looked at once.
    """
    n = len(turn)
    order = np.argsort(src, kind="stable")
    target, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    waiting = np.bincount(dst, minlength=n)
    at, step, placed = turn.copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        placed[ready] = True
        counts = first[ready + 1] - first[ready]
        owner = np.repeat(ready, counts)
        to = target[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - first[ready], counts)]
        if len(to):
            # of several needs the latest counts
            latest = np.lexsort((step[owner], at[owner], to))
            last = latest[np.append(to[latest][1:] != to[latest][:-1], True)]
            node, need = to[last], owner[last]
            later = (at[need] > at[node]) | ((at[need] == at[node]) & (step[need] + 1 > step[node]))
            at[node] = np.where(later, at[need], at[node])
            step[node] = np.where(later, step[need] + 1, step[node])
        np.subtract.at(waiting, to, 1)
        ready = np.unique(to[waiting[to] == 0]) if len(to) else to
    step[~placed] = -1
    at[~placed] = turn[~placed]
    return at, step


def _ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, at, step of nodes (grp, node, turn) with edges (grp, src, dst); one group is in a task at a time."""
    both = nodes.select("grp", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "turn").unionByName(edges.select("grp", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("long").alias("turn")))

    def solved(part: pa.Table) -> pa.RecordBatch:
        a, ends = part["a"].to_numpy(), part["b"].combine_chunks()
        edge = ends.is_valid().to_numpy(zero_copy_only=False)
        node, turn = a[~edge], part["turn"].combine_chunks().fill_null(-(1 << 62)).to_numpy()[~edge]
        order = np.argsort(node)
        node, turn = node[order], turn[order]
        b = ends.fill_null(0).to_numpy()[edge]
        at, step = topological(turn, np.searchsorted(node, a[edge]), np.searchsorted(node, b))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(at, mask=at == -(1 << 62)), pa.array(step, pa.int32(), mask=step < 0)], names=["node", "at", "step"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            group = batch.column("grp").to_numpy()
            if len(group) and (group[0] != held[0].column("grp")[0].as_py() or group[-1] != group[0]):
                table = pa.Table.from_batches(held)
                group = table["grp"].to_numpy()
                cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
                for lo, hi in zip(np.append(0, cuts), cuts):
                    yield solved(table.slice(lo, hi - lo))
                held = table.slice(cuts[-1]).to_batches()
        held = [b for b in held if b.num_rows]
        if held:
            yield solved(pa.Table.from_batches(held))

    n = store.shuffle_partitions(nodes.sparkSession)
    return both.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(run, "node long, at long, step int")


def _by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, at, step like `_ordered`, with no group in one task: a round for each link of the longest chain."""
    placed, waiting = None, nodes.select("node", "turn")
    while waiting.head(1):
        blocked = edges.join(waiting.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        ready = waiting.join(blocked, "node", "left_anti").select("node", "turn", F.struct(F.col("turn").alias("at"), F.lit(0).alias("step")).alias("k"))
        if placed is not None:
            behind = edges.join(placed, edges.src == placed.node).groupBy("dst").agg(F.max(F.struct("at", F.expr("step + 1").alias("step"))).alias("b"))
            ready = ready.join(behind, ready.node == behind.dst, "left").select("node", "turn", F.greatest("k", "b").alias("k"))
        ready = store.table(ready.select("node", F.col("k.at").alias("at"), F.col("k.step").alias("step")), "placed")
        if not ready.head(1):
            break
        placed = ready if placed is None else placed.unionByName(ready)
        waiting = store.table(waiting.join(ready.select("node"), "node", "left_anti"), "waiting")
    rest = waiting.select("node", F.col("turn").alias("at"), F.lit(None).cast("int").alias("step"))
    return rest if placed is None else placed.unionByName(rest)


def _placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, at and step of each node (conv, node, turn) in topological order; step is null on a cycle or behind one.

    A conversation of up to GROUP turns is ordered by one task. Of a larger
    one each set of turns that calls and needs connect stands alone; a set
    that is still larger is ordered in rounds over tables.
    """
    big = nodes.groupBy("conv").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select("conv")
    big = store.table(big, "big")
    small = lambda d: d.join(big, "conv", "left_anti").withColumnRenamed("conv", "grp")
    out = _ordered(small(nodes), small(edges))
    if not big.head(1):
        return out
    nodes, edges = (d.join(big, "conv", "left_semi").drop("conv") for d in (nodes, edges))
    roots = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).checkpoint()
    rooted = nodes.join(roots, "node", "left").select("node", "turn", F.coalesce("root", "node").alias("grp"))
    linked = edges.join(roots, edges.src == roots.node).select("src", "dst", F.col("root").alias("grp"))
    huge = store.table(rooted.groupBy("grp").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select("grp"), "huge")
    out = out.unionByName(_ordered(*(d.join(huge, "grp", "left_anti") for d in (rooted, linked))))
    if huge.head(1):
        out = out.unionByName(_by_rounds(*(d.join(huge, "grp", "left_semi") for d in (rooted, linked))))
    return out


def format_chat(turns: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, turn, role, sort_turn, sort_step, n_calls, n_linked, issues, json.

    Ordered by (conv_id, sort_turn, sort_step, turn), results follow their
    calls and calls follow the results they depend on. A call is linked to
    the result with its id in its conversation; of several calls or results
    with one id the first by turn counts, the others are issues
    (`duplicate_call`, `duplicate_result`). Other issues: `unanswered`,
    `orphan_result`, `unknown_need`, `unknown_tool` (the conversation declares
    tools, but not this one), `invalid` with the path, `bad_schema`,
    `unsupported_schema`, `bad_call`, `call_without_id`, `cycle`. Of several
    declarations of one tool the least counts. Text that is not such a JSON
    object, or is nested over DEPTH deep, is content as it stands, null and
    empty ones too. Repeated rows stay repeated and count as one turn; null
    ids and turns form a conversation and a place of their own. Other columns
    are ignored. Turns without calls or results are never shuffled.
    """
    parsed = store.table(_parse(turns), "turns")
    special = F.expr("size(calls) > 0 or answer is not null or size(wrong) > 0")
    node = F.xxhash64("conv_id", "turn", "th").alias("node")
    conv = F.coalesce("conv_id", F.lit(-(1 << 63))).alias("conv")
    linked = store.table(parsed.where(special).select(node, conv, "turn", "calls", "answer", "wrong").distinct(), "calls")
    tools = parsed.select(conv, F.explode("tools").alias("t")).groupBy("conv", F.col("t.name").alias("name")).agg(F.min("t.schema").alias("schema"))
    tools = store.table(tools, "tools")
    each = linked.select("node", "conv", "turn", F.explode("calls").alias("c")).select("node", "conv", "turn", "c.*")
    first = each.groupBy("conv", "id").agg(F.min(F.struct("turn", "node")).alias("f")).select("conv", "id", F.col("f.node").alias("caller"))
    answers = linked.where("answer is not null").select("node", "conv", "turn", F.col("answer").alias("id"))
    reply = answers.groupBy("conv", "id").agg(F.min(F.struct("turn", "node")).alias("f")).select("conv", "id", F.col("f.node").alias("replier"))
    pairs = store.table(first.join(reply, ["conv", "id"], "full_outer"), "pairs")
    declared = tools.select("conv").distinct().withColumn("any", F.lit(True))
    checked = _validated(each.join(tools, ["conv", "name"], "left").join(declared, "conv", "left")).join(pairs, ["conv", "id"])
    issue = lambda when, text: F.when(when, F.array(F.concat_ws(": ", F.lit(text), "id"))).otherwise(F.array())
    needs = each.select("node", "conv", F.explode("needs").alias("id")).join(pairs, ["conv", "id"], "left")
    call_issues = checked.select(
        "node", F.lit(1).alias("calls"), F.expr("int(caller = node and replier is not null)").alias("linked"),
        F.concat(issue(F.col("caller") != F.col("node"), "duplicate_call"), issue(F.expr("caller = node and replier is null"), "unanswered"), issue(F.expr("any and schema is null"), "unknown_tool"), "wrong").alias("issues"),
    )
    answer_issues = answers.join(pairs, ["conv", "id"]).select("node", F.lit(0).alias("calls"), F.lit(0).alias("linked"), F.concat(issue(F.expr("caller is null"), "orphan_result"), issue(F.expr("replier <> node"), "duplicate_result")).alias("issues"))
    need_issues = needs.select("node", F.lit(0).alias("calls"), F.lit(0).alias("linked"), issue(F.expr("replier is null"), "unknown_need").alias("issues"))
    own_issues = linked.select("node", F.lit(0).alias("calls"), F.lit(0).alias("linked"), F.col("wrong").alias("issues"))
    edges = pairs.where("caller is not null and replier is not null").select("conv", F.col("caller").alias("src"), F.col("replier").alias("dst"))
    edges = store.table(edges.unionByName(needs.where("replier is not null").select("conv", F.col("replier").alias("src"), F.col("node").alias("dst"))).distinct(), "edges")
    placed = store.table(_placed(linked.select("conv", "node", "turn").distinct(), edges), "order")
    cycles = placed.where("step is null").select("node", F.lit(0).alias("calls"), F.lit(0).alias("linked"), F.array(F.lit("cycle")).alias("issues"))
    notes = call_issues.unionByName(answer_issues).unionByName(need_issues).unionByName(own_issues).unionByName(cycles)
    notes = notes.groupBy("node").agg(F.sum("calls").alias("n_calls"), F.sum("linked").alias("n_linked"), F.array_sort(F.flatten(F.collect_list("issues"))).alias("issues"))
    notes = store.table(notes.join(placed, "node").withColumnRenamed("node", "n"), "notes")
    for gone in (linked, tools, pairs, edges, placed):
        store.drop(gone)
    columns = ["conv_id", "turn", "role", "sort_turn", "sort_step", "n_calls", "n_linked", "issues", "json"]
    plain = parsed.where(~special).select("conv_id", "turn", "role", F.col("turn").alias("sort_turn"), F.lit(0).alias("sort_step"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_linked"), F.array().cast("array<string>").alias("issues"), "json")
    joined = parsed.where(special).select(node, "conv_id", "turn", "role", "json").join(notes, F.col("node") == F.col("n")).select("conv_id", "turn", "role", F.col("at").alias("sort_turn"), F.coalesce("step", F.lit(0)).alias("sort_step"), "n_calls", "n_linked", "issues", "json")
    return plain.unionByName(joined).select(*columns)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.withColumn("issues", F.to_json("issues"))


ORACLE_SQL = """
SELECT conv_id, turn, role, turn AS sort_turn, 0 AS sort_step, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, '[]' AS issues,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
FROM conversations
"""
