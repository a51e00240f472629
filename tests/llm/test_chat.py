import json
import random
import time

import numpy as np
import pytest

from tempograph.llm import chat
from tempograph.llm.chat import BadSchema, Unsupported, canonical, format_chat, judged, problems, read_turn, topological

SCHEMA = {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "s": {"enum": ["a", "b"]}}, "required": ["x"], "additionalProperties": False}


def call(i, name="f", arguments=None, needs=()):
    return {"id": i, "name": name, "arguments": {"x": 1} if arguments is None else arguments} | ({"depends_on": list(needs)} if needs else {})


def turn(**fields):
    return json.dumps(fields)


def run(spark, rows):
    found = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, issues string").repartition(3)).collect()
    assert len(found) == len(rows)
    return found


def test_canonical_json():
    assert canonical({"b": 1.0, "a": [1.5, float("nan"), "é\n"], "c": {"z": None, "y": True}}) == '{"a":[1.5,null,"é\\n"],"b":1,"c":{"y":true,"z":null}}'


def test_schema_problems():
    assert problems({"x": 3, "s": "a"}, SCHEMA) == []
    assert problems({"x": 2.0}, SCHEMA) == [] and problems({"x": True}, SCHEMA) == ["$.x: type"]
    assert problems({"x": -1, "s": "c", "q": 1}, SCHEMA) == ["$.x: minimum", "$.s: enum", "$.q"]
    assert problems([], SCHEMA) == ["$: type"] and problems({}, SCHEMA) == ["$.x: required"]
    assert problems(["a", 1], {"type": ["array", "null"], "items": {"type": "string", "maxLength": 0}}) == ["$[0]: maxLength", "$[1]: type"]


def test_more_keywords():
    assert problems(7, {"multipleOf": 2}) == ["$: multipleOf"] and problems(0.5, {"multipleOf": 0.25}) == []
    assert problems(3, {"exclusiveMinimum": 3, "exclusiveMaximum": 4}) == ["$: exclusiveMinimum"]
    assert problems([1, 1.0, True], {"uniqueItems": True}) == ["$: uniqueItems"] and problems([1, True, "1"], {"uniqueItems": True}) == []
    either = {"anyOf": [{"type": "string"}, {"minimum": 5}]}
    assert problems("a", either) == [] and problems(3, either) == ["$: anyOf"] and problems(3, {"not": {"type": "integer"}}) == ["$: not"]
    assert problems(6, {"oneOf": [{"type": "integer"}, {"minimum": 5}]}) == ["$: oneOf"] and problems(1, {"allOf": [{"minimum": 2}, {}]}) == ["$: allOf"]
    assert problems({}, {"minProperties": 1, "title": "t"}) == ["$: minProperties"] and problems(10**400, {"type": "integer", "minimum": 1}) == []


def test_bad_schemas_are_issues():
    for schema in ({"required": 5}, {"required": [1]}, {"properties": []}, {"minimum": "a"}, {"type": {}}, {"type": "text"}, {"enum": 5}, {"maxLength": "2"}, {"maxLength": -1}, {"anyOf": []}, {"properties": {"x": 5}}, 5, []):
        with pytest.raises(BadSchema):
            problems({"x": 1}, schema)
        assert judged("a", '{"x":1}', json.dumps(schema))[0].startswith("bad_schema: a: $")
    with pytest.raises(Unsupported):
        problems("x", {"pattern": "y"})
    assert judged("a", "1", '{"$ref":"#"}') == ["unsupported_schema: a: $: $ref"]


def test_odd_json_does_not_break_the_job(spark):
    deep = '{"content":' + "[" * 3000 + "]" * 3000 + "}"
    texts = ['{"content":"\\ud800"}', '{"content":"a\\udc00\\ud83d\\ude00"}', deep, '{"content":' + "9" * 5000 + "}", '{"content":1e999}', '{"content":1,"content":2}',
             '{"tool_calls":[{"name":"f"},5,null,{"id":"\\ud800","arguments":"{","extra":1}],"name":"n"}', '{"tool_calls":{"id":1},"tools":5,"tool_call_id":{"a":1}}', '{"role":"x","content":"c"}']
    found = {r.turn: r for r in run(spark, [(1, i, "assistant", t, "") for i, t in enumerate(texts)])}
    message = {i: json.loads(r.json) for i, r in found.items()}
    assert message[0]["content"] == "\ufffd" and message[1]["content"] == "a\ufffd😀"
    assert message[2]["content"] == deep and message[3]["content"] == texts[3] and message[4]["content"] is None and message[5]["content"] == 2
    assert message[6]["name"] == "n" and message[6]["tool_calls"] == [{"name": "f", "arguments": {}}, 5, None, {"id": "\ufffd", "name": "", "arguments": "{", "extra": 1}]
    assert found[6].issues == ["bad_call", "bad_call", "call_without_id: f", "unanswered: \ufffd"] and found[6].n_calls == 1
    assert message[7] == {"role": "assistant", "content": None, "tool_calls": {"id": 1}, "tools": 5, "tool_call_id": '{"a":1}'} and found[7].issues == ['orphan_result: {"a":1}']
    assert message[8] == {"role": "assistant", "content": "c", "text_role": "x"}


def test_long_chain_in_seconds(spark):
    rows = []
    for i in range(1000):  # each call waits for the one after it
        rows += [(1, i, "assistant", turn(tool_calls=[call(f"c{i}", needs=[f"c{i + 1}"] if i < 999 else [])]), ""), (1, 5000 - i, "tool", turn(tool_call_id=f"c{i}"), "")]
    began = time.time()
    found = run(spark, rows)
    assert time.time() - began < 60 and not any(r.issues for r in found)
    place = {(r.role, r.turn): (r.sort_turn, r.sort_step) for r in found}
    assert all(place["assistant", i] < place["tool", 5000 - i] and (i == 999 or place["tool", 5000 - i - 1] < place["assistant", i]) for i in range(1000))


def plain_order(turn, edges):
    """Places by repeated relaxation over what is not on or behind a cycle."""
    needs = {i: [s for s, d in edges if d == i] for i in range(len(turn))}
    place = {}
    while True:
        ready = [i for i in needs if i not in place and all(s in place for s in needs[i])]
        if not ready:
            return [place.get(i, (turn[i], -1)) for i in range(len(turn))]
        place |= {i: max([(turn[i], 0)] + [(place[s][0], place[s][1] + 1) for s in needs[i]]) for i in ready}


def test_topological_order_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 12)
        turn = [rng.randrange(6) for _ in range(n)]
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))})
        src, dst = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        at, step = topological(np.array(turn), src, dst)
        assert list(zip(at.tolist(), step.tolist())) == plain_order(turn, edges)


def generated(seed, conversations=12):
    """Random conversations with tool calls: (conv_id, turn, role, text)."""
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        names = [f"k{i}" for i in range(rng.randrange(1, 7))]
        if rng.random() < 0.6:
            rows.append((c, 0, "system", turn(tools=[{"name": rng.choice("fg"), "parameters": SCHEMA}])))
        for t in range(1, rng.randrange(2, 14)):
            kind = rng.random()
            if kind < 0.4:
                calls = [call(rng.choice(names), rng.choice("fgh"), {"x": rng.randrange(-2, 3)}, rng.sample(names, rng.randrange(min(3, len(names))))) for _ in range(rng.randrange(1, 3))]
                rows.append((c, t, "assistant", turn(tool_calls=calls)))
            elif kind < 0.8:
                rows.append((c, t, "tool", turn(tool_call_id=rng.choice(names), content="r")))
            else:
                rows.append((c, t, "user", "plain"))
    return rows


def plain_chat(rows):
    """The rules of format_chat in plain Python: (conv_id, turn) -> (sort_turn, sort_step, n_calls, n_linked, issues)."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(r for r in rows if r[0] == c)
        read = {r[1]: read_turn(r[2], r[3]) for r in turns}
        tools = {t["name"]: json.loads(t["schema"]) for r in read.values() for t in r[3]}
        caller, replier = {}, {}
        for t in sorted(read):
            for k in read[t][1]:
                caller.setdefault(k["id"], t)
            if read[t][2] is not None:
                replier.setdefault(read[t][2], t)
        special = [t for t in sorted(read) if read[t][1] or read[t][2] is not None]
        where = {t: i for i, t in enumerate(special)}
        edges = {(where[caller[i]], where[replier[i]]) for i in caller if i in replier}
        edges |= {(where[replier[n]], where[t]) for t in special for k in read[t][1] for n in k["needs"] if n in replier}
        order = dict(zip(special, plain_order(special, sorted(edges))))
        for t in read:
            _, calls, answer, _, _ = read[t]
            issues, linked = [], 0
            for k in calls:
                linked += caller[k["id"]] == t and k["id"] in replier
                issues += [f"duplicate_call: {k['id']}"] * (caller[k["id"]] != t) + [f"unanswered: {k['id']}"] * (caller[k["id"]] == t and k["id"] not in replier)
                issues += [f"unknown_tool: {k['id']}"] * (bool(tools) and k["name"] not in tools)
                issues += [f"invalid: {k['id']}: {p}" for p in (problems(json.loads(k["arguments"]), tools[k["name"]]) if k["name"] in tools else [])]
                issues += [f"unknown_need: {n}" for n in k["needs"] if n not in replier]
            if answer is not None:
                issues += [f"orphan_result: {answer}"] * (answer not in caller) + [f"duplicate_result: {answer}"] * (replier[answer] != t)
            at, step = order.get(t, (t, 0))
            issues += ["cycle"] * (step < 0)
            out[c, t] = (at, max(step, 0), len(calls), linked, sorted(issues))
    return out


@pytest.mark.parametrize("group", [100_000, 4, 1])
def test_generated_conversations_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(chat, "GROUP", group)
    rows = generated(group)
    found = run(spark, [(*r, "") for r in rows])
    assert {(r.conv_id, r.turn): (r.sort_turn, r.sort_step, r.n_calls, r.n_linked, r.issues) for r in found} == plain_chat(rows)


def test_plain_turns_stay_as_they_are():
    for text in (None, "", "hello", "{broken", "[1]", '{"other": 1}', "  {}", "{" * 2000):
        assert json.loads(read_turn("user", text)[0]) == {"role": "user", "content": text}


def test_linking_order_and_validation(spark):
    rows = [
        (1, 0, "system", turn(tools=[{"name": "f", "parameters": SCHEMA}]), "x"),
        (1, 1, "user", "hi", "x"),
        (1, 2, "tool", turn(tool_call_id="b", content="early"), "x"),  # before its call
        (1, 3, "assistant", turn(tool_calls=[call("a"), call("b", arguments='{"x": -5}', needs=["a"])]), "x"),
        (1, 5, "tool", turn(tool_call_id="zz"), "x"),
        (1, 7, "assistant", turn(tool_calls=[call("c", "g", needs=["b", "none"]), call("a")]), "x"),
        (1, 9, "tool", turn(tool_call_id="b", content="again"), "x"),
        (2, 0, "assistant", turn(tool_calls=[call("a", "g")], content="other conversation"), "x"),
        (2, 1, "tool", turn(tool_call_id="a"), "x"),
        (2, 1, "tool", turn(tool_call_id="a"), "x"),
        (None, None, None, None, "x"),
        (None, 1, "assistant", turn(tool_calls=[call("q")]), "x"),
    ]
    found = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    key = lambda c, t: (found[c, t].sort_turn, found[c, t].sort_step)
    assert key(1, 3) == (3, 0) and key(1, 2) == (3, 1) and key(1, 7) == (7, 0) and key(1, 1) == (1, 0)
    assert found[1, 3].n_calls == 2 and found[1, 3].n_linked == 1
    assert found[1, 3].issues == ["invalid: b: $.x: minimum", "unanswered: a", "unknown_need: a"]
    assert found[1, 5].issues == ["orphan_result: zz"] and found[1, 9].issues == ["duplicate_result: b"]
    assert found[1, 7].issues == ["duplicate_call: a", "unanswered: c", "unknown_need: none", "unknown_tool: c"]
    assert found[2, 0].issues == [] and found[2, 1].issues == [] and found[2, 0].n_linked == 1
    assert found[None, 1].issues == ["unanswered: q"]
    assert json.loads(found[1, 3].json)["tool_calls"][1] == {"id": "b", "name": "f", "arguments": {"x": -5}, "depends_on": ["a"]}


def test_chains_and_cycles(spark):
    rows = []
    for i in range(4):  # each call waits for the result of the next, which was said before it
        rows.append((1, 10 - i, "tool", turn(tool_call_id=f"c{i}"), ""))
        rows.append((1, i, "assistant", turn(tool_calls=[call(f"c{i}", needs=[f"c{i + 1}"] if i < 3 else [])]), ""))
    rows += [(2, 0, "assistant", turn(tool_calls=[call("p", needs=["q"])]), ""), (2, 1, "assistant", turn(tool_calls=[call("q", needs=["p"])]), ""), (2, 2, "tool", turn(tool_call_id="p"), ""), (2, 3, "tool", turn(tool_call_id="q"), "")]
    found = run(spark, rows)
    order = [json.loads(r.json) for r in sorted((r for r in found if r.conv_id == 1), key=lambda r: (r.sort_turn, r.sort_step, r.turn))]
    seen = []
    for m in order:
        for c in m.get("tool_calls", ()):
            assert all(f"r{n}" in seen for n in c.get("depends_on", ()))
            seen.append(c["id"])
        if "tool_call_id" in m:
            assert m["tool_call_id"] in seen
            seen.append("r" + m["tool_call_id"])
    assert len(seen) == 8
    assert all(r.issues == ["cycle"] for r in found if r.conv_id == 2)


def test_empty_table(spark):
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
