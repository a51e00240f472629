import random
import re

from tempograph.llm.lines import drop_recurring


def keys(line):
    raw = re.findall(r"[^\x20\x09-\x0D]+", line)
    w = ["\1" if re.search("[0-9]", x) else x for x in raw]
    n, out = len(w), set()
    if n:
        out.add((n, 0, tuple(w if sum(x != "\1" for x in w) >= 3 else raw)))
    for k in (1, 2, 3) if n >= 6 else ():
        a, b = 2 + (n - 2) * (k - 1) // 3, 2 + (n - 2) * k // 3
        fixed = w[:a] + w[b:]
        if sum(x != "\1" for x in fixed) >= 3:
            out.add((n, k, tuple(fixed)))
    return out


def plain(rows):
    low = {}
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            for k in keys(line):
                low[k] = min(low.get(k, order(i)), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if all(low[k] >= order(i) for k in keys(x))]
        out.append((i, None if t is None else "\n".join(left), len(lines) if t is not None else 0, len(lines) - len(left)))
    return sorted(out, key=str)


def test_dropped_lines_equal_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("al be ga de ep ze et th io".split()) + str(rng.choice(["", "", "", 7])) for _ in range(n))
    common = [say(n) for n in (3, 4, 5, 6, 9, 15)] + ["Copyright 2024 by Ann Lee , all rights kept", "Copyright 1999 by Bob Ray , all rights kept", "1 2 3 4 5 6"]
    rows = [(None, "a b c d e"), (1, None), (2, ""), (3, "\n\n"), (4, "a b c d e"), (4, "a b c d e"), (5, "\ta  b c\rd e \nend")]
    for i in range(10, 60):
        lines = [rng.choice(common) if rng.random() < 0.3 else say(rng.randrange(12)) for _ in range(rng.randrange(9))]
        rows.append((i, "\n".join(lines)))
    rows.append((70, rows[-1][1]))
    frame = spark.createDataFrame([(*r, "é", 1) for r in rows], "doc_id long, text string, keys string, n_lines int").repartition(4)
    found = drop_recurring(frame)
    assert found.columns == ["doc_id", "text", "keys", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str) == plain(rows)


def test_variable_fields_generalise(spark):
    rows = [(1, "Posted by Ann Lee on 3 May in news"), (2, "Posted by Bob Lee on 14 May in news"), (3, "Posted by Ann Lee in news about May 3"), (4, "quite another line of words here")]
    found = {r.doc_id: r.n_dropped for r in drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 1, 3: 0, 4: 0}


def test_short_lines_go_if_they_repeat_exactly(spark):
    rows = [(1, "All rights reserved.\nPage 12\n\n7"), (2, "x\nAll rights reserved.\nPage 13\n\n7"), (3, "Page 12\nAll  rights reserved.\nAll rights"), (4, "東京都に住む")]
    found = {r.doc_id: r.text for r in drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: rows[0][1], 2: "x\nPage 13\n", 3: "All rights", 4: "東京都に住む"}


def test_planted_templates_and_own_lines(spark):
    """Of planted lines with variable fields all recurrences go; of lines of own words none does."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(10**6):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(n))
    forms = [f"{say(3)} {{n}} {say(4)}", f"{say(4)} {{w}} {say(5)}", f"{say(2)} {{n}} , {{n}} {say(2)}", say(2)]
    rows, planted = [], []
    for i in range(150):
        own = [say(rng.randrange(1, 14)) for _ in range(4)]
        known = [rng.choice(forms).replace("{n}", str(rng.randrange(10**6))).replace("{w}", say(1))]
        rows.append((i, "\n".join(own + known)))
        planted.append(known[0])
    found = drop_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kept = {r.doc_id: r.text.split("\n") for r in found}
    assert all(t.split("\n")[:4] == kept[i][:4] for i, t in rows)
    assert sum(len(k) == 5 for k in kept.values()) == len(forms)


def test_a_very_long_line_and_a_very_long_text(spark):
    line = "ab " * 300_000
    rows = [(1, line), (2, "own\n" + line + "\nrest"), (3, "x\n" * 200_000 + line.replace("ab", "ba", 1))]
    found = {r.doc_id: (r.text, r.n_dropped) for r in drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (line, 0), 2: ("own\nrest", 1), 3: (rows[2][1], 0)}


def test_empty_table(spark):
    assert drop_recurring(spark.createDataFrame([], "doc_id long, text string")).count() == 0
