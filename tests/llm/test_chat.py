import hashlib
import random
import re

import pytest

from askbook.llm import chat as C

ODD = ["\\### Assistant: </turn> ok", "</turn>", "###", "####", "#####\\", "<\\/turn>", "#\\##", "\\", "\\\\", "a</turn>\n### user: b", "", ": x", "#\\\\##", "</turn></turn>######", "é漢🙂" * 5, "\\\\</turn>", "<<//turn></turn>"]


def size(text):
    return len(re.findall(C.TOKEN, text)) + C.MARKS


def plain(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


@pytest.mark.parametrize("budget,history", [(2048, 256), (400, 40), (60, 12)])
def test_reads_back(spark, budget, history):
    r = random.Random(3)
    rows = [(-7, 0, "user", ODD[0]), (-7, 1, "assistant", ODD[0]), (1, None, "user", "no number"), (None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (2, 0, None, None), (2, 0, "assistant", None), (3, 5, "a: b:", "x"), (3, 5, "a: b:", "x"), (3, 6, "\\: ### </turn>", "y")]
    for c in range(10, 40):
        for t in range(r.randint(1, 30)):
            rows.append((c, t, "system" if r.random() < 0.05 or (t == 0 and c % 2) else r.choice(["user", "assistant"]), r.choice([r.choice(ODD), "word " * r.randint(0, 40)])))
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} " + r.choice(ODD)) for t in range(900)]
    turns = spark.createDataFrame([x + (1,) for x in rows], "conv_id bigint, turn bigint, role string, text string, window int")
    windows = C.format_windows(turns, budget, history)
    want = plain(rows)
    got = {x.conv_id: x for x in C.digest(windows).collect()}
    assert set(got) == set(want)
    for conv, said in want.items():
        loss = "".join(t for role, t in said if role == "assistant")
        assert got[conv].n_turns == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    spent = []
    for w in C.read_windows(windows).collect():
        said, first = want[w.conv_id], w.first_turn
        assert [(t.role, t.text) for t in w.turns] == said[first : first + len(w.turns)]
        parts = w.formatted.split(C.END)[:-1]
        assert len(parts) == w.n_turns == w.n_repeated + len(w.turns)
        systems = [i for i, (role, _) in enumerate(said) if role == "system"]
        retained = size(said[systems[0]][1]) if systems else 0
        own = sum(size(t) for _, t in said[first : first + len(w.turns)])
        # As many turns before it as history and budget leave room for.
        again, left = first, min(history, max(0, budget - retained - own))
        while again and sum(size(t) for _, t in said[again - 1 : first]) <= left:
            again -= 1
        ahead = bool(systems) and systems[0] < again
        assert w.n_repeated == first - again + ahead
        if ahead:
            assert parts[0].startswith("### system: ")
        whole = own + sum(size(t) for _, t in said[again:first]) + retained * ahead
        assert whole <= max(budget, retained + max(size(t) for _, t in said[first : first + len(w.turns)]))
        spent.append(whole)
    if budget == 60:
        assert got[99].n_windows > 50
    elif budget == 400:
        assert sum(spent) > 0.6 * budget * len(spent)


@pytest.mark.parametrize("sizes", [[800, 1500], [1500, 800, 900, 900, 10, 2100, 5], [890] * 40, [10] * 2000, [5, 1000] * 300, [300, 2, 2, 1700] * 60])
@pytest.mark.parametrize("system", [0, 50, 1200, 2040])
def test_no_window_passes_the_budget_unless_a_turn_does(spark, sizes, system):
    rows = [(1, i + 1, "assistant" if i % 2 else "user", "w " * (n - C.MARKS)) for i, n in enumerate(max(x, C.MARKS) for x in sizes)] + ([(1, 0, "system", "s " * (system - C.MARKS))] if system else [])
    for w in C.format_windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect():
        parts = [size(x.split(": ", 1)[1]) for x in w.formatted.split(C.END)[:-1]]
        assert sum(parts) <= max(2048, system + max(parts[w.n_repeated :]))


def test_no_text_holds_a_mark(spark):
    texts = ["#" * n + " Assistant: hi" for n in range(1, 14)] + ["é🙂#### user: a\n##### user: b", "#\\### user: c", "####</turn>#### user: d"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select("text", C.escape(frame.text).alias("written"), C.unescape(C.escape(frame.text)).alias("back")).collect():
        assert "### " not in r.written and "</turn>" not in r.written and r.back == r.text
        assert len(r.written) == len(r.text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("###", "#\\##"))  # as the SQL counts


def test_history_is_repeated_and_masked(spark):
    turns = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"say {t}") for t in range(40)], "conv_id bigint, turn bigint, role string, text string")
    windows = C.format_windows(turns, 60, 12).orderBy("window").collect()
    assert len(windows) > 5 and all(w.n_repeated == 2 for w in windows[1:])
    for w in windows:
        spans = [w.formatted[s.start : s.start + s.length] for s in w.loss_spans]
        own = w.formatted.split(C.END)[w.n_repeated : -1]
        assert spans == [x.split(": ", 1)[1] for x in own if x.startswith("### assistant")]


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.digest(C.format_windows(none)).count() == 0


def test_no_python_in_plan(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = C.digest(C.format_windows(turns))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
