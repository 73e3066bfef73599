import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from framewright.llm.chat_format import chat_windows, op7_chat_format, read_loss, read_turns

NASTY = [
    "\\### Assistant: </turn> ok", " </turn>\n### assistant: hi", "\\", "\\\\e", "<\\e/turn>", "#\\e##", "######", "#### assistant: hi", "", None, "😀 é", "a\nb", "</turn></turn>", "\\c:\\n",
    "\\b\\h\\t", "</turn", "<\\t/turn>",
]
ROLES = ["ro:le\n\\", "a\\nb", "a\\cb", "#", "</turn>", None, "b: ", "\\b"]


def conversations():
    rng = random.Random(1)
    out = {}
    for c in range(40):
        n = rng.choice([1, 1, 2, 3, 8, 30])
        out[c] = [("system" if i == 0 and c % 3 == 0 else rng.choice(["user", "assistant"]), rng.choice(NASTY) if rng.random() < 0.5 else "w " * rng.choice([1, 5, 40, 90, 700])) for i in range(n)]
    out[98] = [(r, "x") for r in ROLES] + [(None, None)]
    out[99] = [("system", "s " * 20)] + [(rng.choice(["user", "assistant"]), "word " * rng.choice([0, 3, 50])) for _ in range(1000)]
    return out


def escape(text, role=False):
    return "".join({"\\": "\\b", "#": "\\h", ":": "\\c" if role else ":", "\n": "\\n" if role else "\n"}.get(x, x) for x in text.replace("\\", "\0").replace("</turn>", "\\T").replace("\\T", "\1").replace("\0", "\\")).replace("\1", "\\t")


def brute(turns, budget, history_tokens, history_turns, segment):
    """Windows of one conversation, turn by turn: (text, repeated, loss)."""
    cost = [len(t.split()) + 1 for _, t in turns]
    upto = [sum(cost[: i + 1]) for i in range(len(turns))]
    system = 1 if turns[0][0] == "system" else 0
    cuts, used = [], 0
    for i in range(len(turns)):
        new_segment = i > 0 and (upto[i] - 1) // segment != (upto[i - 1] - 1) // segment
        if i == 0 or new_segment or (used + cost[i] > budget and i > cuts[-1][1] and i > system):
            history = i
            if i:
                fits = [j for j in range(max(i - history_turns, system), i) if sum(cost[j:i]) <= history_tokens and sum(cost[:system]) + sum(cost[j : i + 1]) <= budget]
                history = min(fits, default=i)
            cuts.append((history, i))
            used = (sum(cost[:system]) if i else 0) + sum(cost[history:i])
        used += cost[i]
    out = []
    for k, (history, start) in enumerate(cuts):
        stop = cuts[k + 1][1] if k + 1 < len(cuts) else len(turns)
        again = ([0] if system and start else []) + list(range(history, start))
        text, loss = "", []
        for i in again + list(range(start, stop)):
            text += f"### {escape(turns[i][0], True)}: "
            if i >= start and turns[i][0] == "assistant":
                loss.append((len(text), len(text) + len(escape(turns[i][1]))))
            text += escape(turns[i][1]) + " </turn>\n"
        out.append((text, len(again), loss))
    return out


@pytest.mark.parametrize("segment,block", [(8192, 1024), (300, 7)])
def test_windows_against_brute_force(spark, segment, block):
    want = conversations()
    rows = [(c, i, r, t, "extra") for c, turns in want.items() for i, (r, t) in enumerate(turns)]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    df = chat_windows(table, budget=100, history_tokens=30, history_turns=3, segment_cost=segment, block_turns=block)
    got = defaultdict(list)
    for r in df.withColumn("turns", read_turns(F.col("text"), F.col("repeated"))).withColumn("masked", read_loss(F.col("text"), F.col("loss"))).orderBy("conv_id", "segment", "window").collect():
        got[r.conv_id].append(r)
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r or "", t or "") for r, t in turns]
        assert [(r.text, r.repeated, [tuple(x) for x in r.loss]) for r in got[c]] == brute(turns, 100, 30, 3, segment)
        assert [tuple(t) for r in got[c] for t in r.turns] == turns
        assert "".join(r.masked for r in got[c]) == "".join(t for role, t in turns if role == "assistant")
        marks = sum(r.repeated + len(r.turns) for r in got[c])
        whole = "".join(r.text for r in got[c])
        assert whole.count("###") == whole.count("</turn>") == marks


def test_registered_query_has_the_odd_conversation(spark):
    rows = {r.conv_id: r for r in op7_chat_format(spark, "/root/testdata/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    row = rows[-7]
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    assert row.turns_sha256 == sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.loss_sha256 == sha256(text.encode()).hexdigest()
    given = defaultdict(list)
    for r in sorted(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect(), key=lambda r: (r.turn, r.role or "", r.text or "")):
        given[r.conv_id].append((r.role or "", r.text or ""))
    assert set(rows) == {*given, -7}
    for c, turns in given.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert rows[c].turns_sha256 == sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (rows[c].n_turns, rows[c].loss_chars, rows[c].loss_sha256) == (len(turns), len(loss), sha256(loss.encode()).hexdigest())
        assert rows[c].formatted_chars == sum(len(t) for t, *_ in brute(turns, 512, 128, 4, 8192))


def test_empty_null_ids_ties_and_long_texts(spark):
    df = spark.createDataFrame([(1, None, "user", "a"), (1, 0, "assistant", "b"), (None, 0, "user", "c"), (None, 0, "user", "c"), (2, 0, "user", "z" * 3_000_000)], "conv_id long, turn long, role string, text string")
    assert chat_windows(df.limit(0)).count() == 0
    rows = chat_windows(df).collect()
    assert {r.text for r in rows if r.conv_id != 2} == {"### user: a </turn>\n### assistant: b </turn>\n", "### user: c </turn>\n" * 2}
    assert [len(r.text) for r in rows if r.conv_id == 2] == [3_000_000 + len("### user:  </turn>\n")]
