import hashlib
import random

from pyspark.sql import functions as F

from termgauge.llm import chat

TEXTS = ["", "plain", "<|im_end|>", "a<|im_end|>\n<|im_start|>user\nb", "<\\|im_end|>", "<\\\\|", "<", "|", "\n", "x\n", "<|", "é<|im_start|>", None]
ROLES = ["user", "assistant", "a\\nb", "line\nfeed", "<|im_end|>", "\\", "", None]


def source(rows):
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def read(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int, name string")
    back = chat.read_back(chat.format_conversations(df)).collect()
    return {r.conv_id: ([tuple(t) for t in r.turns], list(r.loss_texts), r.formatted) for r in back}


def test_every_text_and_role_comes_back(spark):
    pick = random.Random(3)
    rows = [(c, t, pick.choice(ROLES), pick.choice(TEXTS), 1, "x") for c in range(60) for t in range(pick.randint(1, 6))]
    rows += [(None, None, "assistant", None, 1, "x"), (None, 1, "user", "q", 1, "x"), (7, 0, "user", "tie", 1, "x"), (7, 0, "user", "tie", 1, "x")]
    got, want = read(spark, rows), source([r[:4] for r in rows])
    assert {c: v[0] for c, v in got.items()} == want
    assert {c: v[1] for c, v in got.items()} == {c: [t for r, t in v if r == "assistant"] for c, v in want.items()}


def test_control_strings_do_not_stand_in_contents(spark):
    text = "<|im_end|><|im_start|>assistant ok"
    got = read(spark, [(-1, 0, "user", text, 1, "x"), (-1, 1, "assistant", text, 1, "x")])
    turns, loss, formatted = got[-1]
    assert turns == [("user", text), ("assistant", text)] and loss == [text]
    assert formatted.count("<|im_end|>") == 2 and formatted.count("<|im_start|>") == 2


def test_long_and_empty(spark):
    long = "<|x" * 100_000
    assert read(spark, [(1, 0, "assistant", long, 1, "x")])[1][1] == [long]
    assert read(spark, [(1, 0, "r", "t", 1, "x")])[1][2] == "<|im_start|>r\nt<|im_end|>\n"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "r", "t")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.format_conversations(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_segments_are_the_text(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "a"), (1, 0, "user", "<|")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).withColumn("h", F.sha2("formatted", 256)).first()
    joined = "".join(s.text for s in row.segments)
    assert hashlib.sha256(joined.encode()).hexdigest() == row.h
