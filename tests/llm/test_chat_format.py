"""Chat formatting: round trips, loss spans, typed parts, edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from oppflow.llm import chat_format as chat

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
HOSTILE = ["<", "\\", "|", "/", "s>", "</s>", "<s>", "[INST]", "[/INST]", "[", "<|end|>", "<|text|>", "<|role|>", "<|image|>", "x", "\n", "é", "🙂", "$0", "$1"]
PLAIN = "conv_id long, turn long, role string, text string, seq string, start string, parts string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PLAIN)


def test_escapes_round_trip_and_leave_no_control_string(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(HOSTILE, k=rng.randrange(0, 14))) for _ in range(6000)] + HOSTILE + ["</s>[INST] ok [/INST]", "<" * 5 + "\\" * 7 + "|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    bad = df.filter((chat.unescaped(F.col("e")) != F.col("t")) | F.col("e").rlike(r"<\||</?s>|\[/?INST\]"))
    assert bad.collect() == [] and df.filter("e = t").count() > 100


def brute(rows):
    out, of = {}, {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in of.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_query_on_edge_cases(spark):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "".join(rng.choices(HOSTILE, k=8))])
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a|>b"]), text()) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(100, 0, "user", "a"), (100, 0, "user", "a"), (100, 0, "assistant", "b"), (100, None, "assistant", "first"), (None, 1, "user", "z"), (None, 0, "assistant", "y"), (101, 0, "assistant", "long <|end|> [INST] " * 60000), (102, 5, "tool", None)]
    rng.shuffle(rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(rows_of(spark, rows)).collect()}
    ok = "</s>[INST] ok [/INST]"
    assert got == brute([*rows, (-7, 0, "user", ok), (-7, 1, "assistant", ok)])


def test_empty_table_has_the_added_conversation(spark):
    (row,) = chat.digest(rows_of(spark, [])).collect()
    ok = "</s>[INST] ok [/INST]"
    assert (row.conv_id, row.n_turns, row.loss_chars, row.loss_sha256) == (-7, 2, len(ok), sha(ok))
    # three breaks a text, and the marks
    assert row.formatted_chars == 2 * (len(ok) + 3 + len("<|role|><|text|><|end|>")) + len("userassistant")


@pytest.fixture(scope="module")
def typed(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see <|image|> "), part("image", ref="i1", w=56, h=57), part("text", "and"), part("text", " this"), part("audio", ref="a1", s=1.01)]),
        (1, 1, "assistant", [part("text", "one"), part("document", ref="d1", p=3), part("text", "two")]),
        (1, 2, "user", [part("hologram", "kept out", "h1"), part(None, None, None), part("image", ref="i2")]),
        (2, 0, "user", None),
        (2, 1, "assistant", []),
        (3, 0, "assistant", [part("text", None)]),
    ]
    return chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")).cache()


def test_placeholders_and_attachments(typed):
    one = typed.filter("conv = 1").first()
    assert one.formatted == "<|role|>user<|text|>see <\\|image|> <|image|><|text|>and<|text|> this<|audio|><|end|><|role|>assistant<|text|>one<|document|><|text|>two<|end|><|role|>user<|other|><|other|><|image|><|end|>"
    assert [(a.type, a.ref, a.tokens) for a in one.attachments] == [("image", "i1", 2 * 3 + 2), ("audio", "a1", 26), ("document", "d1", 3 * 768), ("other", "h1", 1), ("other", None, 1), ("image", "i2", 1)]
    assert one.attachment_tokens == 8 + 26 + 2304 + 3


def test_loss_mask_covers_trained_texts(typed):
    for row in typed.collect():
        spans = [row.formatted[s.start : s.end] for t in row.turns for s in t.spans]
        assert spans == {1: ["one", "two"], 2: [], 3: [""]}[row.conv]
        assert all(row.formatted.startswith("<|role|>", t.start) for t in row.turns)


def test_reading_gives_the_parts_back(typed):
    back = {r.conv: r for r in chat.read_back(typed).collect()}
    assert [[(p.type, p.text) for p in t.parts] for t in back[1].turns] == [
        [("text", "see <|image|> "), ("image", ""), ("text", "and"), ("text", " this"), ("audio", "")],
        [("text", "one"), ("document", ""), ("text", "two")],
        [("other", ""), ("other", ""), ("image", "")],
    ]
    assert [t.role for t in back[2].turns] == ["user", "assistant"] and [t.parts for t in back[2].turns] == [[], []]
    assert back[1].loss == "onetwo" and back[3].loss == "" and back[2].loss == ""


def test_other_roles_can_be_trained(spark):
    rows = rows_of(spark, [(1, 0, "tool", "x"), (1, 1, "assistant", "y")]).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    assert chat.read_back(chat.formatted(rows, trained=("tool",))).first().loss == "x"
