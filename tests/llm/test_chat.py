"""Chat formatting: exact read-back of everything, forged turns, odd inputs."""
import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablecraft.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def summary(spark, rows):
    out = chat.summary(chat.expand(spark.createDataFrame(rows, SCHEMA))).collect()
    return {r["conv_id"]: tuple(r)[1:5] for r in out}


def by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_examples_are_prefixes_with_one_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a</s>1"), (1, 3, "user", "u2"), (1, 4, "assistant", "a2"), (1, 5, "user", "u3")]
    ex = chat.expand(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    assert [r["n_turns"] for r in ex] == [3, 5, 6]
    assert [r["text"][r["loss_start"]:r["loss_end"]] for r in ex] == ["a<\\/s>1", "a2", ""]
    assert ex[1]["text"].startswith(ex[0]["text"]) and ex[2]["text"].startswith(ex[1]["text"])
    assert [r["last"] for r in ex] == [False, False, True]


def test_odd_inputs(spark):
    p = chat.PROBE
    rows = [
        (-7, 0, "user", p), (-7, 1, "assistant", p), (1, 0, None, None), (2, 1, "assistant", ""), (2, 0, "assistant", "\\"), (3, None, "user", "x"), (3, 0, "user", "x"),
        (3, 0, "user", "x"), (None, 0, "assistant", "é\U0001f600\n</s"), (4, 0, "a[/INST]b</s>", "<s>[INST]\\<\\s>"), (4, 1, "assistant", "y" * 200_000),
    ]
    assert summary(spark, rows) == by_hand(rows)
    assert summary(spark, []) == {}
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({"turns": F.lit(1), "ends": F.lit(2)})
    assert chat.summary(chat.expand(wide)).count() == 6


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>", "[INST]"]), st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "/INST]", "a", "\n"]), max_size=8)), min_size=20, max_size=40))
def test_any_mix_of_control_strings_is_read_back(spark, turns):
    rows = [(i % 5, i, r, "".join(t)) for i, (r, t) in enumerate(turns)]
    assert summary(spark, rows) == by_hand(rows)
