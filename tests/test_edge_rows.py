"""Literal samples whose outcome follows from the rules of the three variants."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import fixed
from colloquy.functions import messages as M
from colloquy.functions import templates as R
from colloquy.functions import text as X
from colloquy.operators import quality as Q
from colloquy.plans import prepare as P
from colloquy.schema import SAMPLE

ASK = fixed.STRICT_USER_TEXT


def U(x):
    return f"<|im_start|>user {x}<|im_end|>"


def A(x):
    return f"<|im_start|>assistant {x}<|im_end|>"


YES, NO = ("r", 10, 10), None
# id, image, turns, current prompt, strict prompt, transcript (None: dropped)
ROWS = [
    ("e01", YES, None, None, None, None),
    ("e02", YES, [], None, None, ""),
    ("e03", NO, [("human", "hi"), ("gpt", "yo")], U("\nhi") + A("\nyo"), None, None),
    ("e04", YES, [("human", "<image>\nWhat?"), ("gpt", "A cat.")],
     U("<image>\nWhat?") + A("\nA cat."), "same", "USER: <image>\nWhat?\nASSISTANT: A cat."),
    ("e05", YES, [("human", "<image>"), ("gpt", "A cat.")],
     U("<image>\n") + A("\nA cat."), U("<image>\n" + ASK) + A("\nA cat."), "USER: <image>\nASSISTANT: A cat."),
    ("e06", YES, [("human", "What <image> is it?"), ("gpt", "a<image> b")],
     U("<image>\nWhat is it?") + A("\nab"), "same", "USER: What <image> is it?\nASSISTANT: a<image> b"),
    ("e07", YES, [("human", "q"), ("gpt", "  ")], None, None, "USER: q\nASSISTANT: "),
    ("e08", YES, [("human", "q"), ("gpt", None)], None, None, None),
    ("e09", YES, [("human", None), ("gpt", "ok")],
     U("<image>\n") + A("\nok"), U("<image>\n" + ASK) + A("\nok"), None),
    ("e10", YES, [("gpt", "hello")], None, None, "ASSISTANT: hello"),
    ("e11", YES, [("system", "s"), ("user", "q"), ("assistant", "a")],
     U("<image>\nq") + A("\na"), "same", "ASSISTANT: s\nUSER: q\nASSISTANT: a"),
    ("e12", YES, [("user", "q1"), ("gpt", "a1"), ("human", "<image>q2"), ("assistant", "a2")],
     U("<image>\nq1") + A("\na1") + U("\nq2") + A("\na2"), "same",
     "USER: q1\nASSISTANT: a1\nUSER: <image>q2\nASSISTANT: a2"),
    ("e13", YES, [("user", "\xa0\x1cq　\n"), ("gpt", "\ta\x0b")],
     U("<image>\nq") + A("\na"), "same", "USER: q\nASSISTANT: a"),
    ("e14", NO, [("human", ""), ("gpt", "a")], U("\n") + A("\na"), None, None),
    ("e15", YES, [("human", "q"), ("bot", "a")], None, None, "USER: q\nASSISTANT: a"),
    ("e16", YES, [("gpt", "a0"), ("user", "q"), ("gpt", "<image>")],
     A("\na0") + U("<image>\nq"), "same", "ASSISTANT: a0\nUSER: q\nASSISTANT: <image>"),
    ("e17", NO, [("gpt", "hello")], A("\nhello"), None, None),
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(r[0], r[1], r[2]) for r in ROWS], SAMPLE)


@pytest.mark.parametrize("variant,place", [("current", 3), ("strict", 4), ("legacy", 5)])
def test_variants(samples, variant, place):
    got = {
        r["id"]: r["prompt"]
        for r in P.accept(samples, P.PrepareConfig(variant=variant))
        .withColumn("prompt", P.prompt_column(P.PrepareConfig(variant=variant)))
        .collect()
    }
    want = {r[0]: (r[3] if r[place] == "same" else r[place]) for r in ROWS if r[place] is not None}
    assert got == want


def test_reasons(samples):
    got = {v: {r["id"]: r["reject_reason"] for r in Q.quarantine(samples, v).collect()} for v in Q.VARIANTS}
    assert got["current"]["e10"] == "image_without_slot"
    assert got["current"]["e01"] == "null_conversation" and got["current"]["e02"] == "no_turns"
    assert got["legacy"]["e08"] == got["legacy"]["e09"] == "null_turn"
    assert got["strict"]["e03"] == "no_image" and got["strict"]["e10"] == "no_user_turn"
    assert got["legacy"]["e02"] is None


def test_accepted_prompts_are_aligned(samples):
    p = P.render_prompts(samples)
    assert p.where(F.col("n_slots") != F.col("image").isNotNull().cast("int")).count() == 0


def test_clean_text_equals_python(spark):
    import re

    edge = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [None, "", "<image>", "<ima<image>ge> x", "a <image>  <image>\t b ", " x ", "​x​"]
    texts += [f"{c}q{c}w{c}<image>{c}e{c}" for c in edge]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", X.clean_text("t").alias("c")).collect()}
    want = {i: re.sub(r"<image>\s*", "", (t or "").strip()).strip() for i, t in enumerate(texts)}
    assert got == want and len(edge) == 29


CHAT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField(
            "messages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("role", T.StringType()),
                        T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))),
                        T.StructField("tool_calls", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))),
                    ]
                )
            ),
        ),
        T.StructField("tools", T.ArrayType(T.StringType())),
    ]
)


def test_interleaved_chat(spark):
    t = lambda s: ("text", s)
    pic, vid = ("image", None), ("video", None)
    rows = [
        ("system_only_first", [("system", [t("S")], None), ("user", [t("q")], None), ("system", [t("late")], None)], None),
        ("two_images", [("user", [pic, t("a"), pic, vid], None), ("assistant", [t("b")], None), ("user", [pic, t("c")], None)], None),
        ("tools", [("system", [t("S")], None), ("user", [t("q")], None),
                   ("assistant", [t("x")], [("f", '{"a": 1}'), ("g", "{}")]),
                   ("tool", [t("r1")], None), ("tool", [t("r2")], None), ("assistant", [], [("h", "{}")])], ['{"n": 1}']),
    ]
    df = spark.createDataFrame(rows, CHAT)
    got = {
        r["id"]: r["p"]
        for r in df.select("id", R.render_tools("messages", "tools", add_vision_id=True).alias("p")).collect()
    }
    show, play = fixed.VISION_IMAGE, fixed.VISION_VIDEO
    assert got["system_only_first"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert got["two_images"] == (
        f"<|im_start|>user\nPicture 1: {show}aPicture 2: {show}Video 1: {play}<|im_end|>\n"
        f"<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nPicture 3: {show}c<|im_end|>\n"
    )
    assert got["tools"] == (
        "<|im_start|>system\nS\n\n" + fixed.TOOLS_HEAD + '\n{"n": 1}' + fixed.TOOLS_TAIL + "<|im_end|>\n"
        "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nx"
        '\n<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call>'
        '\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
        "<|im_start|>user\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response><|im_end|>\n"
        '<|im_start|>assistant\n<tool_call>\n{"name": "h", "arguments": {}}\n</tool_call><|im_end|>\n'
    )


def test_json_one_line(spark):
    import json

    texts = ['{"a": 1.50, "b":[1e5,1E-7, -0, -0.0, 123456789012345678901234567890, 0.1, 1e16, 1.5e300, 12345.678e2, 100.0]}']
    texts += [r'"caf\u00e9 \ud83d\ude00 \/ \u0022 \u005c \u000a \u001f \n"', '{"n": -12.25E+3, "t":true}']
    texts += ['{"a":[1,2, {"b" : "x, y: \\" z"}],\n "c":null}', "[]", '{"k":"ü \\\\"}', '"' + "a\\n" * 20000 + '"']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.json_one_line("t")).collect()]
    assert got == [json.dumps(json.loads(t), ensure_ascii=False) for t in texts]


def test_text_chat_default_system(spark):
    df = spark.createDataFrame([("a", [("user", [("text", "q")], None)], None)], CHAT)
    assert df.select(R.render_chat_text("messages")).first()[0] == (
        f"<|im_start|>system\n{fixed.DEFAULT_SYSTEM_TEXT}<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    )
    assert M.USER_FALLBACK["strict"] == ASK
