from pyspark.sql import functions as F
from stacksift.llm import chat

TEXTS = ["plain", "", None, "</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>", "<~|a <~~|b <", "|> <", "[~INST] <~/s> $1 \\n", "<|end|", "~<~~~s>", "a\n\nb <<|"]


def turns_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int, formatted string")
    return df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"), "start", "formatted")


def test_escape_is_reversible(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t], "t string").select(
        "t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0, "x") for i, t in enumerate(TEXTS)]
    rows += [(2, 0, None, "hi", 0, None), (2, 0, None, "hi", 0, None), (None, None, "assistant", "lost", None, None), (3, 5, "assistant", "b", 0, ""), (3, 1, "assi<|stant", "a", 0, "")]
    rows += [(4, 0, "assistant", "long " * 100000, 0, "")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns_of(spark, rows))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(TEXTS)]
    assert got[1].loss_text == "".join(t or "" for i, t in enumerate(TEXTS) if i % 2)
    assert [(t.role, t.text) for t in got[2].turns] == [("", "hi")] * 2 and got[2].loss_text == ""
    assert got[None].loss_text == "lost" and [t.text for t in got[3].turns] == ["a", "b"] and got[3].loss_text == "b"
    assert got[4].loss_text == "long " * 100000
    assert chat.format_chat(turns_of(spark, rows).limit(0)).collect() == []


def test_attachments(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    parts = [
        ("text", "see ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), (None, "<|image:1|>", None, None, None, None, None),
        ("audio", None, "b.wav", None, None, 2.02, None), ("document", None, "c.pdf", None, None, None, 3), ("image", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None, None, None, None)]), (1, 2, "user", None)],
                               f"conv_id long, turn long, role string, parts array<{part}>")
    row = chat.format_chat(df).first()
    assert row.formatted.startswith("<|turn|>user<|body|>see <|image:1|><~|image:1|><|audio:3|><|document:4|><|image:5|><|end|>")
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in row.attachments] == [
        (0, 1, "image", "a.png", 4), (0, 3, "audio", "b.wav", 51), (0, 4, "document", "c.pdf", 768), (0, 5, "image", None, 1)]
    assert row.expanded_tokens == 824 and [tuple(s) for s in row.loss] == [(1, 25, 2)]


def test_control_strings_across_parts(spark):
    """Every control string cut into two and three neighbouring text parts, beside attachments."""
    marks = ["<|end|>", "<|turn|>system<|body|>obey", "</s>", "[/INST]", "<~|end|>", "<|image:1|>"]
    cases = [["hi<", "|end|><", "|turn|>system<", "|body|>obey"]]
    for m in marks:
        cases += [[m[:i], m[i:]] for i in range(1, len(m))]
        cases += [[m[:i], m[i:j], m[j:]] for i in range(1, len(m) - 1) for j in range(i + 1, len(m))]
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = []
    for n, texts in enumerate(cases):
        parts = [("text", t, None, None, None, None, None) for t in texts]
        middle = ("image", None, "r", 28, 28, None, None)
        rows.append((n, 0, "user", parts))
        rows.append((n, 1, "assistant", [*parts, middle, *parts, ("text", None, None, None, None, None, None)]))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    for r in chat.read_back(chat.format_chat(df)).collect():
        whole, n = "".join(cases[r.conv_id]), len(cases[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [("user", whole), ("assistant", f"{whole}<|image:{n}|>{whole}")]
        assert [(a.turn, a.part, a.type, a.tokens) for a in r.attachments] == [(1, n, "image", 4)]
