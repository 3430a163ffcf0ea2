from hypothesis import given
from hypothesis import strategies as st

from presswork.llm import chat


@given(st.lists(st.tuples(st.text(), st.text()), max_size=5))
def test_escapes_are_reversible(turns):
    v = chat.Visitor(1, 1, 1)
    for role, text in turns:
        v.write(f"<turn {chat.escape(role)}>")
        v.visit({"kind": "text", "text": text, "ref": None, "amount": None}, False)
        v.write("</turn>\n")
    assert chat.read_turns("".join(v.out)) == turns


def test_parts_and_mask(spark):
    parts = "array<struct<kind:string,text:string,ref:string,amount:double>>"
    rows = [
        (1, 1, "assistant", "x", [("text", "a </turn> \\ b", None, None), ("image", None, "i.png", 2.0), (None, "end", None, None)]),
        (1, 0, "user", "look <part 0 image 9>", None),
        (1, 2, "assistant", None, None),
        (2, 0, None, "lone", [("audio", None, "s.wav", 1.5), ("document", None, "d.pdf", None), ("film", None, "f", 9.0)]),
        (None, 0, "user", "nobody's", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {parts}").withColumnRenamed("parts", "content")
    got = {r.conv_id: r for r in chat.format_conversations(df, parts="content").collect()}
    assert set(got) == {1, 2}
    one = got[1]
    assert chat.read_turns(one.formatted) == [("user", "look <part 0 image 9>"), ("assistant", "a </turn> \\ bend"), ("assistant", "")]
    assert "".join(chat.unescape(one.formatted[s.start : s.end]) for s in one.loss) == "a </turn> \\ bend"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "i.png", 512)]
    assert one.formatted[one.attachments[0].start :].startswith("<part 0 image 512>") and one.n_tokens_expanded == 512
    assert [(a.kind, a.tokens) for a in got[2].attachments] == [("audio", 38), ("document", 512), ("film", 0)]
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_query_digests(spark):
    rows = {r.conv_id: r for r in chat.op4_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len("\\### Assistant: </turn> ok")


def test_amounts_that_are_no_count(spark):
    amounts = [float("inf"), float("-inf"), float("nan"), 1e300, -1.0, 2.0]
    parts = [("audio", None, str(a), a) for a in amounts]
    df = spark.createDataFrame([(1, 0, "user", "x", parts)], f"conv_id long, turn long, role string, text string, content {chat.PART_TYPE}")
    got = chat.format_conversations(df.withColumn("turns", df.turn).withColumn("t", df.turn), parts="content").first()
    assert [a.tokens for a in got.attachments] == [0, 0, 0, 0, 0, 50] and got.n_tokens_expanded == 50


def test_a_very_long_text_and_repeated_turns(spark):
    long = "<a\\b>" * 400_000
    df = spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "user", "same"), (1, 1, "user", "same")], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).first()
    assert chat.read_turns(got.formatted) == [("assistant", long), ("user", "same"), ("user", "same")] and got.n_turns == 3
