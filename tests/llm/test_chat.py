from hypothesis import given, settings
from hypothesis import strategies as st

from driftspark.llm import chat

piece = st.sampled_from(["<|im_end|>", "<|im_start|>", "<|_im_end|>", "<|__im_start|>", "<|nl|>", "<|_nl|>", "\n", "<|", "|>", "im_end", "_", "é", "a b", "assistant\n"])
text = st.lists(piece, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(text, text), max_size=5))
def test_round_trip(turns):
    rendered, back = chat.format_conversation(turns)
    assert [b[:2] for b in back] == turns
    assert [chat.unescape(rendered[s:e]) for _, _, s, e in back] == [t for _, t in turns]
    if not any("<|" in x for t in turns for x in t) and not any("\n" in r for r, _ in turns):
        assert rendered == chat.render(turns)  # nothing is escaped without need


def test_table(spark):
    rows = [(1, 2, "assistant", "two", 0), (1, 1, "user", None, 0), (1, None, None, "first", 0), (None, 1, "assistant", "x<|im_end|>", 0), (2, 1, "user", "u", 0), (2, 1, "user", "u", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("", "first"), ("user", ""), ("assistant", "two")]
    assert [out[1].formatted[s.start : s.end] for s in out[1].loss_spans] == ["two"] and len(out[2].turns) == 2
    assert out[None].turns[0].text == "x<|im_end|>" and "<|_im_end|>" in out[None].formatted
    d = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert (d[1].n_turns, d[1].loss_chars, d[2].loss_chars) == (3, 3, 0)
    assert chat.format_chats(df.where("false")).count() == 0
