"""Chat history."""

from lectern.operators import chat

MSG = "conv_id long, turn long, role string, text string"


def test_pairs_and_append(spark):
    hist = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
                                  (1, 3, "user", "q2"), (2, 0, "user", "only")], MSG)
    assert [(r.turn, r.question, r.answer) for r in chat.chat_pairs(hist).collect()] == [(1, "q1", "a1")]
    open_q = sorted((r.conv_id, r.turn) for r in chat.open_questions(hist).collect())
    assert open_q == [(1, 3), (2, 0)]
    new = spark.createDataFrame([(1, "assistant", "a2", 0), (1, "user", "q3", 1), (3, "user", "new", 0)],
                                "conv_id long, role string, text string, seq int")
    got = sorted((r.conv_id, r.turn, r.text) for r in chat.append_messages(hist, new, "seq").collect())
    assert got == [(1, 4, "a2"), (1, 5, "q3"), (3, 0, "new")]
