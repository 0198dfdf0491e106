from eventlantern.llm import chat


def test_late_rewrites_of_early_turns_are_found():
    """From turn 200 on the first turns change at equal length; the last ones stay as they are."""
    many = [("user" if k % 2 else "assistant", f"text {k}") for k in range(300)]

    def early(t):
        out = chat.render_marked(t)
        return out if len(t) < 200 else out.replace("text 0", "TEXT 0")

    assert chat.locate(early, many)[2] == [199]


def test_every_prefix_of_a_black_box_is_rendered(spark):
    """A template that changes its output for one long prefix only."""

    def middle(turns):
        out = chat.render_marked(turns)
        return out.replace("text 3", "TEXT 3") if len(turns) == 100 else out

    many = [("user" if k % 2 else "assistant", f"text {k}") for k in range(120)]
    assert chat.locate(middle, many, None)[2] == [99, 100]
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(many)], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(rows, middle).first().rewrites == 2
    assert chat.format_conversations(rows).first().rewrites == 0
