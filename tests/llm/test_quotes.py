import random

from shelfspark.llm import queries as Q
from shelfspark.llm.quotes import link_quotes
from tests.conftest import SF_SMALL

CHAT = [
    (1, 0, "a", "Shall we meet on Monday?\nOr on Tuesday?"),
    (1, 1, "b", "On Friday, a wrote:\n> Shall we meet on Monday?\n> Or on   Tuesday?\n\nMonday is fine."),
    (1, 2, "c", "> Or on Tuesday?\nTuesday, please."),
    (1, 3, "a", "> > Shall we meet on Monday?\n> > Or on Tuesday?\n> monday is FINE.\nSee you then."),
    (1, 4, "d", "Unrelated."),
    (1, 5, "d", "> words nobody said\nHm."),
    (1, 6, "b", ">>> Unrelated.\n>> See you then.\nOk."),
    (2, 0, "a", "> Unrelated.\nOther conversation."),
    (2, 1, "a", None), (2, 2, "b", ""), (2, 3, "c", "> Other conversation."), (2, 3, "c", "> Other conversation."),
    (None, 1, "a", "> Unrelated."), (3, None, "a", "lost"),
]


def test_reply_trees(spark):
    df = spark.createDataFrame([(*x, 1) for x in CHAT], "conv_id long, turn long, role string, text string, depth int")
    rows = link_quotes(df).collect()
    assert len(rows) == len(CHAT)
    got = {(x["conv_id"], x["turn"]): x for x in rows}
    parent = {k: x["parent_turn"] for k, x in got.items()}
    assert [parent[1, t] for t in range(7)] == [None, 0, 0, 1, None, None, 3]
    assert [got[1, t]["root_turn"] for t in range(7)] == [0, 0, 0, 0, 4, 5, 0]
    assert [got[1, t]["depth"] for t in range(7)] == [0, 1, 1, 2, 0, 0, 3]
    assert [got[1, t]["position"] for t in (0, 1, 3, 6, 2, 4, 5)] == [1, 2, 3, 4, 5, 6, 7]
    assert got[1, 1]["body"] == "Monday is fine." and got[1, 3]["body"] == "See you then."
    assert parent[2, 0] is None and parent[2, 3] == 0 and got[2, 3]["body"] == ""
    assert got[2, 1]["body"] is None and got[2, 2]["body"] == "" and parent[None, 1] is None
    assert sorted(x["position"] for x in rows if x["conv_id"] == 2) == [1, 2, 3, 4, 5]
    assert link_quotes(df.limit(0)).count() == 0


PARTS = [
    (1, 0, "a", "One came. Two went.\nThanks.\n\nThe second paragraph is long\nand wrapped."),
    (1, 1, "b", "Something else. Thanks."),
    (1, 2, "c", "> Two went.\nWhere to?"),
    (1, 3, "d", "> The second paragraph is\n> long and wrapped.\n> Thanks.\nIt is."),
    (1, 4, "e", "> > Two went.\n> Where to?\nHome."),
    (1, 5, "f", "> Something else.\nWhat else?"),
    (1, 6, "g", "> It is.\nIndeed."),
]


def test_sentences_and_wrapped_paragraphs(spark):
    df = spark.createDataFrame(PARTS, "conv_id long, turn long, role string, text string")
    got = {x["turn"]: x for x in link_quotes(df).collect()}
    assert [got[t]["parent_turn"] for t in range(7)] == [None, None, 0, 0, 2, 1, 3]
    # a reply's subtree stands behind it: 0 (2 (4), 3 (6)), 1 (5)
    assert sorted(got, key=lambda t: got[t]["position"]) == [0, 2, 4, 3, 6, 1, 5]
    assert [got[t]["depth"] for t in range(7)] == [0, 0, 1, 1, 2, 1, 2]


def test_reply_order_equals_a_walk(spark):
    r = random.Random(8)
    n = 120
    parent = {t: r.choice([None, *range(max(0, t - 9), t)]) if t else None for t in range(n)}
    rows = [(1, t, "u", (f"> Line {p} here.\n" if (p := parent[t]) is not None else "") + f"Line {t} here.") for t in range(n)]
    rows += [(1, n + k, "u", f"> Line {n + k - 1} here.\nLine {n + k} here.") for k in range(70)]  # a long chain
    got = {x["turn"]: x for x in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    parent |= {n + k: n + k - 1 for k in range(70)}
    assert {t: x["parent_turn"] for t, x in got.items()} == parent
    order, stack = [], [t for t in sorted(parent, reverse=True) if parent[t] is None]
    while stack:
        t = stack.pop()
        order.append(t)
        stack += [c for c in sorted(parent, reverse=True) if parent[c] == t]
    assert sorted(got, key=lambda t: got[t]["position"]) == order


def test_very_long_message(spark):
    long = " ".join(f"Word {i} stands here." for i in range(40000))
    rows = [(1, 0, "a", long), (1, 1, "b", "> Word 39999 stands here.\nSo it does."), (1, 2, "c", "> " + long + "\nAll of it.")]
    got = {x["turn"]: x["parent_turn"] for x in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: 0, 2: 0}


def test_one_line_said_and_quoted_everywhere(spark):
    rows = [(1, t, "u", "ok" if t % 2 == 0 else "> ok\nfine") for t in range(9000)]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.where("turn % 2 = 1 AND parent_turn = turn - 1").count() == 4500


def test_quoting_the_turn_before_gives_chains(spark):
    for x in Q.QUERIES["quoted_replies"](spark, SF_SMALL).collect():
        assert (x["parent_turn"], x["root_turn"], x["depth"]) == ((x["turn"] - 1, 0, x["turn"]) if x["turn"] else (-1, 0, 0))
