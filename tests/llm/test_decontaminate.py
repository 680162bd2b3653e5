import random

import numpy as np

from shelfspark.llm import decontaminate as D


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for c in pattern:
        nxt = [row[0] + 1]
        for j, t in enumerate(text, 1):
            nxt.append(min(row[j - 1] + (c != t), row[j] + 1, nxt[-1] + 1))
        row = nxt
    return min(row)


def word(r):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyzé漢") for _ in range(r.randint(2, 8)))


def test_finds_exactly_the_segments_within_budget():
    r = random.Random(3)
    items = [(k, " ".join(word(r) for _ in range(r.choice([6, 25, 40])))) for k in range(8)]
    texts = [None, "", "short"]
    for n in range(60):
        item = list(D.normalise(r.choice(items)[1]))
        a = r.randrange(max(1, len(item) - 90))
        part = item[a:a + r.randint(60, 130)]
        for _ in range(r.choice([0, 0, 2, 5, 9, 14])):
            p = r.randrange(len(part))
            part[p:p + 1] = r.choice([[], ["q"], ["q", part[p]]])
        around = lambda: " ".join(word(r) for _ in range(r.randrange(0, 30)))
        texts.append((around() + " " + "".join(part).upper() + "\n " + around()) if n % 2 else "".join(part))
    index = D.Index(items, D.Leak())
    got = index.search(texts)
    for t, found in zip(texts, got, strict=True):
        plain = D.normalise(t or "")
        have = {(x["item_id"], x["offset"]): x["edits"] for x in found}
        want = {}
        for (item, offset, s), k in zip(index.segments, index.k, strict=True):
            d = edit_distance_within(s, plain)
            if d <= k:
                want[item, offset] = d
        assert have.keys() == want.keys()
        assert all(have[x] >= want[x] for x in want)


def test_bound_is_met_by_any_text_within_budget():
    index = D.Index([(1, "the quick brown fox jumps over the lazy dog and then goes home to sleep for the night, quite tired.")], D.Leak())
    assert (index.bound >= 1).all() and (index.k == 6).all()
    assert np.all(index.bound == 80 - D.Q + 1 - 6 * D.Q)


def test_rows_blocks_and_edges(spark):
    passage = "It was a bright cold day in April, and the clocks were striking thirteen; the hall smelt of cabbage and old mats."
    other = "Call me Ishmael. Some years ago, never mind how long precisely, having little or no money in my purse, I sailed."
    bench = spark.createDataFrame([(1, passage), (2, other), (2, other), (3, None), (4, "tiny"), (None, other)], "item_id long, text string")
    rows = [(1, "x " + passage + " y", 1), (2, None, 1), (3, "", 1), (4, "clean words only here", 1), (5, other.upper() + passage, 1),
            (1, "x " + passage + " y", 1), (None, passage, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    for rules in (D.Leak(), D.Leak(block_chars=60)):
        pairs = {(x["doc_id"], x["item_id"]) for x in D.leaked_pairs(df, bench, rules=rules).collect()}
        assert pairs == {(1, 1), (5, 1), (5, 2), (None, 1)}
        kept = D.without_leaks(df, bench, rules=rules)
        assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == [2, 3, 4]
    assert D.leaked_pairs(df, bench.limit(0)).count() == 0 and D.leaked_pairs(df.limit(0), bench).count() == 0


def test_passages_cut_at_any_offset():
    r = random.Random(11)
    item = " ".join(word(r) for _ in range(80))[:394]
    index = D.Index([(7, item)], D.Leak())
    for a in range(0, len(item) - 80, 13):
        for n in (80, 100, 119):
            part = D.normalise(item[a:a + n])
            found = index.search(["zzz zz " + part + " yyy yy"])[0] if len(part) >= 80 else [{"edits": 0}]
            assert any(x["edits"] == 0 for x in found), (a, n)


def test_short_texts_between_leaks():
    r = random.Random(5)
    item = " ".join(word(r) for _ in range(40))[:80].strip().ljust(80, "x")
    index = D.Index([(1, item)], D.Leak())
    for short in (None, "", " ", "a", "abc"):
        for shift in range(14):
            texts = ["w" * shift, short, item, short, short, "q " + item, short, item]
            found = index.search(texts)
            assert [[x["edits"] for x in f][:1] for f in found] == [[], [], [0], [], [], [0], [], [0]], (short, shift)
            alone = {id(t): index.search([t])[0] for t in texts}
            key = lambda f: {(x["offset"], x["edits"], x["at"]) for x in f}
            assert all(key(f) == key(alone[id(t)]) for t, f in zip(texts, found, strict=True) if t is item)


def test_short_items_as_whole_words():
    r = random.Random(6)
    items = [(k, t) for k, t in enumerate(["yes", "No", "a b", "1 + 1", "seven", "Yes", "", "  ", " x\ty "])]
    index = D.Index(items, D.Leak())
    texts = [None, "", "yes", "yesterday", " ".join(r.choice(["yes", "no", "a", "b", "1", "+", "x", "y", "seventh"]) for _ in range(200)), "b a", "a  B"]
    for t, found in zip(texts, index.search(texts), strict=True):
        plain = D.normalise(t or "")
        want = {(i, f" {plain} ".find(f" {D.normalise(x)} ")) for i, x in items if D.normalise(x) and f" {D.normalise(x)} " in f" {plain} "}
        assert {(x["item_id"], x["at"]) for x in found} == want


def test_short_items_are_named_but_drop_nothing(spark):
    bench = spark.createDataFrame([(1, "yes"), (2, "no way"), (3, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, "Oh yes."), (2, "yes it is"), (3, "there is No  way out")], "doc_id long, text string")
    for rules in (D.Leak(), D.Leak(block_chars=4)):
        assert {(x["doc_id"], x["item_id"]) for x in D.leaked_pairs(df, bench, rules=rules).collect()} == {(2, 1), (3, 2)}
        assert D.without_leaks(df, bench, rules=rules).count() == 3


def test_very_long_text():
    r = random.Random(9)
    item = " ".join(word(r) for _ in range(60))
    filler = " ".join(word(r) for _ in range(300_000))
    found = D.Index([(1, item)], D.Leak()).search([filler + " " + item + " " + filler, filler])
    assert found[0] and not found[1]
