import random
import re

from shelfspark.llm.quality_lines import BOILERPLATE, LineRules, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spots(line):
    """Stretches of the line that begin and end beside a character that is no letter or digit."""
    n = len(line)
    starts = [i for i in range(n) if i == 0 or not line[i - 1].isalnum()]
    return {line[i:i + len(p)] for i in starts for p in BOILERPLATE if i + len(p) == n or i + len(p) < n and not line[i + len(p)].isalnum()}


def brute(text, rules=LineRules()):
    t = text or ""
    ws = WORD.findall(t)
    win = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    twice = {i + k for i, w in enumerate(win) if win.count(w) > 1 for k in range(3)}
    real = [x for x in t.split("\n") if WORD.search(x)]

    def fails(x):
        n = len(WORD.findall(x))
        seps = len(re.findall(r"[|»«›•·→]", x))
        return (len(re.findall(r"[#*$%&<>!?]{2,}", x)) > 0.3 * n or (n >= 40 and not re.search(r"[.!?…:;,。！？؟।]", x))
                or (seps >= 2 and seps >= 0.2 * n) or (n <= 20 and any(p in spots(x.lower()) for p in BOILERPLATE)))

    bad = [x for x in real if fails(x)]
    chars = sum(map(len, ws))
    lost = sum(len(w) for x in bad for w in WORD.findall(x))
    base = len(ws) < 50 or 100 * len(twice) > 50 * len(ws)
    return (len(ws), chars, sum(c in "#*$%&|<>" for c in t), len(real) - len(set(real)), len(twice), base,
            not base and 100 * lost <= rules.max_lost_percent * chars, len(real), len(bad), lost,
            None if text is None else "\n".join(x for x in t.split("\n") if not (WORD.search(x) and fails(x))) if bad else text)


def test_against_plain_python(spark):
    r = random.Random(7)
    parts = ["the cat sat.", "Home | About | Contact", "buy!! now!! $$$ %%", "All rights reserved.", "My blog in 2019.", "They design in Berlin.", "Please log in: now", "Copyright (c) me", "cookiecutter.", "", "  ", "été  là 漢字。",
             "a b c d e f g h", "one two\tthree\x0bfour", "long " * 45]
    texts = [None, "", " \n\t", "one", "a b c a b c", "x " * 60, "\n".join(["same line here ok."] * 30)]
    texts += ["\n".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(60)]
    texts += [" ".join(r.choice("abcd") for _ in range(r.randint(1, 80))) for _ in range(30)]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[-1], "k"), (None, texts[-2], "k")]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, kept string"), keep=("kept",)).collect()
    want = [(i, *brute(t), k) for i, t, k in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_filtering_on_the_verdict_keeps_the_plan_linear(spark):
    df = spark.createDataFrame([(1, "a fine line with words.\n" * 30 + "other words here too. " * 9)], "doc_id long, text string")
    assert judge(df).where("NOT kept").count() == 1
    assert judge(df.limit(0)).count() == 0
