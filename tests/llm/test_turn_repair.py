import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from shelfspark.llm import turn_repair
from shelfspark.llm.queries import damaged_conversations, op13_turn_repair
from shelfspark.llm.turn_repair import _Conversation, repair, repaired_turns

SHAPE = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else
                   "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Every edit sequence with up to two inserts in each gap, by plain enumeration."""
    kinds = faults(rows)
    best = None
    choices = []
    for (_, role, text), kind in zip(rows, kinds):
        ways = [(4, "D", None)]
        if kind not in ("blank", "duplicate"):
            extra = 3 if kind == "truncated" else 0
            ways += [(extra, "K", (role, text))] + [(3 + extra, "R", (new, text)) for new in ("user", "assistant")]
        choices.append(ways)
    gap = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    for edits in itertools.product(*choices):
        for fill in itertools.product(gap, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for k in range(len(rows) + 1):
                for role in fill[k]:
                    cost, audit = cost + 3, audit + "I"
                    turns.append((role, ""))
                if k < len(rows):
                    c, letter, turn = edits[k]
                    cost, audit = cost + c, audit + letter
                    if turn:
                        turns.append(turn)
            initials = "".join(r[:1] for r, _ in turns)
            if SHAPE.fullmatch(initials) and all(r for r, _ in turns) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
    return best


def expected(conv, rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    cost, audit, turns = brute(rows)
    kinds = faults(rows)
    ts = {t for t, _, _ in rows if t is not None}
    text = "\n".join(f"{r}:{x}" for r, x in turns)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (conv, max(ts) - min(ts) + 1 - len(ts) if ts else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), turns


def sample(n, longest, seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "Why?", "well", "", " \t", None, "é. ", "dot. \x0b\n", "same. but not", "a\nb."]
    for conv in range(n):
        for _ in range(r.randint(1, longest)):
            yield (conv, r.choice([None, 0, 1, 2, 3, 7]), r.choice(roles), r.choice(texts))


def test_against_enumeration_of_all_edits(spark):
    data = list(sample(60, 3, 5)) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yo.")]
    data += [(900, 2**60, "user", "Hi."), (900, 2**60 + 2, "assistant", "Yo.")]
    got = {r[0]: tuple(r) for r in repair(spark.createDataFrame(data, SCHEMA)).collect()}
    groups = {}
    for c, *row in data:
        groups.setdefault(c, []).append(tuple(row))
    want = {c: expected(c, rows)[0] for c, rows in groups.items()}
    assert got == want
    assert got[900][1] == 1 and got[None][7] == "KK"


def test_repaired_turns_hash_to_the_report(spark):
    data = list(sample(80, 9, 6)) + [(None, 1, "user", "Hi.")]
    df = spark.createDataFrame(data, SCHEMA)
    shas = {r["conv_id"]: r["repaired_sha256"] for r in repair(df).collect()}
    turns = {}
    for r in sorted(repaired_turns(df).collect(), key=lambda r: (r["place"], r["step"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv, sha in shas.items():
        lines = turns.get(conv, [])
        assert SHAPE.fullmatch("".join(r[0] for r, _ in lines))
        assert hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest() == sha


def test_giant_conversation_spills_its_way_back(monkeypatch):
    r = random.Random(1)
    rows = [(str(k), r.choice(["user", "assistant", "system"]), f"t{k}.", r.choice([0, 0, 3])) for k in range(5000)]

    def run(limit):
        monkeypatch.setattr(turn_repair, "SPILL", limit)
        c = _Conversation("1")
        for row in rows:
            c.feed(*row)
        out = c.report()
        assert (c.file is not None) == (limit < 20_000)
        c.close()
        return out

    assert run(64) == run(4096) == run(1 << 20)


def test_rows_dealt_over_many_batches_and_clashing_columns(spark):
    data = [(c, t, "user" if t % 2 == 0 else "assistant", f"line {t}." + "x" * (200_000 if t == 3 else 0) + ".") for c in range(3) for t in range(40)]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"conv": F.lit("x"), "fault": F.lit(1), "digest": F.lit(None), "first": F.lit(2), "place": F.lit(1)})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = repair(df).collect()
        n = repaired_turns(df).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert n == 120 and {(r["cost"], r["audit"]) for r in got} == {(0, "K" * 40)}
    assert repair(df.limit(0)).count() == 0 and repaired_turns(df.limit(0)).count() == 0


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def test_query_damages_and_returns_every_conversation(spark, tmp_path):
    r = random.Random(2)
    data = [(c, t, r.choice(["user", "assistant", None]), r.choice(["A b.", "c", None, "Why?"])) for c in range(400) for t in r.sample([None, 0, 1, 2], 2)]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    left = {}
    for c, *row in damage(data):
        left.setdefault(c, []).append(tuple(row))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: expected(c, left[c])[0] if c in left else (c, *empty) for c in {x[0] for x in data}}
    got = {x[0]: tuple(x) for x in op13_turn_repair(spark, str(tmp_path)).collect()}
    assert got == want and any(x[1:] == empty for x in want.values())
    assert damaged_conversations(spark.createDataFrame(data, SCHEMA)).where("present").count() == len(damage(data))
