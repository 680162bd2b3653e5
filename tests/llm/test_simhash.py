import random

import numpy as np
import xxhash

from itertools import combinations

from shelfspark.llm.simhash import (PAIRED, _link_entry, finer_sets, fingerprint_links, index_entries, near_duplicates, one_of_each,
                                    posted_sets, shared_bytes, simhash, tally_counts)


def brute_fp(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_fingerprint_is_the_bit_vote():
    r = random.Random(5)
    for n in (0, 1, 2, 3, 4, 9, 300):
        t = " ".join(r.choice(["Aa", "bé", "C c", "d"]) for _ in range(n))
        assert simhash(t.encode()) == brute_fp(t)
    assert simhash(None) == simhash(b" \t\n") == 0


def test_pairs_within_two_bits_in_small_and_large_entries():
    r = random.Random(2)
    for n in (5, 40, 300):
        free = [1 << b for b in (0, 3, 5, 9, 10, 14)]
        fps = sorted({sum(b for b in free if r.random() < 0.5) | 1 << 60 for _ in range(n)})[:n]
        fps = sorted(set(fps) | {fps[0] ^ 0x3F << 24})
        got = _link_entry(np.array(fps, np.uint64).view(np.int64), 2)
        want = brute_components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
        assert got.tolist() == [want[i] for i in range(len(fps))]


def test_links_reach_every_pair_of_fingerprints(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(12):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(6):
            base ^= 1 << r.randrange(64)
            if r.random() < 0.6:
                base ^= 1 << r.randrange(64)
            fps.add(base)
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    edges = fingerprint_links(spark.createDataFrame(rows, "fp long, node long"), 2).collect()
    near = {(e["a"], e["b"]) for e in edges} | {(e["b"], e["a"]) for e in edges}
    got = brute_components(range(len(fps)), lambda a, b: (a, b) in near)
    want = brute_components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == want


def test_components_on_documents(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") * 2 for _ in range(120)) for _ in range(6)]
    docs = []
    for i in range(40):
        ws = texts[i % 6].split()
        for _ in range(r.randint(0, 1)):
            ws[r.randrange(len(ws))] = "zz"
        docs.append((100 - i, " ".join(ws)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one"), (203, "one"), (None, "one")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")
    got = [(x["doc_id"], x["fingerprint"], x["component_id"]) for x in near_duplicates(df).collect()]
    fps = [brute_fp(t) for _, t in docs]
    near = brute_components(range(len(docs)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    least = lambda k: min((i for j, (i, _) in enumerate(docs) if near[j] == near[k] and i is not None), default=None)
    want = [(i, f"{fps[k]:016x}", least(k)) for k, (i, _) in enumerate(docs)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert near_duplicates(df.limit(0)).count() == 0


def test_null_ids_link_and_name_nothing(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = [(None, base), (None, base), (7, base + " x"), (None, "quite another text of its own here")]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    linked = (brute_fp(base) ^ brute_fp(base + " x")).bit_count() <= 2
    want = {f"{brute_fp(base):016x}": 7 if linked else None, f"{brute_fp(docs[3][1]):016x}": None, f"{brute_fp(docs[2][1]):016x}": 7}
    assert len(got) == 4 and all(x["component_id"] == want[x["fingerprint"]] for x in got)


def test_one_row_of_each_group_stays(spark):
    t, u, v = (" ".join(f"{c}{i}" for i in range(120)) for c in "tuv")
    docs = [(1, t), (2, t), (2, u), (3, u + " x"), (5, t), (5, t), (6, v), (6, v), (None, v), (None, None), (None, ""), (9, "own words")]
    df = spark.createDataFrame([(i, x, "n") for i, x in docs], "doc_id long, text string, component string")
    kept = sorted(((r["doc_id"], r["text"]) for r in one_of_each(df).collect()), key=repr)
    fps = [brute_fp(x) for _, x in docs]
    near = brute_components(range(len(docs)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    groups = {}
    for k, (i, x) in enumerate(docs):
        groups.setdefault(near[k], []).append((i is None, i or 0, x))
    assert len(kept) == len(groups)
    assert all(any((i is None, i or 0) == min(q[:2] for q in g) and (i is None, i or 0, x) in g for g in groups.values()) for i, x in kept)
    assert {x for _, x in kept} >= {t, v, "own words"} and any(x in (u, u + " x") for _, x in kept)
    assert one_of_each(df).columns == df.columns and one_of_each(df.limit(0)).count() == 0


def least_reached(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def signed(fps):
    return [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]


def test_long_text_crosses_the_blocks_of_the_vote():
    r = random.Random(12)
    t = " ".join(r.choice("abcdefghij") for _ in range(70_000))
    assert simhash(t.encode()) == brute_fp(t)


def test_every_pair_at_the_minimum_shares_a_posted_and_a_finer_set():
    for d in range(8):
        sets = posted_sets(d)
        for differing in combinations(range(8), d):
            same = set(range(8)) - set(differing)
            shared = [s for s in sets if same >= set(s)]
            assert shared and all(any(same >= set(f) for f in finer_sets(s, d)) for s in shared)
    assert len(posted_sets(2)) == 6 and all(len(s) == 4 for s in posted_sets(2))
    r = random.Random(1)
    x = [r.getrandbits(64) & r.getrandbits(64) & ~(0xFF << 8 * r.randrange(8)) for _ in range(200)]
    assert shared_bytes(np.array(x, np.uint64)).tolist() == [v.to_bytes(8, "little").count(0) for v in x]


def test_the_tally_rejects_pairs_that_meet(spark):
    r = random.Random(8)
    top = 0x0123456789ABCDEF
    fps = sorted({top ^ sum(1 << r.randrange(32) for _ in range(r.randint(0, 4))) for _ in range(120)})
    got = tally_counts(spark.createDataFrame(signed(fps), "fp long, node long")).collect()
    want = {}
    for entry, s in enumerate(posted_sets(2)):
        for a, b in combinations(fps, 2):
            same = [(a >> 8 * p & 255) == (b >> 8 * p & 255) for p in range(8)]
            if all(same[p] for p in s):
                met, reached, linked = want.get(entry, (0, 0, 0))
                want[entry] = (met + 1, reached + (sum(same) >= 6), linked + (sum(same) >= 6 and (a ^ b).bit_count() <= 2))
    assert {x["entry"]: (x["met"], x["reached"], x["linked"]) for x in got} == want
    met, reached, linked = (sum(w[k] for w in want.values()) for k in range(3))
    assert met > reached > linked > 0


def test_large_entries_are_dealt_anew_without_losing_a_link(spark):
    r = random.Random(9)
    # one third of the rows agree in four bytes, more than a tallied entry takes
    hot = {0xABCD_EF01 << 32 | r.getrandbits(5) << 20 | r.getrandbits(6) for _ in range(2000)}
    fps = sorted(hot | {r.getrandbits(64) for _ in range(800)})
    assert len(hot) > 2 * PAIRED
    df = spark.createDataFrame(signed(fps), "fp long, node long")
    entries, anew = index_entries(df)
    assert anew is not None and entries.groupBy("entry", "key").count().agg({"count": "max"}).first()[0] <= PAIRED
    near = {(e["a"], e["b"]) for e in fingerprint_links(df).collect()}
    x = np.array(fps, np.uint64)
    linked = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2).tolist()}
    assert least_reached(len(fps), near) == least_reached(len(fps), linked)
    assert index_entries(df.limit(0))[1] is None and fingerprint_links(df.limit(0)).count() == 0
