import random
import zlib

import numpy as np
import pytest

from shelfspark.llm import pieces as P
from shelfspark.llm import sentencepiece_codec as C

VOCAB = [b"", b"", b"", *[bytes([b]) for b in range(256)],
         *(s.encode() for s in ("\u2581", "a", "b", "ab", "ba", "aba", "\u2581a", "\u2581ab", "é", "éa", "\u2581\u2581", "c"))]
NORMAL = list(range(259, len(VOCAB)))


@pytest.fixture(scope="module")
def vocab():
    return P.make_vocabulary(VOCAB, list(range(3, 259)), NORMAL)


def paths(vocab, w):
    """All segmentations of a word as lists of edges, unknown characters included."""
    ids = {VOCAB[i]: i for i in NORMAL}
    cuts = [i for i in range(len(w)) if (w[i] & 0xC0) != 0x80 or w[i] == 0xFF] + [len(w)]

    def rest(k):
        if cuts[k] == len(w):
            return [[]]
        out = []
        for j in range(k + 1, len(cuts)):
            i = ids.get(w[cuts[k]:cuts[j]])
            if i is None and j == k + 1:
                i = vocab.unknown
            if i is not None:
                out += [[i, *r] for r in rest(j)]
        return out
    return rest(0)


def some_words(seed, n=60):
    r = random.Random(seed)
    return [("".join(r.choice(["a", "b", "é", "c", "x", "漢", "\u2581"]) for _ in range(r.randint(1, 9)))).encode() for _ in range(n)]


def test_trie_holds_exactly_its_keys(vocab):
    rows = {}
    for w in [VOCAB[i] for i in NORMAL] + [b"abab", b"x", "\u2581b".encode()]:
        s = 0
        for b in w:
            t = vocab.base[s] + b + 1
            s = t if vocab.check[t] == s else -1
            if s < 0:
                break
        rows[w] = int(vocab.value[s]) if s > 0 else -1
    assert all(rows[VOCAB[i]] == i for i in NORMAL)
    assert rows[b"abab"] == rows[b"x"] == rows["\u2581b".encode()] == -1


def test_viterbi_against_all_segmentations(vocab):
    ws = some_words(1) + [C.ESCAPED + b"a", b"a" * 300]
    _, _, score = C.encode_words(vocab, ws)
    for w, s in zip(ws[:-1], score, strict=False):
        assert s == pytest.approx(max(sum(vocab.edge_scores[i] for i in p) for p in paths(vocab, w)))


def test_forward_and_counts_against_all_segmentations(vocab):
    from shelfspark.llm.language_id import expected_counts, word_log_probs

    r = np.random.default_rng(0)
    log_p = np.log(r.dirichlet(np.ones(len(VOCAB) + 1), size=2)).T
    ws = some_words(2)
    got = word_log_probs(vocab, ws, log_p)
    counts = np.zeros((2, len(VOCAB) + 1))
    for n, w in enumerate(ws):
        every = paths(vocab, w)
        prob = np.array([[log_p[p, k].sum() for k in (0, 1)] for p in every])
        assert got[n] == pytest.approx(np.log(np.exp(prob).sum(axis=0)))
        share = np.exp(prob[:, n % 2] - got[n][n % 2])
        for p, s in zip(every, share, strict=True):
            np.add.at(counts[n % 2], p, 3 * s)
    lang = np.arange(len(ws)) % 2
    assert expected_counts(vocab, ws, lang, np.full(len(ws), 3.0), log_p) == pytest.approx(counts)


def test_long_words_use_logs_and_agree(vocab):
    from shelfspark.llm.language_id import word_log_probs

    log_p = np.log(np.full((len(VOCAB) + 1, 1), 1e-7))
    short, long = word_log_probs(vocab, [b"c" * 10, b"c" * 4000], log_p)[:, 0]
    assert long == pytest.approx(400 * short) and np.isfinite(long)


def test_text_round_trip(vocab):
    odd = [None, "", " ", "  a  b ", "\u2581x \u2581", "a\u2581b\n\n c\t\x00d", "🙂 naïve 執벨\x00", " \n \n", "x" * 5000 + "é" * 300, "\u2581", "\ufffd"]
    ids, to, score = C.encode_texts(vocab, odd)
    assert [C.decode_ids(vocab, ids[to[i]:to[i + 1]]) for i in range(len(odd))] == [t or "" for t in odd]
    again = C.encode_texts(vocab, odd[::-1])
    assert again[2].tolist() == score.tolist()[::-1]


def test_separability_is_checked():
    with pytest.raises(ValueError):
        P.make_vocabulary([*VOCAB, "a\u2581b".encode()], list(range(3, 259)), [*NORMAL, len(VOCAB)])


def test_codec_on_rows(spark):
    texts = ["Hello wörld, \u2581 x\n\ty", "", None, "  ", "漢字🙂"]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = C.round_trip(df).collect()
    assert len(got) == len(rows) and all(x["exact"] for x in got)
    by = {x["doc_id"]: x for x in got}
    assert by[2]["ids"] is None and by[2]["log_prob"] is None and by[1]["ids"] == [] and by[1]["log_prob"] == 0.0
    # the library's own decoder reads the ids
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=P.VOCABULARY)
    assert m.decode(by[4]["ids"]) == texts[4]
    assert C.round_trip(df.limit(0)).count() == 0
    # one pass in a worker gives what encoding and then decoding give
    plain = C.decode(C.encode(df.select("doc_id", "text"))).collect()
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert (sorted(((x["doc_id"], x["ids"], x["log_prob"], crc(x["decoded"])) for x in plain), key=repr)
            == sorted(((x["doc_id"], x["ids"], x["log_prob"], x["decoded_crc32"]) for x in got), key=repr))
    assert all(x["n_ids"] == (None if x["ids"] is None else len(x["ids"])) for x in got)
