"""Piece vocabulary in a double-array trie, and lattices over many words at once.

A lattice edge is a piece that matches at a character of a word, or an unknown edge over
one character that no single piece covers. All words of a batch lie in one buffer, so
matching walks every start position in step, and the Viterbi and forward recursions run
over all words together, by end position and piece length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = b"\xe2\x96\x81"  # U+2581, the white-space marker
#: Stands for a U+2581 of the text itself; no UTF-8 text holds this byte.
ESCAPED = b"\xff"
#: Words up to so many bytes run in the vectorised recursions; longer ones one by one.
VECTOR_BYTES = 128


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a double-array trie: byte b leads from slot s to
    ``t = base[s] + b + 1`` if ``check[t] == s``; ``value[t]`` is the key's number or -1."""
    children: list[dict[int, int]] = [{}]
    number = [-1]
    for key, n in keys.items():
        at = 0
        for b in key:
            nxt = children[at].get(b + 1)
            if nxt is None:
                nxt = children[at][b + 1] = len(children)
                children.append({})
                number.append(-1)
            at = nxt
        number[at] = n
    size = 2 * len(children) + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0], low, branch = 0, 257, 1  # from 257 on every code can fill a slot
    queue = [(0, 0)]
    for node, slot in queue:
        codes = sorted(children[node])
        if not codes:
            continue
        while check[low] != -1:
            low += 1
        # single children fill the holes; branches search from a point that only moves ahead
        b = low - codes[0] if len(codes) == 1 else branch
        while any(check[b + c] != -1 for c in codes):
            b += 1
            if len(codes) < 8:
                branch = max(branch, b - 64)
        if b + 1200 > len(check):
            more = len(check)
            base += [0] * more
            check += [-1] * more
            value += [-1] * more
        base[slot] = b
        for c in codes:
            check[b + c] = slot
            value[b + c] = number[children[node][c]]
            queue.append((children[node][c], b + c))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


@dataclass
class Vocabulary:
    """Pieces by id (marker included, controls empty), log scores, byte pieces, trie."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def plain(self) -> tuple:
        """The fields, for a broadcast: workers need not have this class; ``Vocabulary(*plain)``."""
        return self.pieces, self.scores, self.byte_ids, self.base, self.check, self.value

    @property
    def unknown(self) -> int:
        """Number of unknown edges in lattices; no piece has it."""
        return len(self.pieces)

    @property
    def edge_scores(self) -> np.ndarray:
        """Log scores by piece and, last, of an unknown edge: 10 below the lowest piece."""
        return np.append(self.scores, self.scores.min() - 10.0)


def make_vocabulary(pieces: list[bytes], byte_ids: list[int], normal: list[int],
                    log_scores: dict[int, float] | None = None) -> Vocabulary:
    """``normal``: ids usable in a segmentation, best first. Without ``log_scores`` a piece
    gets the log of its Zipf probability, 1 / (rank * harmonic sum)."""
    for i in normal:
        if MARK in pieces[i].lstrip(MARK) or b"\n" in pieces[i] or b" " in pieces[i]:
            raise ValueError(f"piece {pieces[i]!r}: words must be separable at markers and line ends")
    scores = np.zeros(len(pieces))
    total = np.log(np.sum(1.0 / np.arange(1, len(normal) + 1)))
    for rank, i in enumerate(normal, 1):
        scores[i] = log_scores[i] if log_scores else -np.log(rank) - total
    other = np.ones(len(pieces), bool)
    other[normal] = False
    scores[other] = scores[normal].min()
    return Vocabulary(pieces, scores, np.array(byte_ids, np.int32), *double_array({pieces[i]: i for i in normal}))


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Read a SentencePiece model file on the driver (bounded by the vocabulary).

    The file's pieces and their order are used as they are; a BPE file holds ranks, not
    probabilities, so log scores follow Zipf's law over the ranks.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
    byte_of = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
    pieces = [b"" if special[i] else bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i)
              else m.id_to_piece(i).encode() for i in range(n)]
    normal = sorted((i for i in range(n) if not special[i] and not m.is_byte(i)), key=lambda i: (-m.get_score(i), i))
    return make_vocabulary(pieces, [byte_of[b] for b in range(256)], normal)


class Lattice:
    """All edges of a list of words (marker form, not empty)."""

    def __init__(self, vocab: Vocabulary, ws: list[bytes]):
        self.vocab, self.n = vocab, len(ws)
        raw = np.frombuffer(b"\0".join(ws) + b"\0", np.uint8)
        size = np.fromiter(map(len, ws), np.int64, len(ws))
        self.first = np.concatenate([[0], np.cumsum(size + 1)])[:-1].astype(np.int64)
        self.end_of = self.first + size
        codes = raw.astype(np.int32) + 1
        codes[self.end_of] = 0  # ends a walk
        self.raw = raw
        cut = (codes > 0) & ((raw & 0xC0) != 0x80) | (raw == 0xFF)
        cut[self.first] = True  # a word that starts inside a character (broken UTF-8) still has an edge there
        bound = np.flatnonzero(cut)
        cut[self.end_of] = True
        stop = np.flatnonzero(cut)
        width = stop[np.searchsorted(stop, bound) + 1] - bound
        s, e, ids = [], [], []
        origin, at, state = bound, bound, np.zeros(len(bound), np.int32)
        single = np.zeros(len(raw) + 1, bool)
        char_end = np.zeros(len(raw) + 1, np.int64)
        char_end[bound] = bound + width
        while len(at):
            nxt = vocab.base[state] + codes[at]
            ok = (codes[at] > 0) & (vocab.check[nxt] == state)
            origin, at, state = origin[ok], at[ok] + 1, nxt[ok]
            v = vocab.value[state]
            hit = v >= 0
            s.append(origin[hit])
            e.append(at[hit])
            ids.append(v[hit])
            single[origin[hit][at[hit] == char_end[origin[hit]]]] = True
        lone = bound[~single[bound]]
        s.append(lone)
        e.append(char_end[lone])
        ids.append(np.full(len(lone), vocab.unknown, np.int32))
        start, end, piece = np.concatenate(s), np.concatenate(e), np.concatenate(ids)
        word = np.searchsorted(self.first, start, side="right") - 1
        key = (end - self.first[word]) * 64 + np.minimum(end - start, 63)
        order = np.argsort(key, kind="stable")
        self.start, self.end, self.piece, self.word = start[order], end[order], piece[order], word[order]
        key = key[order]
        # edges of one group end at different positions, all of their starts are settled
        self.cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()

    def best(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi: (ids of all words one after the other, offsets by word, log score by word).

        Unknown edges come out as the byte pieces of their character. Of equal paths the
        one whose last differing piece is shorter wins.
        """
        top = np.full(len(self.raw) + 1, -np.inf)
        back = np.zeros(len(self.raw) + 1, np.int64)
        top[self.first] = 0.0
        gain = scores[self.piece]
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            e = self.end[a:b]
            cand = top[self.start[a:b]] + gain[a:b]
            better = cand > top[e]
            top[e[better]] = cand[better]
            back[e[better]] = a + np.flatnonzero(better)
        at, who, steps = self.end_of.copy(), np.arange(self.n), []
        while len(who):
            edge = back[at]
            steps.append((who, edge))
            at = self.start[edge]
            more = at > self.first[who]
            at, who = at[more], who[more]
        count = np.bincount(np.concatenate([w for w, _ in steps]), minlength=self.n)
        to = np.cumsum(count)
        path = np.empty(int(to[-1]), np.int64)
        for k, (w, edge) in enumerate(steps):
            path[to[w] - 1 - k] = edge
        unknown = self.piece[path] == self.vocab.unknown
        wide = np.where(unknown, self.end[path] - self.start[path], 1)
        wide[unknown & (self.raw[self.start[path]] == 0xFF)] = len(MARK)
        of = np.repeat(np.arange(len(path)), wide)
        j = np.arange(len(of)) - np.repeat(np.cumsum(wide) - wide, wide)
        first_byte = self.start[path][of]
        byte = np.where(self.raw[first_byte] == 0xFF, np.frombuffer(MARK, np.uint8)[j % len(MARK)],
                        self.raw[np.minimum(first_byte + j, len(self.raw) - 1)])
        ids = np.where(unknown[of], self.vocab.byte_ids[byte], self.piece[path][of]).astype(np.int32)
        n_ids = np.add.reduceat(wide, to - count)
        return ids, np.concatenate([[0], np.cumsum(n_ids)]), top[self.end_of]

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Sum over all segmentations of the product of edge weights; at every position.

        ``weight``: (edges,) or (edges, k) in the order of this lattice's edges.
        """
        alpha = np.zeros((len(self.raw) + 1, *weight.shape[1:]))
        alpha[self.first] = 1.0
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            alpha[self.end[a:b]] += alpha[self.start[a:b]] * weight[a:b]
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """Sum over the segmentations of what follows each position.

        Edges with equal end offset and length have different starts, so they add up one
        group at a time; descending ends settle every end before it is used.
        """
        beta = np.zeros(len(self.raw) + 1)
        beta[self.end_of] = 1.0
        for a, b in zip(reversed(self.cuts[:-1]), reversed(self.cuts[1:]), strict=True):
            beta[self.start[a:b]] += beta[self.end[a:b]] * weight[a:b]
        return beta

    def log_forward(self, log_weight: np.ndarray) -> np.ndarray:
        """``forward`` in logs, edge by edge: for words too long for plain products."""
        alpha = np.full((len(self.raw) + 1, *log_weight.shape[1:]), -np.inf)
        alpha[self.first] = 0.0
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            e = self.end[a:b]
            alpha[e] = np.logaddexp(alpha[e], alpha[self.start[a:b]] + log_weight[a:b])
        return alpha

    def log_backward(self, log_weight: np.ndarray) -> np.ndarray:
        beta = np.full(len(self.raw) + 1, -np.inf)
        beta[self.end_of] = 0.0
        for a, b in zip(reversed(self.cuts[:-1]), reversed(self.cuts[1:]), strict=True):
            s = self.start[a:b]
            beta[s] = np.logaddexp(beta[s], beta[self.end[a:b]] + log_weight[a:b])
        return beta


def by_length(ws: list[bytes], max_bytes: int = 1 << 19) -> list[np.ndarray]:
    """Positions of ``ws`` in groups of similar length and bounded total bytes, so that one
    long word doesn't stretch the recursions of many short ones."""
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    out = []
    for lo, hi in ((0, 16), (16, 48), (48, VECTOR_BYTES), (VECTOR_BYTES, 1 << 62)):
        at = np.flatnonzero((size > lo) & (size <= hi))
        if len(at):
            part = np.cumsum(size[at]) // max_bytes
            out += np.split(at, np.flatnonzero(part[1:] != part[:-1]) + 1)
    return out
