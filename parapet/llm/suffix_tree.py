"""Probabilistic suffix tree over byte symbols: learning from counts, and scoring by parts of them or as an automaton.

A text's symbols are the bytes of its words, SPACE between words and END after the last. Contexts
are the up to DEPTH symbols before one (7 at most: a context and the next symbol are a 64-bit key);
before a text stand DEPTH ENDs. A longer context is retained
if its next-symbol distribution diverges from that of the context one symbol shorter by more than
the description of its parameters costs. The distribution of a state is smoothed towards that of
its longest retained suffix (Witten-Bell), down to a uniform one over all 256 codes.
"""

from __future__ import annotations

import numpy as np

from parapet.llm.words import U64, Words, per_document

DEPTH = 5
SPACE, END = 0x20, 0x0A
#: A context that occurs less often is not a state.
LEAST = 4
#: What a parameter costs, in logarithms of the number of times its context occurs.
COST = 0.25
#: Symbols of the context that decide where its counts are added up.
SPLIT = 2
#: Positions that a lane of the automaton scores.
LANE = 512


def symbols(w: Words, n_docs: int, pad: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all documents of a block, where each document's begin); each is `pad` ENDs, its words, END."""
    size = w.ends - w.starts
    count = np.diff(w.first)
    # every word is followed by a space, the last by END instead; a text without words is END alone
    total = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=total[1:])
    length = total[w.first[1:]] - total[w.first[:-1]]
    length = np.where(count == 0, 1, length) + pad
    first = np.concatenate([[0], np.cumsum(length)])
    out = np.full(int(first[-1]), END, np.uint8)
    doc = np.repeat(np.arange(n_docs), count)
    at = first[:-1][doc] + pad + total[:-1] - total[w.first[:-1]][doc]
    place = np.repeat(at - w.starts, size)
    source = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.starts, size)
    out[place + source] = w.data[source]
    inner = np.ones(len(size), bool)
    inner[w.first[1:][count > 0] - 1] = False
    out[(at + size)[inner]] = SPACE
    return out, first


def windows(out: np.ndarray, first: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, next symbol) of full depth at each position from depth on, packed into 64 bits, and which of them are real."""
    key = np.zeros(max(0, len(out) - depth), U64)
    for k in range(depth + 1):
        key = (key << U64(8)) | out[k : len(key) + k].astype(U64)
    real = np.ones(len(key), bool)
    # contexts that reach back into another document end in padding, where nothing is predicted
    for k in range(1, depth + 1):
        real[(first[1:-1] - k)[first[1:-1] - k < len(key)]] = False
    return key, real


def grams(out: np.ndarray, first: np.ndarray, of: np.ndarray | None = None, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, next symbol) of full depth, packed into 64 bits, and their counts (in the documents `of` if given)."""
    key, real = windows(out, first, depth)
    if of is not None:
        real &= np.repeat(of, np.diff(first))[depth:]
    key = np.sort(key[real])
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.diff(np.append(cut, len(key)))


def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, counts added."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.add.reduceat(count, cut) if len(cut) else count


def shorter(key: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts with contexts cut to their last `depth` symbols."""
    return summed(key & U64((1 << (8 * (depth + 1))) - 1), count)


def divergent(key: np.ndarray, count: np.ndarray, parent_key: np.ndarray, parent_count: np.ndarray, depth: int, least: int = LEAST, cost: float = COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The divergence test at one depth: (contexts that pass, first of their entries and the end, gain in nats less the cost)."""
    ctx = key >> U64(8)
    cut = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(ctx))
    total = np.add.reduceat(count, cut) if len(cut) else np.zeros(0, np.int64)
    short = key & U64((1 << (8 * depth)) - 1)
    at = np.searchsorted(parent_key, short)
    p_ctx = parent_key >> U64(8)
    p_cut = np.flatnonzero(np.append(True, p_ctx[1:] != p_ctx[:-1])) if len(p_ctx) else np.zeros(0, np.int64)
    p_total = np.add.reduceat(parent_count, p_cut) if len(p_cut) else np.zeros(0, np.int64)
    of_parent = p_total[np.searchsorted(p_ctx[p_cut], short >> U64(8))]
    each = np.repeat(total, ends - cut)
    gain = count * (np.log(count / each) - np.log(parent_count[at] / of_parent))
    gain = np.add.reduceat(gain, cut) if len(cut) else gain
    gain -= cost * (ends - cut) * np.log(np.maximum(total, 1))
    keep = (gain > 0) & (total >= least)
    return ctx[cut][keep], np.stack([cut[keep], ends[keep]], 1), gain[keep]


def found(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each of `wanted` stands in sorted_keys, whether it does)."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def log_probabilities(
    wanted: np.ndarray, key: np.ndarray, count: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], depth: int = DEPTH, least: int = LEAST, cost: float = COST
) -> np.ndarray:
    """log10 probability of each of `wanted` (sorted keys of full depth) by the tree of all contexts that pass.

    key, count: the training counts of full depth of all contexts that end in the last SPLIT symbols
    of a wanted one. pairs: the whole corpus's counts of single symbols and the next, which is all
    that shorter contexts need of the rest.
    """
    level = {1: pairs, 0: shorter(*pairs, 0), depth: (key, count)}
    for d in range(depth - 1, SPLIT - 1, -1):
        level[d] = shorter(*level[d + 1], d)
    p = np.full(len(wanted), 1 / 256)
    for d in range(depth + 1):
        k, n = level[d]
        if not len(k):
            continue
        if d:
            states, entries, _ = divergent(k, n, *level[d - 1], d, least, cost)
        else:
            states, entries = np.zeros(1, U64), np.array([[0, len(k)]])
        if not len(states):
            continue
        total = np.append(0, np.cumsum(n))
        total, types = total[entries[:, 1]] - total[entries[:, 0]], entries[:, 1] - entries[:, 0]
        cut = wanted & U64((1 << (8 * (d + 1))) - 1)
        state, held = found(states, cut >> U64(8))
        at, seen = found(k, cut)
        smooth = (np.where(seen, n[at], 0) + types[state] * p) / (total[state] + types[state])
        p = np.where(held, smooth, p)
    return np.log10(p)


class Tree:
    """The states' smoothed distributions, as an automaton over symbol classes: for a corpus whose states one process holds."""

    def __init__(self, contexts: list[tuple[bytes, np.ndarray, np.ndarray]]):
        """contexts: (context, next symbols, counts) of each state; the empty context among them."""
        seen = np.zeros(256, bool)
        for _, sym, _ in contexts:
            seen[sym] = True
        used = np.flatnonzero(seen)
        #: symbols that the corpus lacks share the last class
        self.classes = np.full(256, len(used), np.int16)
        self.classes[used] = np.arange(len(used))
        a = len(used) + 1
        states = {c: (sym, n) for c, sym, n in contexts}
        self.logs: dict[bytes, np.ndarray] = {}
        uniform = np.full(a, 1 / 256)
        smooth: dict[bytes, np.ndarray] = {}
        for c in sorted(states, key=len):
            parent = uniform
            for k in range(1, len(c) + 1):
                if c[k:] in smooth:
                    parent = smooth[c[k:]]
                    break
            sym, n = states[c]
            row = parent * len(sym)
            row[self.classes[sym]] += n
            smooth[c] = row / (n.sum() + len(sym))
        smooth.setdefault(b"", uniform)
        # Aho-Corasick: a node for every prefix of a state; it scores as its longest suffix that is a state
        nodes = sorted({c[:k] for c in smooth for k in range(len(c) + 1)}, key=lambda c: (len(c), c))
        number = {c: k for k, c in enumerate(nodes)}
        self.next = np.zeros((len(nodes), a), np.int32)
        self.log = np.zeros((len(nodes), a), np.float32)
        fail = np.zeros(len(nodes), np.int64)
        children: dict[int, list[tuple[int, int]]] = {}
        for c, k in number.items():
            if c:
                children.setdefault(number[c[:-1]], []).append((int(self.classes[c[-1]]), k))
        emit = np.zeros(len(nodes), object)
        for k, c in enumerate(nodes):
            if c:
                fail[k] = next(number[c[j:]] for j in range(1, len(c) + 1) if c[j:] in number)
                self.next[k] = self.next[fail[k]]
            emit[k] = smooth[c] if c in smooth else emit[fail[k]]
            self.log[k] = np.log10(emit[k])
            for s, child in children.get(k, ()):
                self.next[k, s] = child
        self.start = 0
        for _ in range(DEPTH):
            self.start = int(self.next[self.start, self.classes[END]])

    def score(self, out: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each document's symbols (as symbols() gives them, with their padding)."""
        x = self.classes[out].astype(np.int32)
        m, a = len(x), self.next.shape[1]
        lanes = -(-m // LANE)
        padded = np.full(lanes * LANE + DEPTH, self.classes[END], np.int32)
        padded[DEPTH : DEPTH + m] = x
        grid = np.lib.stride_tricks.as_strided(padded, (LANE + DEPTH, lanes), (padded.strides[0], LANE * padded.strides[0])).copy()
        step, logs = self.next.ravel(), self.log.ravel()
        state = np.zeros(lanes, np.int32)
        got = np.empty((LANE, lanes), np.float32)
        for k in range(LANE + DEPTH):
            at = state * a + grid[k]
            if k >= DEPTH:
                got[k - DEPTH] = logs[at]
            state = step[at]
        flat = got.T.reshape(-1)[:m].astype(np.float64)
        for k in range(DEPTH):
            flat[first[:-1] + k] = 0
        return per_document(flat, first)
