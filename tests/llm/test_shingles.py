"""Shingle sets against the plain form that looked every word up and sorted all tokens of a batch together."""

import random
import time

import numpy as np
import xxhash

from helioflux.llm import ngram_join as N


def plain(texts, words):
    memo, ids, counts = {}, [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        ws = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        counts[k] = len(ws)
        for w in ws:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            ids.append(h)
    w = np.array(ids, np.uint64)
    starts = np.cumsum(counts) - counts
    h = np.zeros(len(w), np.uint64)
    for j in range(min(words, len(w))):
        h[: len(w) - j] += N._mix(w[j:], j + 1)
    h = N._mix(h, 77)
    doc = np.repeat(np.arange(len(texts)), counts)
    keep = np.arange(len(w)) - starts[doc] <= counts[doc] - words
    short = np.flatnonzero((counts > 0) & (counts < words))
    own, tok = doc[keep], h[keep]
    if len(short):
        whole = [xxhash.xxh3_64_intdigest(w[starts[k] : starts[k] + counts[k]].tobytes(), 5) for k in short]
        own, tok = np.concatenate([own, short]), np.concatenate([tok, np.array(whole, np.uint64)])
    order = np.lexsort((tok, own))
    own, tok = own[order], tok[order]
    first = np.ones(len(tok), bool)
    first[1:] = (own[1:] != own[:-1]) | (tok[1:] != tok[:-1])
    return np.searchsorted(own[first], np.arange(len(texts) + 1)), tok[first]


def texts(n, words, seed=2):
    rng = random.Random(seed)
    return [" ".join(f"W{rng.randrange(60_000):x}" for _ in range(rng.randrange(words))) for _ in range(n)]


def same(a, b):
    return all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_sets_are_those_of_the_plain_form():
    odd = [None, "", " \t\n", "one", "A b", "a B", "x " * 50, "ünï cödé \ud800 z", "a b c d e", "A B C D E f"]
    for t in (odd, [], [None], odd + texts(60, 300) + odd):
        for words in (1, 4, 5):
            assert same(N.shingle_sets(t, words), plain(t, words))


def test_sets_take_less_time_than_the_plain_form():
    t, took = texts(512, 1200), {}
    for f in (plain, N.shingle_sets) * 3:
        begin = time.process_time()
        f(t, 5)
        took[f] = min(took.get(f, 1e9), time.process_time() - begin)
    assert took[N.shingle_sets] < 0.85 * took[plain]
