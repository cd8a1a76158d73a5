"""N-gram Jaccard join: signature trees with dual traversal, over blocks that no link leaves.

A text is the set of its distinct word n-grams, as 64-bit hashes. Texts of equal sets form a class; one member stands for
it. Classes are dealt into blocks by an exact partition of the token space (``part_keys``), and every block becomes a
signature tree: leaves are texts, nodes hold the OR of their token bitmaps, their size range, the most tokens that share
a bit, and the component where all their texts have one. A dual traversal drops node pairs whose maximum possible
overlap or sizes rule out a link, or that are one component already; the pairs of leaves left are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table

WORDS = 5
THRESHOLD = 80
#: Tokens that one task holds at once; larger blocks are dealt over several.
BLOCK_TOKENS = 2_000_000
FANOUT = 8


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct n-gram hashes of each text, one after another.

    A-Z are lower-cased and words are runs of characters other than ASCII white space. A text with fewer words is one
    shingle, its whole sequence; a text without words, or null, has the empty set.
    """
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        ws = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        counts[k] = len(ws)
        hashes.extend(map(xxhash.xxh3_64_intdigest, ws))  # hashing anew costs less than looking a word up
    w = np.array(hashes, np.uint64)
    starts = np.cumsum(counts) - counts
    h = np.zeros(len(w), np.uint64)
    for j in range(min(words, len(w))):  # starts whose n-gram leaves the text are left out below
        h[: len(w) - j] += _mix(w[j:], j + 1)
    h = _mix(h, 77)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(w)) - starts[doc]
    keep = place <= counts[doc] - words
    short = np.flatnonzero((counts > 0) & (counts < words))
    own, tok = doc[keep], h[keep]
    if len(short):
        whole = [xxhash.xxh3_64_intdigest(w[starts[k] : starts[k] + counts[k]].tobytes(), 5) for k in short]
        own, tok = np.concatenate([own, short]), np.concatenate([tok, np.array(whole, np.uint64)])
        order = np.argsort(own, kind="stable")
        own, tok = own[order], tok[order]
    ends = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(ends, ends[1:]):  # many short sorts take half the time of one by (own, tok)
        tok[a:b].sort()
    first = np.ones(len(tok), bool)
    first[1:] = (own[1:] != own[:-1]) | (tok[1:] != tok[:-1])
    own, tok = own[first], tok[first]
    return np.searchsorted(own, np.arange(len(texts) + 1)), tok


def least_overlap(n, m, t: int):
    """The least intersection of sets of n and m elements with 100 * |∩| >= t * |∪|."""
    return -(-(t * (n + m)) // (100 + t))


def _levels() -> np.ndarray:
    return np.unique(np.ceil(2 ** (np.arange(0, 90) / 2)).astype(np.int64))


def part_keys(offsets: np.ndarray, tokens: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) rows such that two texts linked at Jaccard t / 100 share a key.

    Linked sets of at most y elements differ in at most 2 y (100 - t) / (100 + t) tokens. A scheme, chosen by the size
    of the larger set, deals all tokens by hash into more parts than that; a token that differs spoils one part, so
    enough parts are equal, and by the prefix principle one of them is among the first k + 1 of either text, in the order
    of part size (largest first) and then signature. A part's signature covers several tokens of the text, so a
    passage or word that very many texts share makes no key that many texts share, short of copies. Only texts of so few
    tokens that fewer parts hold some than the prefix is long use tokens themselves as keys.
    """
    n = np.diff(offsets)
    bounds = _levels()
    level = np.searchsorted(bounds, n, "right") - 1
    above = np.searchsorted(bounds, 100 * n // t, "right") - 1
    k = (n + 100 * n // t) * (100 - t) // (100 + t)
    docs, keys = [], []
    for use, lev in ((n > 0, level), ((n > 0) & (above != level), above)):
        who = np.flatnonzero(use)
        if not len(who):
            continue
        top = bounds[np.minimum(lev[who] + 1, len(bounds) - 1)] - 1
        parts = 2 * top * (100 - t) // (100 + t) * 5 // 4 + 1
        size = n[who]
        at = np.repeat(offsets[who] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        tok = tokens[at]
        row = np.repeat(np.arange(len(who)), size)
        salt = lev[who][row].astype(np.uint64)
        part = (_mix(tok ^ (salt << np.uint64(56)), 3) % parts[row].astype(np.uint64)).astype(np.int64)
        base = np.cumsum(parts) - parts
        cell = base[row] + part
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sig = np.add.reduceat(_mix(tok[order], 5), starts)
        held = np.diff(np.r_[starts, len(cell)])
        r = row[order][starts]
        cell = cell[starts] - base[r]
        sig = _mix(sig ^ _mix(cell.astype(np.uint64) ^ (lev[who][r].astype(np.uint64) << np.uint64(40)), 9), 11)
        order = np.lexsort((sig, -held, r))
        r, sig = r[order], sig[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank <= k[who][r]
        docs.append(who[r[keep]])
        keys.append(sig[keep])
        # Two texts that both fill fewer parts than the prefix is long may share empty parts only. They share a token of
        # their prefixes in the order of the tokens, n - ceil(t n / 100) + 1 long.
        filled = np.bincount(r, minlength=len(who))
        thin = np.flatnonzero(filled < k[who] + 1)
        if len(thin):
            length = size[thin] + (-t * size[thin] // 100) + 1
            at = np.repeat(offsets[who[thin]] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            docs.append(np.repeat(who[thin], length))
            keys.append(_mix(tokens[at] ^ _mix(np.repeat(lev[who[thin]], length).astype(np.uint64), 13), 17))
    return (np.concatenate(docs), np.concatenate(keys)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = nxt
                return nxt
            up = nxt


class SignatureTree:
    """Levels of nodes over texts in a given order; level 0 holds the texts."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, order: np.ndarray) -> None:
        self.order = order
        spare = sizes - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits[order], sizes[order], sizes[order], spare[order], labels[order])]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sp, lab = self.levels[-1]
            cut = np.arange(0, len(b), FANOUT)
            same = np.minimum.reduceat(lab, cut) == np.maximum.reduceat(lab, cut)
            up = np.where(same & (np.minimum.reduceat(lab, cut) >= 0), lab[cut], -1)
            self.levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(sp, cut), up))


def node_pairs(a: SignatureTree, b: SignatureTree, t: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: pairs of texts (positions) that no bound rules out, in batches; ``same``: a is b, each pair once."""
    top = max(len(a.levels), len(b.levels))
    stack = [(top - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, i, j = stack.pop()
        la, lb = min(depth, len(a.levels) - 1), min(depth, len(b.levels) - 1)
        ba, loa, hia, spa, laba = a.levels[la]
        bb, lob, hib, spb, labb = b.levels[lb]
        ok = (100 * hia[i] >= t * lob[j]) & (100 * hib[j] >= t * loa[i]) & ~((laba[i] == labb[j]) & (laba[i] >= 0))
        i, j = i[ok], j[ok]
        least = np.maximum(least_overlap(loa[i] + 0, lob[j], t), 1)
        most = np.bitwise_count(ba[i] & bb[j]).sum(axis=1) + np.minimum(spa[i], spb[j])
        ok = np.minimum(most, np.minimum(hia[i], hib[j])) >= least
        i, j = i[ok], j[ok]
        if depth == 0:
            if len(i):
                yield i, j
            continue
        fa = FANOUT if la == depth else 1
        fb = FANOUT if lb == depth else 1
        na, nb = len(a.levels[min(depth - 1, len(a.levels) - 1)][0]), len(b.levels[min(depth - 1, len(b.levels) - 1)][0])
        ci = (i[:, None, None] * fa + np.arange(fa)[None, :, None] + np.zeros((1, 1, fb), np.int64)).ravel()
        cj = (j[:, None, None] * fb + np.arange(fb)[None, None, :] + np.zeros((1, fa, 1), np.int64)).ravel()
        ok = (ci < na) & (cj < nb)
        if same:
            ok &= (ci < cj) if depth == 1 else (ci <= cj)
        ci, cj = ci[ok], cj[ok]
        for s in range(0, len(ci), 4096):
            stack.append((depth - 1, ci[s : s + 4096], cj[s : s + 4096]))


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def block_links(offsets: np.ndarray, tokens: np.ndarray, t: int, labels: np.ndarray | None = None, other: np.ndarray | None = None) -> Forest:
    """Union-find of the texts of a block under links; with ``other``, of links between texts marked and unmarked.

    First some texts are compared with all others: the links of a group of near copies come from its first member, and
    their pairs are never made. That stops as soon as a text gathers few. The signature tree, ordered by the components
    found, gives every pair of different components that may still link.
    """
    count = len(offsets) - 1
    sizes = np.diff(offsets)
    f = Forest(count)
    if labels is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            f.join(i, first.setdefault(int(x), i))
    if count < 2:
        return f
    row = np.repeat(np.arange(count), sizes)
    if count > 16 and other is None:
        tried = np.zeros(count, bool)
        while True:
            lab = f.labels()
            heads = np.flatnonzero(~tried & (lab == np.arange(count)) & (np.bincount(lab, minlength=count) == 1)) if tried.any() else np.flatnonzero(~tried)
            if not len(heads):
                break
            p = heads[0]
            tried[p] = True
            mine = tokens[offsets[p] : offsets[p + 1]]
            hit = np.zeros(count, np.int64)
            at = np.searchsorted(mine, tokens)
            at[at == len(mine)] = 0
            np.add.at(hit, row[mine[at] == tokens], 1)
            linked = np.flatnonzero((100 + t) * hit >= t * (sizes + sizes[p]))
            for q in linked:
                f.join(int(p), int(q))
            if len(linked) < max(4, count // 32):
                break
    lab = f.labels()
    width = max(64, 1 << int(4 * sizes.max() - 1).bit_length()) if sizes.max() else 64
    width = min(width, 1 << 15)
    bits = np.zeros((count, width // 64), np.uint64)
    spot = _mix(tokens, 21) % np.uint64(width)
    np.bitwise_or.at(bits, (row, (spot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (spot & np.uint64(63)))
    low = np.minimum.reduceat(tokens, np.minimum(offsets[:-1], len(tokens) - 1)) if len(tokens) else np.zeros(count, np.uint64)
    if other is None:
        order = np.lexsort((low, sizes, lab))
        tree = SignatureTree(bits, sizes, lab, order)
        pairs, left, right = node_pairs(tree, tree, t, True), order, order
    else:
        left, right = np.flatnonzero(other), np.flatnonzero(~other)
        if not len(left) or not len(right):
            return f
        left, right = left[np.lexsort((low[left], sizes[left], lab[left]))], right[np.lexsort((low[right], sizes[right], lab[right]))]
        pairs = node_pairs(SignatureTree(bits, sizes, lab, left), SignatureTree(bits, sizes, lab, right), t, False)
    for i, j in pairs:
        for p, q in zip(left[i], right[j], strict=True):
            if f.find(int(p)) != f.find(int(q)):
                if (100 + t) * _overlap(tokens[offsets[p] : offsets[p + 1]], tokens[offsets[q] : offsets[q + 1]]) >= t * int(sizes[p] + sizes[q]):
                    f.join(int(p), int(q))
    return f


def _profile(words: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                offsets, tok = shingle_sets(b.column(1).to_pylist(), words)
                n = np.diff(offsets)
                fp = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
                full = np.flatnonzero(n)
                if len(full):
                    for k in (0, 1):
                        fp[k][full] = np.add.reduceat(_mix(tok, 31 + k), offsets[:-1][full]).view(np.int64)
                docs, keys = part_keys(offsets, tok, t)
                order = np.argsort(docs, kind="stable")
                ends = np.searchsorted(docs[order], np.arange(len(n) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(fp[0]), pa.array(fp[1]), lists], ["id", "n", "fp", "fp2", "keys"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, id) sorted by both: (id, first id of its key), for ids that are not first. Holds one batch."""
    key, head = None, None
    for b in batches:
        k, i = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        new = np.r_[True, k[1:] != k[:-1]]
        starts = np.flatnonzero(new)
        heads = i[starts]
        if key is not None and k[0] == key:
            heads = heads.copy()
            heads[0] = head
        first = heads[np.cumsum(new) - 1]
        key, head = k[-1], first[-1]
        keep = i != first
        pairs = pd.DataFrame({"a": i[keep], "b": first[keep]}).drop_duplicates()
        yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (key, n_shingles, component_id) for every row of ``docs``; component_id is the smallest key reachable by links.

    Two texts link when 100 * |∩| >= threshold * |∪| of their n-gram sets. Null texts and texts without words have
    n_shingles 0 and are linked with nothing. Keys are integers; rows that repeat a key are one node, with the links of
    all its rows. Blocks of more than ``block_tokens`` tokens are dealt over tasks: each chunk is joined with itself and
    the block's first text; what is then not in the block's largest component meets every chunk.
    """
    t = threshold
    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    prof = table(d.mapInArrow(_profile(words, t), "id long, n long, fp long, fp2 long, keys array<long>"), "profiles")
    full = prof.where("n > 0")
    classes = full.groupBy("fp", "fp2").agg(F.min("id").alias("rep"))
    rep = full.join(classes, ["fp", "fp2"]).select("id", "n", "rep", "keys")
    rows = rep.where("id = rep").select(F.explode("keys").alias("key"), "id").repartition("key").sortWithinPartitions("key", "id")
    stars = rows.mapInArrow(_stars, "a long, b long").distinct()
    blocks = components(stars).select(F.col("node").alias("id"), F.col("component").alias("block"))
    sizes = full.groupBy("id").agg(F.max("n").alias("n"))
    blocks = table(blocks.join(sizes, "id"), "blocks")
    total = blocks.groupBy("block").agg(F.sum("n").alias("tokens"))
    dealt = blocks.join(total, "block").withColumn("chunks", F.ceil(F.col("tokens") / block_tokens).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("n")
    members = table(dealt.hint("merge").join(d, "id"), "members")  # the same plan at every size

    def within(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        f = block_links(*shingle_sets(g["text"].tolist(), words), t)
        ids = g["id"].to_numpy()
        return pd.DataFrame({"a": ids, "b": ids[f.labels()]})

    edge = "a long, b long"
    links = members.where("chunks = 1").select("block", "id", "text").groupBy("block").applyInPandas(within, edge)
    big = members.where("chunks > 1")
    if big.limit(1).count():
        links = links.unionByName(_big_blocks(big, words, t, block_tokens, within))
    same = rep.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(same).where("a <> b")).select(F.col("node").alias("id"), F.col("component").alias("component_id"))
    out = prof.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def _big_blocks(big: DataFrame, words: int, t: int, limit: int, within) -> DataFrame:
    """Links (a, b) inside blocks that one task cannot hold."""
    edge = "a long, b long"
    heads = big.where("id = block").select("block", "id", "text", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    once = big.where("id <> block").select("block", "id", "text", "chunks", "chunk").unionByName(heads)
    first = table(once.select("block", "chunk", "id", "text").groupBy("block", "chunk").applyInPandas(within, edge).where("a <> b"), "links")
    comp = components(first).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    m = big.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    # The largest component of each block; what is not in it meets the whole block.
    most = m.groupBy("block", "comp").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("comp", "c").alias("main"))
    m = m.join(most, "block")
    rest = m.where("comp <> main").groupBy("block").agg(F.ceil(F.sum(F.length("text")) / (4 * limit)).cast("int").alias("rests"))
    m = m.join(rest, "block")
    part = F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.col("rests")).cast("int")
    left = m.where("comp <> main").select("block", "id", "text", "comp", part.alias("j"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.lit(True).alias("rest"))
    right = m.select("block", "id", "text", "comp", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("j"), F.col("chunk").alias("i"), F.lit(False).alias("rest"))

    def across(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        f = block_links(*shingle_sets(g["text"].tolist(), words), t, g["comp"].to_numpy(), g["rest"].to_numpy().astype(bool))
        ids = g["id"].to_numpy()
        return pd.DataFrame({"a": ids, "b": ids[f.labels()]})

    more = left.unionByName(right).groupBy("block", "i", "j").applyInPandas(across, edge)
    return first.unionByName(more)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that have an earlier relative: of each component the row of the smallest key stays."""
    gone = near_duplicates(docs, key, text, words, threshold).where(f"{key} <> component_id").select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key] == F.col("_gone"), "left_anti")
