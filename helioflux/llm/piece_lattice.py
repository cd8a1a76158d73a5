"""The BPE segmentation of a text as a max-plus path: pieces that stay apart under merging weigh 0, all other neighbours -inf.

A sequence of pieces is the BPE segmentation of its text exactly if every two neighbours are the segmentation of the
text of both, and every prefix of it is the segmentation of its own text. So the segmentation is the one path of weight 0
through the lattice of pieces, and the state at a border inside a text is the piece that reaches the border. A chunk
between two borders yields the matrix of weights from the states at the one to those at the other; matrices combine by
max-plus products in any grouping; with the states at its borders known, a chunk is traced back alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

SPACE = "▁"
NONE = -np.inf
#: Words and parts of words whose segmentation a process remembers at once.
MEMO = 400_000
#: A state at a border: how far the piece reaches over it, and its id (-1 for an unknown character).
State = tuple[int, int]


class Lattice:
    """Pieces of a BPE model with the rank of the merge that forms each, and what can stand side by side."""

    def __init__(self, table: dict[str, tuple[int, float]], spell: Callable[[str], list[int]]) -> None:
        self.spell = spell
        self.ids = {p: k for p, (k, _) in table.items()}
        self.text = {k: p for p, k in self.ids.items()}
        self.rank = {k: -s for _, (k, s) in table.items()}
        self.reach = max(map(len, table))
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in table)
        self.parts = {k: self._last_merge(p) for p, k in self.ids.items() if len(p) > 1}
        self.unmade = {k for k, x in self.parts.items() if x is None}  # pieces that merging never makes
        # A tree of characters: what they spell so far (the piece's id, or -1 where only longer ones go on from it) and what may follow.
        self.tree: dict[str, tuple[int, dict]] = {}
        for p, k in self.ids.items():
            at = self.tree
            for c in p[:-1]:
                if c not in at:
                    at[c] = (-1, {})
                at = at[c][1]
            at[p[-1]] = (-1 if k in self.unmade else k, at[p[-1]][1] if p[-1] in at else {})
        self.side_by_side: dict[int, bool] = {}  # by both ids in one number
        self.memo = Words(self)
        self.parts_of = _parts_of(table).findall

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge completes ``piece``, by merging it from its characters."""
        symbols, last = list(piece), None
        while len(symbols) > 1:
            made = [(self.rank[k], i) for i in range(len(symbols) - 1) if (k := self.ids.get(symbols[i] + symbols[i + 1])) is not None]
            if not made:
                return None
            _, i = min(made)
            last = (symbols[i], symbols[i + 1])
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return tuple(self.ids.get(x, -1) for x in last)

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the text of both from its characters ends with these two pieces."""
        key = a << 32 | b
        known = self.side_by_side.get(key)
        if known is None:
            if len(self.side_by_side) > 2 * MEMO:
                self.side_by_side.clear()
            known = self.side_by_side[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # The merges of both sides are undone from the last; at each stage the two innermost pieces must not have merged
        # before the merge just undone. Of equal ranks the left one comes first.
        limit, left = float("inf"), False
        while a >= 0 and b >= 0:
            both = self.ids.get(self.text[a] + self.text[b])
            if both is not None and (self.rank[both] < limit or self.rank[both] == limit and not left):
                return False
            ra = self.rank[a] if a in self.parts else NONE
            rb = self.rank[b] if b in self.parts else NONE
            if ra == rb == NONE:
                return True
            if ra > rb:
                limit, left, a = ra, True, self.parts[a][1]
            else:
                limit, left, b = rb, False, self.parts[b][0]
        return True

    def walk(self, text: str, start: int, first: int | None, end: int) -> list[tuple[int, int] | None]:
        """For each place from ``start`` to ``end``: (where its last piece starts, its id) on the path of weight 0 from ``start``.

        ``first`` is the piece before ``start``, None if nothing there can merge. None where no such path ends.
        """
        tree, known = self.tree, self.side_by_side
        n = end - start
        out: list[tuple[int, int] | None] = [None] * (n + 1)
        if len(known) > 2 * MEMO:
            known.clear()
        part = text[start:end]
        for a in range(n):
            if a:
                if out[a] is None:
                    continue
                before = out[a][1]
            else:
                before = first
            free = before is None or before < 0
            j, b, at = start + a, a, tree
            if part[a] not in at:
                if out[a + 1] is None:
                    out[a + 1] = (j, -1)  # an unknown character
                continue
            while at and b < n:
                step = at.get(part[b])
                if step is None:
                    break
                k, at = step
                b += 1
                if k < 0 or out[b] is not None:  # at most one path ends at a place
                    continue
                if free:
                    out[b] = (j, k)
                    continue
                key = before << 32 | k
                ok = known.get(key)
                if ok is None:
                    ok = known[key] = self._apart(before, k)
                if ok:
                    out[b] = (j, k)
        return out

    def word(self, text: str) -> list[tuple[int, int]]:
        """Pieces (start, id) of the path of weight 0 over all of ``text``, as ``_trace`` finds it, from the longest pieces on.

        At most one path of weight 0 leads to a place, so a place from which no path leads to the end is never tried again. A walk
        spells from every place; this one from those on the path and the few that it gave up.
        """
        n, tree, known = len(text), self.tree, self.side_by_side
        if len(known) > 2 * MEMO:
            known.clear()
        path: list[tuple[int, int]] = []
        tried: list[tuple[list, int]] = []  # what is left to try at the places of the path, and the piece before each
        dead: set[int] = set()
        a, before = 0, -1
        while True:
            ends, at, b = [], tree, a
            while b < n:
                step = at.get(text[b])
                if step is None:
                    break
                k, at = step
                b += 1
                if k >= 0:
                    ends.append((b, k))
            if b == a:
                ends.append((a + 1, -1))  # an unknown character
            while True:
                while ends:
                    b, k = ends.pop()
                    if b in dead:
                        continue
                    if before < 0 or k < 0:
                        break
                    key = before << 32 | k
                    ok = known.get(key)
                    if ok is None:
                        ok = known[key] = self._apart(before, k)
                    if ok:
                        break
                else:
                    if not path:
                        raise ValueError("no path of pieces through a word")
                    dead.add(a)
                    a, _ = path.pop()
                    ends, before = tried.pop()
                    continue
                break
            path.append((a, k))
            if b == n:
                return path
            tried.append((ends, before))
            a, before = b, k

    def crossing(self, text: str, at: int) -> list[State]:
        """Every state the border ``at`` may have, by the text around it alone."""
        if at <= 0:
            return [(0, -1)]
        out = [(0, -1)] if text[at - 1] not in self.ids else []
        for j in range(max(0, at - self.reach), at):
            for i in range(at, min(len(text), j + self.reach) + 1):
                k = self.ids.get(text[j:i])
                if k is not None and k not in self.unmade:
                    out.append((i - at, k))
        return out

    def _word_starts(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last place in [lo, hi) where a word starts that no piece reaches into."""
        if not self.words_apart:
            return None
        first = lo
        while True:
            first = text.find(SPACE, first, hi)
            if first < 0:
                return None
            if first == 0 or text[first - 1] != SPACE:
                break
            first += 1
        last = hi
        while True:
            last = text.rfind(SPACE, lo, last)
            if last == 0 or text[last - 1] != SPACE:
                return first, last

    def _exits(self, text: str, path: list, start: int, first: int | None, at: int, states: list[State]) -> list[float]:
        """Weights of the states at the border ``at`` for a walk from ``start``."""
        out = []
        for d, k in states:
            i = at + d
            j = i - (len(self.text[k]) if k >= 0 else 1)
            if j == start - (start - j) and j >= start and (j == start or path[j - start] is not None):
                before = first if j == start else path[j - start][1]
                out.append(0.0 if before is None or k < 0 or before < 0 or self.apart(before, k) else NONE)
            else:
                out.append(NONE)
        return out

    def transfer(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Weights from the states at border ``lo`` to those at border ``hi`` of ``text``; at its end there is one state."""
        enter = self.crossing(text, lo)
        leave = self.crossing(text, hi) if hi < len(text) else [(0, -2)]
        marks = self._word_starts(text, lo, hi)
        out = np.full((len(enter), len(leave)), NONE)
        if marks:
            h, w = marks
            tail = self._tail(text, w, None, hi, leave)
            for r, (d, k) in enumerate(enter):
                if lo + d == h or lo + d < h and self.walk(text, lo + d, k if lo else None, h)[-1] is not None:
                    out[r] = tail
            return out
        for r, (d, k) in enumerate(enter):
            if lo + d <= hi:
                out[r] = self._tail(text, lo + d, k if lo else None, hi, leave, (d, k), lo)
            else:  # the piece reaches over the whole chunk
                out[r] = [0.0 if (lo + d - hi, k) == s else NONE for s in leave]
        return out

    def _tail(self, text: str, start: int, first: int | None, hi: int, leave: list[State], came: State | None = None, lo: int = 0) -> list[float]:
        if leave == [(0, -2)]:
            return [0.0 if start == len(text) or self.walk(text, start, first, len(text))[-1] is not None else NONE]
        if start == hi and came is not None:  # it ends right at the border
            return [0.0 if s == (0, came[1]) and lo < hi else NONE for s in leave]
        path = self.walk(text, start, first, hi)
        return self._exits(text, path, start, first, hi, leave)

    def _trace(self, text: str, start: int, first: int | None, end: int, last: int | None = None) -> list[tuple[int, int]]:
        """Pieces (start, id) of the path from ``start`` to ``end``; ``last`` is the id of the piece that ends there, if it is fixed."""
        out: list[tuple[int, int]] = []
        i = end
        if last is not None:
            i = end - (len(self.text[last]) if last >= 0 else 1)
            out.append((i, last))
        path = self.walk(text, start, first, i)
        while i > start:
            j, k = path[i - start]
            out.append((j, k))
            i = j
        return out[::-1]

    def pieces(self, text: str, lo: int, hi: int, enter: State, leave: State) -> list[int]:
        """Ids of what starts in [lo, hi) on the path between the states."""
        start, first = lo + enter[0], enter[1] if lo else None
        fixed = None if leave[1] == -2 else leave[1]
        end = hi + leave[0] if fixed is not None else len(text)
        if start >= end or fixed is not None and end - (len(self.text[fixed]) if fixed >= 0 else 1) < lo:
            return []  # the piece at the end started before this chunk
        marks = self._word_starts(text, start, hi)
        if not marks:
            return self._spelt(text, self._trace(text, start, first, end, fixed))
        h, w = marks
        out = self._spelt(text, self._trace(text, start, first, h)) if h > start else []
        if len(self.memo) > MEMO:
            self.memo.clear()
        out += chain.from_iterable(map(self.memo.__getitem__, self.parts_of(text, h, w)))
        return out + self._spelt(text, self._trace(text, w, None, end, fixed))

    def _spelt(self, text: str, path: list[tuple[int, int]]) -> list[int]:
        out: list[int] = []
        for j, k in path:
            if k >= 0:
                out.append(k)
            else:
                out += self.spell(text[j])
        return out

    def encode(self, text: str, size: int) -> list[int]:
        """Ids of a whole normalised text by way of chunks of ``size`` characters."""
        if not text:
            return []
        cuts = [*range(0, len(text), size), len(text)]
        borders = list(zip(cuts, cuts[1:], strict=False))
        if len(borders) == 1:
            return self.pieces(text, 0, len(text), (0, -1), (0, -2))
        take = border_states([self.transfer(text, a, b) for a, b in borders])
        states = [self.crossing(text, c)[k] for c, k in zip(cuts[:-1], take, strict=False)] + [(0, -2)]
        return list(chain.from_iterable(self.pieces(text, a, b, states[i], states[i + 1]) for i, (a, b) in enumerate(borders)))


def _parts_of(table: dict[str, tuple[int, float]]) -> re.Pattern:
    """Parts of words that merge apart: runs of letters and runs of other characters, either with the spaces before it.

    What some piece has next to a letter counts as a letter, and so does what some piece has next to that. So no piece lies
    across the end of a part, nothing merges there, and words that differ in marks share parts.
    """
    beside: dict[str, set[str]] = {}
    for p in table:
        for x, y in zip(p, p[1:], strict=False):
            if x != SPACE and y != SPACE:
                beside.setdefault(x, set()).add(y)
                beside.setdefault(y, set()).add(x)
    letters = {c for p in table for c in p if c.isalpha()}
    new = letters
    while new:
        new = {d for c in new for d in beside.get(c, ())} - letters
        letters = letters | new
    kind = "".join(map(re.escape, sorted(letters)))
    return re.compile(f"{SPACE}*(?:[{kind}]+|[^{kind}{SPACE}]+)|{SPACE}+" if kind else f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Words(dict):
    """Ids of whole words or parts of words, found when first asked for."""

    def __init__(self, lattice: Lattice) -> None:
        self.lattice = lattice

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self[word] = tuple(self.lattice._spelt(word, self.lattice.word(word)))  # tuples of numbers are nothing to the garbage collector
        return got


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative, so chunks can be combined in any grouping."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefixes(matrices: list[np.ndarray], before: np.ndarray | None = None) -> list[np.ndarray]:
    """Weights of the states at every border from the start on."""
    v = [np.zeros(matrices[0].shape[0]) if before is None else before]
    for a in matrices:
        v.append((v[-1][:, None] + a).max(axis=0))
    return v


def suffixes(matrices: list[np.ndarray], after: np.ndarray | None = None) -> list[np.ndarray]:
    """Weights of the states at every border to the end."""
    u = [np.zeros(matrices[-1].shape[1]) if after is None else after]
    for a in reversed(matrices):
        u.append((a + u[-1][None, :]).max(axis=1))
    return u[::-1]


def border_states(matrices: list[np.ndarray], before: np.ndarray | None = None, after: np.ndarray | None = None) -> list[int]:
    """Which state each border takes, the first and the last included: the best of what leads up to it and on from it."""
    return [int(np.argmax(x + y)) for x, y in zip(prefixes(matrices, before), suffixes(matrices, after), strict=True)]


@lru_cache(maxsize=4)
def load(path: str) -> tuple:
    """The pieces and the lattice of a model file, once per process."""
    from .sentencepiece_scan import Pieces

    m = Pieces(path)
    return m, Lattice(m.table, m.spell_char)
