"""Byte-pair segmentation of many short strings at once by relaxing edges.

A sequence of tokens is what greedy merging gives for a text exactly when each token is what merging
gives for its own text and merging leaves each two neighbours as they are. So the last token of every
prefix can be found from left to right: among the tokens that end there, one fits the last token of
the prefix before it. The number of tokens of every prefix comes with it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_CACHE_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Fits:
    """Whether two tokens may stand side by side, or one at the start of a text.

    ``symbols`` cuts bytes into what merging starts from; ``priority`` gives the rank of a merge of
    two strings, lower first, or None. Answers are kept in a table of fixed size.
    """

    def __init__(
        self,
        tokens: list[bytes],
        symbols: Callable[[bytes], list[bytes]],
        priority: Callable[[bytes, bytes], int | None],
        whole: frozenset[int] = frozenset(),
    ):
        self.tokens, self.symbols, self.priority, self.whole = tokens, symbols, priority, whole
        self.start = len(tokens)
        self._ends: dict[int, tuple[list, list] | None] = {}
        self._keys = np.full(1 << _CACHE_BITS, -1, dtype=np.int64)
        self._values = np.zeros(1 << _CACHE_BITS, dtype=bool)

    def _grown(self, token: int) -> tuple[list, list] | None:
        """What stood at the left and at the right end of a token while merging made it, with the rank of the
        merge that took it in; None for a token that merging doesn't make of its own text."""
        if token in self._ends:
            return self._ends[token]
        last = float("inf")
        parts = [(s, [(s, last)], [(s, last)], -1) for s in self.symbols(self.tokens[token])]
        while len(parts) > 1:
            ranks = [self.priority(a[0], b[0]) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            at = ranks.index(best)
            a, b = parts[at : at + 2]
            if best < max(a[3], b[3]):
                raise ValueError("a merge is ranked before the merges that make its parts")
            text = a[0] + b[0]
            left = [(text, last), *((s, best if r == last else r) for s, r in a[1])]
            right = [(text, last), *((s, best if r == last else r) for s, r in b[2])]
            parts[at : at + 2] = [(text, left, right, best)]
        self._ends[token] = (parts[0][1], parts[0][2]) if len(parts) == 1 else None
        return self._ends[token]

    def _answer(self, before: int, token: int) -> bool:
        alone = token in self.whole or self._grown(token) is not None
        if not alone or before == self.start or token in self.whole or before in self.whole:
            return alone
        # Merges run by rising rank. One across the border is made if its two sides stand there at its
        # turn: neither has been taken in before, where the left one of two equal merges comes first.
        for x, taken_x in self._ends[before][1]:
            for y, taken_y in self._ends[token][0]:
                rank = self.priority(x, y)
                if rank is not None and rank < taken_x and rank <= taken_y:
                    return False
        return True

    def __call__(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys = before.astype(np.int64) * (self.start + 1) + tokens
        slots = ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        known = self._keys[slots] == keys
        out = self._values[slots]
        if not known.all():
            missing = np.flatnonzero(~known)
            unique, place = np.unique(keys[missing], return_inverse=True)
            answers = np.fromiter(
                (self._answer(*divmod(k, self.start + 1)) for k in unique.tolist()), bool, len(unique)
            )
            out[missing] = answers[place]
            self._keys[slots[missing]] = keys[missing]
            self._values[slots[missing]] = out[missing]
        return out


class Relaxed:
    """The best path to every place of every unit; place ``i`` of unit ``u`` is at ``offsets[u] + i``."""

    def __init__(self, lengths: np.ndarray, unit: np.ndarray, start: np.ndarray, end: np.ndarray, token: np.ndarray, fits: Fits):
        self.lengths = lengths
        self.offsets = np.cumsum(lengths + 1) - (lengths + 1)
        places = int(lengths.sum()) + len(lengths)
        self.last = np.full(places, -1, dtype=np.int32)
        self.back = np.zeros(places, dtype=np.int32)
        self.count = np.full(places, -1, dtype=np.int64)
        self.last[self.offsets] = fits.start
        self.count[self.offsets] = 0
        target, size = self.offsets[unit] + end, end - start
        # By end, then place, then the longest token; as one number where that fits.
        most = int(size.max()) if len(size) else 0
        if (int(lengths.max()) if len(lengths) else 0).bit_length() + places.bit_length() + most.bit_length() < 63:
            order = np.argsort((end * places + target) * (most + 1) + (most - size))
        else:
            order = np.lexsort((start, target, end))
        target, token, end = target[order], token[order], end[order]
        source = target - size[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(end)) + 1, [len(end)]]) if len(end) else [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            # Longest tokens first; a place is settled by the one that fits.
            left = np.flatnonzero(self.last[source[a:b]] >= 0) + a
            while len(left):
                own = target[left]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                now = left[first]
                now = now[fits(self.last[source[now]], token[now])]
                src, dst = source[now], target[now]
                self.last[dst] = token[now]
                self.back[dst] = dst - src
                self.count[dst] = self.count[src] + 1
                rest = np.ones(len(left), dtype=bool)
                rest[first] = False
                left = left[rest]
                left = left[self.last[target[left]] < 0]

    def totals(self) -> np.ndarray:
        return self.count[self.offsets + self.lengths]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens of all units in order, the place where each begins in its unit, its length."""
        totals = self.totals()
        starts = np.cumsum(totals) - totals
        tokens = np.empty(int(totals.sum()), dtype=np.int32)
        begins, sizes = np.empty(len(tokens), dtype=np.int64), np.empty(len(tokens), dtype=np.int64)
        at = self.offsets + self.lengths
        slot = starts + totals - 1
        live = np.flatnonzero(totals > 0)
        while len(live):
            place = at[live]
            step = self.back[place]
            tokens[slot[live]] = self.last[place]
            sizes[slot[live]] = step
            begins[slot[live]] = place - step - self.offsets[live]
            at[live] -= step
            slot[live] -= 1
            live = live[at[live] > self.offsets[live]]
        return tokens, begins, sizes


class Trie:
    """All occurrences of tokens in a buffer, by walking from every place at once."""

    def __init__(self, tokens: dict[bytes, int]):
        children: dict[int, int] = {}
        ends = {0: -1}
        size = 1
        for text, token in tokens.items():
            node = 0
            for byte in text:
                key = node << 8 | byte
                if key not in children:
                    children[key] = size
                    ends[size] = -1
                    size += 1
                node = children[key]
            ends[node] = token
        self._token = np.array([ends[i] for i in range(size)], dtype=np.int32)
        self._bits = max(4, (4 * len(children)).bit_length())
        self._keys = np.full((1 << self._bits) + 64, -1, dtype=np.int64)
        self._nodes = np.full((1 << self._bits) + 64, -1, dtype=np.int32)
        keys = np.fromiter(children.keys(), np.int64, len(children))
        for key, slot, node in zip(keys.tolist(), self._slots(keys).tolist(), children.values()):
            while self._keys[slot] >= 0:
                slot += 1
            self._keys[slot], self._nodes[slot] = key, node

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        found = self._keys[slots]
        out = np.where(found == keys, self._nodes[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] += 1
            found = self._keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._nodes[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def edges(self, buffer: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, token) of every occurrence; ``limit`` is the end of the unit of each place."""
        places = np.arange(len(buffer))
        nodes = np.zeros(len(buffer), dtype=np.int64)
        found, depth = [], 0
        while len(places):
            inside = places + depth < limit[places]
            places, nodes = places[inside], nodes[inside]
            nodes = self._step(nodes << 8 | buffer[places + depth])
            alive = nodes >= 0
            places, nodes = places[alive], nodes[alive].astype(np.int64)
            depth += 1
            token = self._token[nodes]
            hit = token >= 0
            found.append((places[hit], np.full(int(hit.sum()), depth), token[hit]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


class Segmenter:
    """Segments units with a vocabulary matched by a trie."""

    def __init__(self, vocabulary: dict[bytes, int], fits: Fits):
        self.trie, self.fits = Trie(vocabulary), fits

    def __call__(self, units: list[bytes]) -> Relaxed:
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        buffer = np.frombuffer(b"".join(units), dtype=np.uint8)
        unit = np.repeat(np.arange(len(units)), lengths)
        firsts = np.cumsum(lengths) - lengths
        places, sizes, tokens = self.trie.edges(buffer, (firsts + lengths)[unit])
        start = places - firsts[unit[places]]
        return Relaxed(lengths, unit[places], start, start + sizes, tokens, self.fits)


class Merger:
    """Merges pairs of many short rows of tokens at once: in each row the pair of lowest rank, of equal ones the first.

    The cost grows with the square of a row's length.
    """

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        """``merges`` gives the rank of a pair of tokens and the token it becomes."""
        self._none = np.int32(len(merges))
        ranked = sorted((rank, own, a, b) for (a, b), (rank, own) in merges.items())
        self._results = np.array([own for _, own, _, _ in ranked], dtype=np.int32)
        left, right = (np.array([r[i] for r in ranked], dtype=np.int64) for i in (2, 3))
        self._bits = max(4, (4 * len(ranked)).bit_length())
        self._keys = np.full((1 << self._bits) + 64, -1, dtype=np.int64)
        self._ranks = np.full(len(self._keys), self._none, dtype=np.int32)
        keys = left << 32 | right
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self._keys[slot] >= 0:
                slot += 1
            self._keys[slot], self._ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, a number above all ranks for one that isn't merged; token -1 is none."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        found = self._keys[slots]
        out = np.where((found == keys) & (keys >= 0), self._ranks[slots], self._none)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(open_):
            slots[open_] += 1
            found = self._keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """What is left of each row of tokens, filled up with -1 behind its end like the rows given."""
        out = np.full(rows.shape, -1, dtype=np.int32)
        n, width = rows.shape
        live, tokens = np.arange(n), rows.astype(np.int32)
        ranks = self._rank(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
        columns = np.arange(width)
        while len(live) and ranks.shape[1]:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            going = best < self._none
            if not going.all():
                out[live[~going], : tokens.shape[1]] = tokens[~going]
                live, tokens, ranks, at, best = live[going], tokens[going], ranks[going], at[going], best[going]
            # The right one of the pair goes, what stands behind it moves up.
            behind = columns[: tokens.shape[1] - 1] > at[:, None]
            tokens = np.where(behind, tokens[:, 1:], tokens[:, :-1])
            ranks = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            merged = self._results[best]
            tokens[np.arange(len(live)), at] = merged
            inner = np.flatnonzero(at < ranks.shape[1])
            ranks[inner, at[inner]] = self._rank(merged[inner], tokens[inner, at[inner] + 1])
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self._rank(tokens[inner, at[inner] - 1], merged[inner])
        out[live, : tokens.shape[1]] = tokens
        return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
