"""Byte-context trees of prediction by partial matching, as flat numpy tables.

A gram is the last d bytes up to a position, packed 9 bits to a byte (byte + 1, so
0 means "before the text begins").  A node stands for a gram; its parent lacks the
oldest byte, its prefix lacks the newest.  A node is both the context that precedes
the next byte and the event "newest byte in the context of the rest".  Because the
statistics are frozen, the code length of a byte depends only on the nodes reached
at its position and at the one before, so whole texts are scored by table look-ups
for all positions at once.

Escape estimate: method C, t / (n + t) for a context seen n times with t symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 9


def packed(data: np.ndarray, starts: np.ndarray, s: int, e: int, depth: int) -> np.ndarray:
    """Grams of `depth` bytes that end at positions s..e-1; bytes before the text's start are 0."""
    out = np.zeros(e - s, np.uint64)
    for back, sym in shifted(data.astype(np.uint16) + np.uint16(1), starts, s, e, depth):
        out |= sym.astype(np.uint64) << np.uint64(BITS * back)
    return out


def shifted(symbols: np.ndarray, starts: np.ndarray, s: int, e: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(back, symbol `back` places before each of s..e-1), 0 where that is in another text."""
    lo = np.searchsorted(starts, s - depth)
    near = starts[lo : np.searchsorted(starts, e)] - s
    for back in range(depth):
        if s >= back:
            sym = symbols[s - back : e - back].copy()
        else:
            sym = np.concatenate([np.zeros(min(back - s, e - s), symbols.dtype), symbols[: max(0, e - back)]])
        for r in range(back):
            at = near + r
            sym[at[(at >= 0) & (at < e - s)]] = 0
        yield back, sym


def below(grams: np.ndarray, counts: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of d bytes and their counts (rows), from those of more bytes."""
    v = grams & np.uint64((1 << (BITS * d)) - 1)
    full = v >> np.uint64(BITS * (d - 1)) != 0
    v, counts = v[full], counts[full]
    keys, inv = np.unique(v, return_inverse=True)
    return keys, np.stack([np.bincount(inv, counts[:, k], len(keys)) for k in range(counts.shape[1])], axis=1).astype(np.float32)


class Children:
    """Child nodes by (node, symbol): an open-addressed table, looked up for whole arrays at once."""

    _MUL = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, nodes: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.node = np.zeros(1 << bits, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            self.key[slot[free]] = keys[free]  # of several that want a place the last gets it
            placed = self.key[slot[todo]] == keys[todo]
            self.node[slot[todo[placed]]] = nodes[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self._MUL >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The child of each key, 0 where there is none."""
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.node[slot], 0)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & self.mask
            there = self.key[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.node[at[hit]]
            todo = todo[~hit & (there >= 0)]
        return out


class Tree:
    """levels[d-1] = (sorted packed grams of d bytes, counts with a column for each model).

    Grams must be closed: if one is there, so are its parent and its prefix.
    Node 0 is none, node 1 the root, then the grams by depth.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.depth = len(levels)
        self.models = levels[0][1].shape[1]
        base = [1, 2]
        for keys, _ in levels:
            base.append(base[-1] + len(keys))
        self.base = np.array(base)  # base[d]: first node of depth d
        n = base[-1]
        self.level = np.zeros(n, np.int8)
        self.count = np.zeros((n, self.models), np.float32)
        self.parent = np.zeros(n, np.int32)
        self.prefix = np.zeros(n, np.int32)
        seen = np.unique(levels[0][0]).astype(np.int64) - 1
        self.symbol = np.zeros(256, np.int32)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        self.width = width
        self.count[1] = levels[0][1].sum(axis=0)
        edges = np.zeros(n, np.int64)
        for d, (keys, counts) in enumerate(levels, 1):
            own = slice(base[d], base[d + 1])
            self.level[own], self.count[own] = d, counts
            if d == 1:
                self.parent[own] = self.prefix[own] = 1
            else:
                up = levels[d - 2][0]
                self.parent[own] = base[d - 1] + np.searchsorted(up, keys & np.uint64((1 << (BITS * (d - 1))) - 1))
                self.prefix[own] = base[d - 1] + np.searchsorted(up, keys >> np.uint64(BITS))
            oldest = (keys >> np.uint64(BITS * (d - 1))).astype(np.int64) - 1
            edges[own] = self.parent[own].astype(np.int64) * width + self.symbol[oldest]
        self.children = Children(edges[2:], np.arange(2, n))
        # Of each context: occurrences that some byte follows, and distinct bytes that do.
        self.n = np.stack([np.bincount(self.prefix[2:], self.count[2:, k], n) for k in range(self.models)], axis=1)
        self.t = np.stack([np.bincount(self.prefix[2:], self.count[2:, k] > 0, n) for k in range(self.models)], axis=1)
        # A node of full depth stands for its longest context, one byte shorter.
        self.as_context = np.where(self.level == self.depth, self.parent, np.arange(n))

    def slim(self) -> None:
        """Drop what only building a code needs: the rest is sent to the executors."""
        for name in ("count", "parent", "prefix", "n", "t", "as_context"):
            delattr(self, name)

    def walk(self, data: np.ndarray, starts: np.ndarray, s: int, e: int) -> Iterator[np.ndarray]:
        """For depth 1, 2, ... the nodes at positions s..e-1, 0 where there is none."""
        node = np.ones(e - s, np.int64)
        lo = max(0, s - self.depth)
        local = self.symbol[data[lo:e]]
        for _, sym in shifted(local, starts - lo, s - lo, e - lo, self.depth):
            alive = np.flatnonzero(node)
            found = self.children.find(node[alive] * self.width + sym[alive])
            node = np.zeros(e - s, np.int64)
            node[alive] = found
            yield node

    def deepest(self, data: np.ndarray, starts: np.ndarray, s: int, e: int) -> np.ndarray:
        deep = np.ones(e - s, np.int64)
        for node in self.walk(data, starts, s, e):
            np.copyto(deep, node, where=node > 0)
        return deep


def by_doc(acc: np.ndarray, values: np.ndarray, offsets: np.ndarray, s: int, e: int) -> None:
    """Add to acc[i] the values (of positions s..e-1) that lie in text i."""
    i, j = np.searchsorted(offsets, s, "right") - 1, np.searchsorted(offsets, e, "left")
    cut = np.clip(offsets[i : j + 1], s, e) - s
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    acc[i:j] += total[cut[1:]] - total[cut[:-1]]


class PlainCode:
    """Code lengths in bits under each model of a tree, escapes without exclusion."""

    def __init__(self, tree: Tree):
        self.tree = tree
        n, t = tree.n, tree.t
        with np.errstate(divide="ignore", invalid="ignore"):
            esc = np.where(n > 0, -np.log2(t / (n + t)), 0.0)
            paid = np.where(tree.count > 0, -np.log2(tree.count / (n + t)[tree.prefix]), np.inf)
        self.escape, event = np.zeros_like(n), np.zeros_like(n)
        self.escape[1] = esc[1]
        event[1] = 8.0
        for d in range(1, tree.depth + 1):
            own = slice(tree.base[d], tree.base[d + 1])
            self.escape[own] = self.escape[tree.parent[own]] + esc[own]
            event[own] = np.where(np.isfinite(paid[own]), paid[own] - self.escape[tree.prefix[own]], event[tree.parent[own]])
        self.escape = self.escape[tree.as_context].astype(np.float32)
        self.weight = event.astype(np.float32) + self.escape
        # A text pays for the context before each byte, not for the one after its last.
        self.start = self.escape[1].astype(np.float64)
        tree.slim()

    def bits(self, data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, self.tree.models))
        starts = np.unique(offsets[:-1])
        last = offsets[1:] - 1
        some = offsets[1:] > offsets[:-1]
        for s in range(0, len(data), size):
            e = min(len(data), s + size)
            deep = self.tree.deepest(data, starts, s, e)
            w = self.weight[deep]
            for k in range(self.tree.models):
                by_doc(out[:, k], w[:, k], offsets, s, e)
            here = np.nonzero(some & (last >= s) & (last < e))[0]
            out[here] += self.start - self.escape[deep[last[here] - s]]
        return out


class ExcludingCode:
    """Code lengths in nats under a tree of one model, with exclusion: after an escape,
    the bytes that the longer context has seen count for nothing in the shorter one."""

    def __init__(self, tree: Tree):
        self.tree = tree
        n, t, count = tree.n[:, 0], tree.t[:, 0], tree.count[:, 0]
        size = len(n)
        # In the parent of context c, what bytes seen in c hold: each child event of c has
        # as its parent the same event one byte shorter.
        held = np.zeros(size)
        np.add.at(held, tree.prefix[2:], np.where(tree.level[2:] > 1, count[tree.parent[2:]], 0.0))
        ids = np.arange(size)
        inner = (tree.level >= 1) & (tree.level < tree.depth)
        c = ids[inner]
        left_n, left_t = n[tree.parent[c]] - held[c], t[tree.parent[c]] - t[c]
        self.log_left = np.zeros(size)
        cost = np.zeros(size)
        some = left_t > 0
        self.log_left[c] = np.log(np.maximum(left_n + left_t, 1.0))
        cost[c[some]] = np.log((left_n + left_t)[some] / left_t[some])
        self.chain = np.zeros(size)
        for d in range(1, tree.depth):
            own = np.arange(tree.base[d], tree.base[d + 1])
            self.chain[own] = self.chain[tree.parent[own]] + cost[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            first = np.where(n > 0, np.log((n + t) / np.maximum(t, 1)), 0.0)
            self.log_count = np.where(count > 0, np.log(np.maximum(count, 1e-300)), 0.0)
        self.log_all = np.log(np.maximum(n + t, 1.0))[tree.prefix]
        # Contexts that no byte follows (ends of texts) are as good as absent.
        use = np.where(n > 0, ids, tree.parent)
        self.context = use[tree.as_context]
        self.enter = (first + self.chain)[self.context]
        self.log_new = np.log(max(256 - t[1], 1.0))
        self.usable = n > 0
        tree.slim()

    def nats(self, data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
        """Code length of each text, 0 for an empty one."""
        out = np.zeros(len(offsets) - 1)
        starts = np.unique(offsets[:-1])
        for s in range(0, len(data), size):
            e = min(len(data), s + size)
            by_doc(out, self._each(data, starts, s, e), offsets, s, e)
        return out

    def _each(self, data: np.ndarray, starts: np.ndarray, s: int, e: int) -> np.ndarray:
        """Costs at s..e-1.  Node arrays hold position s-1 too, in front."""
        m = e - s
        deep_before = np.ones(m, np.int64)
        event = np.ones(m, np.int64)
        above = np.ones(m, np.int64)  # the context one byte longer than the event's own, 0 if none
        alive = np.ones(m, bool)
        first = starts[np.searchsorted(starts, s) : np.searchsorted(starts, e)] - s
        lead = 1 if s else 0
        for node in self.tree.walk(data, starts, s - lead, e):
            now = node[lead:]
            before = np.concatenate([node[:m] if lead else np.concatenate([[0], node[: m - 1]])])
            before[first] = 0
            np.copyto(deep_before, before, where=before > 0)
            got = alive & (now > 0)
            np.copyto(event, now, where=got)
            np.copyto(above, before, where=got)
            alive = got
        context = self.context[deep_before]
        # An event of depth d ends in a context of d - 1 bytes; `above` holds the one of d.
        found = event > 1
        longer = found & (above > 0) & self.usable[above] & (self.tree.level[np.maximum(above, 1)] <= self.tree.level[context])
        cost = np.where(longer, self.enter[deep_before] - self.chain[above] + self.log_left[above], self.log_all[event]) - self.log_count[event]
        new = ~found
        cost[new] = self.enter[deep_before[new]] + self.log_new
        return cost
