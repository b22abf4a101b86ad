"""Context-tree weighting over binary-decomposed bytes: the arithmetic, on NumPy arrays.

A byte is eight binary decisions, each with a context tree of its own over the bytes before it, nearest first.
Every node estimates by Krichevsky and Trofimov; a node's weighted probability is half its own estimate
plus half the product of its children's, so each node splits its weight between stopping there and going
deeper by its evidence. A prediction mixes the estimates along the path of contexts by these weights;
the weight that is left where the path ends in training goes to the deepest node that was seen. That choice
depends on contexts alone, so the probabilities of all bytes still sum to one.

A gram is a context and the byte that follows as one unsigned integer: nearest context byte highest, the
byte that follows lowest. Sorted grams thus hold each subtree in one range.
"""

from __future__ import annotations

import numpy as np

END = b"\n"
LN2, LN10 = np.log(2.0), np.log(10.0)
#: ln P of the Krichevsky-Trofimov estimate needs ln gamma at halves and integers: exact up to here.
EXACT = 4096


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(x))))


_HALF, _WHOLE = _sums(np.arange(EXACT) + 0.5), _sums(np.arange(EXACT) + 1.0)


def _ln_gamma(n: np.ndarray, add: float) -> np.ndarray:
    """ln gamma(n + add) - ln gamma(add), add being 0.5 or 1."""
    exact = (_HALF if add == 0.5 else _WHOLE)[np.minimum(n, EXACT).astype("int64")]
    x = np.maximum(n, EXACT) + add
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= EXACT, exact, series - (0.5 * np.log(np.pi) if add == 0.5 else 0.0))


def ln_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the block probability of a zeros and b ones."""
    return _ln_gamma(a, 0.5) + _ln_gamma(b, 0.5) - _ln_gamma(a + b, 1.0)


def canonical(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(streams: list[bytes], depth: int) -> np.ndarray:
    """The grams of all bytes of all streams; before a stream stand ends."""
    a = np.frombuffer(b"".join(END * depth + s for s in streams), "u1").astype("u8")
    n = len(a) - depth
    key = np.zeros(n, "u8")
    for d in range(1, depth + 1):
        key = (key << np.uint64(8)) | a[depth - d : depth - d + n]
    key = (key << np.uint64(8)) | a[depth:]
    lengths = np.array([len(s) for s in streams], "int64")
    inside = np.ones(n, bool)
    if depth and len(streams) > 1:
        starts = np.cumsum(lengths + depth)[:-1] - depth
        inside[(starts[:, None] + np.arange(depth)).ravel()] = False
    return key[inside]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, "int64")
    return keys[first], np.diff(np.append(first, len(keys)))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, "int64")
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Level:
    """One depth of a range of contexts: grams and counts; for each gram, its eight nodes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        x, context = keys & np.uint64(255), keys >> np.uint64(8)
        nodes, bits = [], []
        for t in range(8):
            nodes.append(context << np.uint64(8) | np.uint64(1 << t) | x >> np.uint64(8 - t))
            bits.append((x >> np.uint64(7 - t) & np.uint64(1)).astype("i1"))
        self.bits = np.stack(bits)
        self.nodes, at = np.unique(np.concatenate(nodes), return_inverse=True)
        self.at = at.reshape(8, -1).astype("i4")
        ones = np.bincount(at, (self.bits * counts).ravel(), len(self.nodes))
        every = np.bincount(at, np.tile(counts, 8), len(self.nodes))
        self.zeros, self.ones = every - ones, ones

    def above(self) -> tuple[np.ndarray, np.ndarray]:
        """The grams of one byte less of context."""
        return merged(self.keys >> np.uint64(16) << np.uint64(8) | self.keys & np.uint64(255), self.counts)

    def parents(self) -> np.ndarray:
        return self.nodes >> np.uint64(16) << np.uint64(8) | self.nodes & np.uint64(255)

    def weigh(self, below: "Level | None") -> None:
        """Weighted probability and the weight of stopping, from the level below (none: leaves)."""
        if below is None:
            self.weighted = ln_kt(self.zeros, self.ones)
            self.stop = np.ones(len(self.weighted))
            return
        self.weigh_by(below.parents(), below.weighted)

    def weigh_by(self, parents: np.ndarray, weighted: np.ndarray) -> None:
        """The same from weighted probabilities of children, given with their parents."""
        own = ln_kt(self.zeros, self.ones)
        deeper = np.bincount(np.searchsorted(self.nodes, parents), weighted, len(own))
        self.weighted = np.logaddexp(own, deeper) - LN2
        self.stop = np.exp(own - LN2 - self.weighted)

    def mix(self, above: "Level | None") -> None:
        """P(1) where a path ends here; sum and remaining weight for what goes deeper."""
        kt = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        if above is None:
            total, left = 0.0, 1.0
        else:
            i = np.searchsorted(above.nodes, self.parents())
            total, left = above.total[i], above.left[i]
        self.p = total + left * kt
        self.total, self.left = total + left * self.stop * kt, left * (1 - self.stop)

    def logs(self) -> np.ndarray:
        """log10 of the probability of each gram's bits, [8, grams]."""
        p = np.where(self.bits, self.p[self.at], 1 - self.p[self.at])
        return np.log10(np.clip(p, 1e-300, 1)).astype("f4")


def tree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels top to depth, weighed from below."""
    levels = []
    for d in range(depth, top - 1, -1):
        levels.append(Level(keys, counts))
        levels[-1].weigh(levels[-2] if d < depth else None)
        if d > top:
            keys, counts = levels[-1].above()
    return levels[::-1]


class Table:
    """Sorted keys -> value by hashing: who loses his slot goes to the next, smaller table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.parts, mult = [], 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(4, (7 * len(keys) // 5).bit_length())
            shift, mult = np.uint64(64 - bits), (mult * 6364136223846793005 + 1442695040888963407 | 1) % 2**64
            slot = (keys * np.uint64(mult)) >> shift
            k, v = np.full(1 << bits, 2**64 - 1, "u8"), np.zeros(1 << bits, values.dtype)
            k[slot] = keys
            won = k[slot] == keys
            v[slot[won]] = values[won]
            self.parts.append((np.uint64(mult), shift, k, v))
            keys, values = keys[~won], values[~won]

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing, "f8")
        todo = None
        for mult, shift, k, v in self.parts:
            mine = keys if todo is None else keys[todo]
            slot = (mine * mult) >> shift
            hit = k[slot] == mine
            if todo is None:
                out[hit] = v[slot[hit]]
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = v[slot[hit]]
                todo = todo[~hit]
        return out


class Scorer:
    """log10 probabilities of grams whose contexts lie in the model's range."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: (keys, logs) by depth from 0."""
        self.levels, self.depth = levels, len(levels) - 1
        keys, logs = levels[-1]
        self.whole = Table(keys, logs.sum(0))

    def score(self, grams: np.ndarray) -> np.ndarray:
        out = self.whole.get(grams, 1.0)
        rest = np.flatnonzero(out > 0)
        if len(rest):
            out[rest] = self._unseen(grams[rest])
        return out

    def _unseen(self, g: np.ndarray) -> np.ndarray:
        """Bits that the deepest level knows come from there, the following ones from the next and so on."""
        g, back = np.unique(g, return_inverse=True)
        x = g & np.uint64(255)
        done, total = np.zeros(len(g), "i8"), np.zeros(len(g))
        for d in range(self.depth, -1, -1):
            keys, logs = self.levels[d]
            if not len(keys):
                continue
            key = g >> np.uint64(8 * (self.depth - d + 1)) << np.uint64(8) | x
            i = np.searchsorted(keys, key)
            near, shared = np.zeros(len(g), "i8"), np.full(len(g), -1, "i8")
            for j in (np.minimum(i, len(keys) - 1), np.maximum(i - 1, 0)):
                same = keys[j] >> np.uint64(8) == key >> np.uint64(8)
                prefix = np.where(same, _LEADING[((keys[j] ^ key) & np.uint64(255)).astype("i8")], -1)
                near, shared = np.where(prefix > shared, j, near), np.maximum(shared, prefix)
            for t in range(8):
                # nodes up to the first bit that differs were seen; there the other branch is taken
                here = (done == t) & (shared >= t)
                if here.any():
                    one = logs[t, near[here]].astype("f8")
                    total[here] += np.where(shared[here] > t, one, np.log10(np.maximum(-np.expm1(one * LN10), 1e-300)))
                    done[here] += 1
        return (total + (8 - done) * np.log10(0.5))[back]


_LEADING = np.array([8 - int(v).bit_length() for v in range(256)])
