"""Logistic context mixing over hashed contexts: the tables, the mixer, its gates and its refinement.

A text is predicted bit by bit. For each of ORDERS, the preceding bytes and the byte's bits so far are a context that
holds how often a 0 and a 1 followed in training; every context of the training texts is kept. The contexts' log-odds are
mixed by the sum of two sets of weights, each selected by a gate: one by the bit's position, the bytes since the last
space and the longest context that was seen, the other by position and the byte before. An adaptive map, selected by the
byte's bits so far, refines the mixed probability by what was observed at it. Weights and map are fitted to all training
windows by rounds of sums, then kept, so that no text's score depends on the texts scored before it. A round's sums are whole
numbers: added up in any order they are the same.
"""

from __future__ import annotations

import numpy as np

ORDERS = (1, 2, 3, 4, 5)
WINDOW = 6  # bytes: the longest context and the byte itself
#: Orders whose contexts are few enough for a place each, with or without counts (2**24 at most).
DENSE = 2
#: Counts above which a context's are scaled down.
MOST_COUNT = 60_000
PRIOR, EDGE, LEVELS = 0.4, 1e-6, 33
#: Rounds in which the weights are fitted; gates of a position in either set; sums are kept in such parts of one.
ROUNDS, GATES, PARTS = 4, (WINDOW * (len(ORDERS) + 1), 256), 4096
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def windows(data: np.ndarray) -> np.ndarray:
    """The WINDOW bytes that end at each byte from the WINDOW-th on, as one number each."""
    n = max(len(data) - WINDOW + 1, 0)
    return np.ndarray(n, ">u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,)).astype(np.uint64) >> np.uint64(8 * (8 - WINDOW))


def _context(window: np.ndarray, order: int) -> np.ndarray:
    return (window >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)


def keys(window: np.ndarray, order: int, node: np.ndarray) -> np.ndarray:
    """64 bits for each context of an order and node."""
    mixed = (_context(window, order) + np.uint64(order)) * _A
    mixed = (mixed ^ (mixed >> np.uint64(32)) ^ (node * _B)) * _A
    return mixed ^ (mixed >> np.uint64(29))


def places(window: np.ndarray, order: int, node: np.ndarray) -> np.ndarray:
    """The place of each context of a dense order and node."""
    return (_context(window, order) << np.uint64(8)) | node


def neighbourhood(window: np.ndarray) -> np.ndarray:
    """64 bits from the longest context of a dense order and one byte more: all longer contexts of a window have the same."""
    mixed = (_context(window, DENSE + 1) + np.uint64(1)) * _B
    return (mixed ^ (mixed >> np.uint64(31))) * _A


def since_space(window: np.ndarray) -> np.ndarray:
    """Bytes between the last space and the byte that the window ends with; WINDOW - 1 if the window holds none."""
    out = np.full(len(window), WINDOW - 1)
    for back in range(WINDOW - 1, 0, -1):
        out[(window >> np.uint64(8 * back)) & np.uint64(255) == np.uint64(32)] = back - 1
    return out


def nodes(window: np.ndarray):
    """For each bit of the last byte: (position, node of the bits before it, the bit)."""
    byte = window & np.uint64(255)
    for position in range(8):
        node = (byte | np.uint64(256)) >> np.uint64(8 - position)
        yield position, node, ((byte >> np.uint64(7 - position)) & np.uint64(1)).astype(bool)


def contexts(window: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, zeros, ones), sorted by key, of an order's contexts in the windows with their counts; a dense order's keys are places."""
    low = window & np.uint64((1 << (8 * order + 8)) - 1)
    if (low[1:] < low[:-1]).any():
        by = np.argsort(low)
        low, counts = low[by], counts[by]
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = counts.astype(np.int64)
    where, zero, one = [], [], []
    for position, _, bit in nodes(low):  # in order, the windows of a context and node are neighbours
        before = low >> np.uint64(8 - position)
        first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        node = (((low[first] & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - position))
        where.append((places if order <= DENSE else keys)(low[first], order, node))
        ones = np.add.reduceat(np.where(bit, counts, 0), first)
        zero.append(np.add.reduceat(counts, first) - ones)
        one.append(ones)
    where = np.concatenate(where)
    by = np.argsort(where)
    where = where[by]
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
    return where[first], np.add.reduceat(np.concatenate(zero)[by], first), np.add.reduceat(np.concatenate(one)[by], first)


def scaled(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in 16 bits each, their ratio kept."""
    most = np.maximum(np.maximum(zero, one) / MOST_COUNT, 1)
    return np.ceil(zero / most).astype(np.uint16), np.ceil(one / most).astype(np.uint16)


class Dense:
    """The counts of a dense order: a place for each context."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.zero, self.one = (np.zeros(1 << (8 * order + 8), np.uint16) for _ in range(2))

    def add(self, place: np.ndarray, zero: np.ndarray, one: np.ndarray) -> None:
        """Counts of places that had none."""
        self.zero[place], self.one[place] = scaled(zero, one)

    def counts(self, window: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = places(window, self.order, node)
        return self.zero[at].astype(np.float32), self.one[at].astype(np.float32)


class Checked:
    """The counts of a longer order's contexts, each known by a check of its key.

    Every sorted key lies at its home or the next free place; check, zeros and ones share 64 bits. Half of the places
    stay free, and an entry without counts is free.
    """

    def __init__(self, window: np.ndarray, counts: np.ndarray, order: int) -> None:
        key, zero, one = contexts(window, counts, order)
        some = (zero + one) > 0
        key, (zero, one) = key[some], scaled(zero[some], one[some])
        self.order, self.size = order, max(1 << 10, 2 * len(key))
        at = np.arange(len(key))
        place = at + np.maximum.accumulate(self._home(key) - at) if len(key) else at
        self.entries = np.zeros(max(self.size, int(place[-1]) + 1 if len(key) else 0) + 1, np.uint64)
        self.entries[place] = (key << np.uint64(32)) | (zero.astype(np.uint64) << np.uint64(16)) | one.astype(np.uint64)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (((key >> np.uint64(32)) * np.uint64(self.size)) >> np.uint64(32)).astype(np.int64)

    def counts(self, window: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = keys(window, self.order, node)
        at, check = self._home(key), key.astype(np.uint32)
        found = self.entries[at]
        wrong = (found >> np.uint64(32)).astype(np.uint32) != check
        look = np.flatnonzero(wrong & (found.astype(np.uint32) != 0))
        while len(look):
            at[look] += 1
            now = self.entries[at[look]]
            found[look] = now
            differs = (now >> np.uint64(32)).astype(np.uint32) != check[look]
            wrong[look] = differs
            look = look[differs & (now.astype(np.uint32) != 0)]
        found[wrong] = 0
        return ((found >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32), (found & np.uint64(0xFFFF)).astype(np.float32)


def gates(since: np.ndarray, before: np.ndarray, position: int, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """since: bytes since the last space; before: the byte before."""
    return (position * WINDOW + since) * (len(ORDERS) + 1) + longest, position * 256 + before


def looked_up(window: np.ndarray, counts, own: bool):
    """For each bit of the last byte: (position, node, the bit, the orders' log-odds, gates).

    counts(i, position, node): zeros and ones of ORDERS[i] at each window; own: one own occurrence of each is left out.
    """
    since, before = since_space(window), ((window >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    for position, node, bit in nodes(window):
        inputs, longest = np.empty((len(ORDERS), len(window)), np.float32), np.zeros(len(window), np.int64)
        for i in range(len(ORDERS)):
            zero, one = counts(i, position, node)
            if own:
                zero, one = np.maximum(zero - ~bit, 0), np.maximum(one - bit, 0)
            inputs[i] = odds(zero, one)
            longest[zero + one > 0] = i + 1
        yield position, node, bit, inputs, gates(since, before, position, longest)


def odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR)))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Mixer:
    def __init__(self) -> None:
        self.weights = [np.full((8 * WINDOW * (len(ORDERS) + 1), len(ORDERS)), 0.15), np.full((8 * 256, len(ORDERS)), 0.15)]
        self.map = np.tile(squash(np.linspace(-8, 8, LEVELS)), (256, 1))

    @staticmethod
    def _level(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.clip(mixed, -7.999, 7.999) + 8) * ((LEVELS - 1) / 16)
        low = at.astype(np.int64)
        return low, at - low

    def mix(self, inputs: np.ndarray, gate: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return sum(x * (a[gate[0]] + b[gate[1]]) for x, a, b in zip(inputs, self.weights[0].T.copy(), self.weights[1].T.copy()))

    def refine(self, mixed: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The probability of a 1."""
        low, share = self._level(mixed)
        node = node.astype(np.int64)
        mapped = self.map[node, low] * (1 - share) + self.map[node, low + 1] * share
        return np.clip(0.5 * mapped + 0.5 * squash(mixed), EDGE, 1 - EDGE)

    def sums(self, window: np.ndarray, times: np.ndarray, counts, mapping: bool, batch: int = 1 << 16) -> np.ndarray:
        """What training windows say of the weights: each gate's gradient and curvature; mapping: of the map, what was observed at its levels.

        A row for each position of a bit, in PARTS of one. counts(w): the lookup of some windows, as looked_up() takes it.
        """
        n = len(ORDERS)
        out = np.zeros((8, 2 * 256 * LEVELS // 8)) if mapping else np.zeros((8, sum(GATES), n + n * (n + 1) // 2))
        seen = np.zeros((2, 256 * LEVELS))
        for at in range(0, len(window), batch):
            w, t = window[at : at + batch], times[at : at + batch].astype(float)
            for position, node, bit, inputs, gate in looked_up(w, counts(w), True):
                mixed = self.mix(inputs, gate)
                if mapping:
                    low, share = self._level(mixed)
                    here = node.astype(np.int64) * LEVELS + low
                    for where, part in ((here, t * (1 - share)), (here + 1, t * share)):
                        seen += [np.bincount(where, part * bit, 256 * LEVELS), np.bincount(where, part, 256 * LEVELS)]
                    continue
                p = squash(mixed)
                error, curve = (bit - p) * t, p * (1 - p) * t
                both = (gate[0] - position * GATES[0]) * GATES[1] + (gate[1] - position * GATES[1])
                bent = [inputs[i] * curve for i in range(n)]
                for k, x in enumerate([*(inputs[i] * error for i in range(n)), *(bent[i] * inputs[j] for i in range(n) for j in range(i + 1))]):
                    table = np.bincount(both, x, GATES[0] * GATES[1]).reshape(GATES)
                    out[position, :, k] += np.append(table.sum(1), table.sum(0))
        return np.rint((seen.reshape(8, -1) if mapping else out.reshape(8, -1)) * PARTS).astype(np.int64)

    def step(self, sums: np.ndarray) -> None:
        """A Newton step of each gate by itself, half as far since two gates share each input."""
        n = len(ORDERS)
        told = sums.reshape(8, sum(GATES), -1) / PARTS
        curve = np.zeros((*told.shape[:2], n, n))
        i, j = np.tril_indices(n)
        curve[..., i, j] = curve[..., j, i] = told[..., n:]
        move = np.clip(np.linalg.solve(curve + np.eye(n), told[..., :n, None])[..., 0] / 2, -0.5, 0.5)
        for weights, part in zip(self.weights, np.split(move, [GATES[0]], axis=1)):
            weights += part.reshape(weights.shape)

    def remap(self, sums: np.ndarray) -> None:
        hits, all_ = sums.reshape(2, 256, LEVELS) / PARTS
        self.map = (hits + 16 * squash(np.linspace(-8, 8, LEVELS))) / (all_ + 16)

    def fit(self, window: np.ndarray, times: np.ndarray, counts, rounds: int = ROUNDS) -> Mixer:
        """Over training windows held here. counts(i, position): zeros and ones of ORDERS[i] at each window; one own occurrence of each is left out."""
        lookup = lambda w: lambda i, position, node: counts(i, position)
        for _ in range(rounds):
            self.step(self.sums(window, times, lookup, False, max(1, len(window))))
        self.remap(self.sums(window, times, lookup, True, max(1, len(window))))
        return self


def log10(mixer: Mixer, tables: list, window: np.ndarray, batch: int = 1 << 16) -> np.ndarray:
    """log10 probability of each window's last byte after the bytes before it; tables: the counts of each order."""
    out = np.zeros(len(window))
    for at in range(0, len(window), batch):
        w = window[at : at + batch]
        total = np.zeros(len(w))
        for _, node, bit, inputs, gate in looked_up(w, lambda i, _, node: tables[i].counts(w, node), False):
            p = mixer.refine(mixer.mix(inputs, gate), node)
            total += np.log10(np.where(bit, p, 1 - p))
        out[at : at + batch] = total
    return out
