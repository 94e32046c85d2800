"""An adaptive context-mixing range coder for blocks of token ids, over many blocks at once.

Every block is coded by itself, with a fresh model, so each can be read alone. The numpy
steps handle the n-th id of all blocks together: each block is one lane.

For each id the two ids before it and the id before it name a slot each (order 2 and order
1) that holds the id last seen there and how often that was right. Whether the prediction of
the slot that was right more often holds is coded with a probability mixed in the logistic
domain from the confidences of both slots and of the lane (order 0), with weights that adapt;
a prediction less likely than ``LEAST`` is not worth a code and only learnt from.
An id that it does not give is coded by the order-0 prediction of whole ids: a tree of
``DIGITS`` digits whose every node has adaptive counts of the digits below it, so the counts
of all ids seen in the block shape the code. All arithmetic is on integers, so machines agree.
"""

from __future__ import annotations

import math

import numpy as np

#: Digits of an id; the model has room for a count of each possible id in each lane.
DIGITS = 3
SLOTS = 2048
#: How far a slot's first prediction is trusted, out of 4,096.
FIRST = 1024
#: Least probability, out of 4,096, of a prediction that is asked for.
LEAST = 256
#: What an id's digits gain each time they occur; the sum of a node's counts, and the single count in a byte, above which they are halved.
GAIN, MOST, MOST_BYTE = 24, 8192, 255 - 2 * 24
#: Probabilities have 12 bits in the model and never reach 0 or 1.
_ONE = 4096
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4096 - p - 0.5))))) for p in range(4096)], np.int32)
_TOP = 1 << 32
_12, _32 = np.uint64(12), np.uint64(32)


class _Writer:
    """Intervals of 64 bits that give out words of 32, so a lane gives out one in some four ids."""

    def __init__(self, lanes: int, longest: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.at = np.zeros(lanes, np.int64)
        self.out = np.zeros((lanes, 0), np.uint32)
        self._widen(16 + longest // 2)

    def _widen(self, width: int) -> None:
        self.out = np.pad(self.out, ((0, 0), (0, width - self.out.shape[1])))
        self.flat, self.width = self.out.reshape(-1), width

    def room(self) -> None:
        """Make sure that the next id of every lane fits."""
        if self.at.max() + 8 > self.width:
            self._widen(2 * self.width)

    def code(self, lanes: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow each lane's interval to ``size`` parts (of the width ``part``) from ``start``."""
        before = self.low.take(lanes)
        low = before + part * start.astype(np.uint64, copy=False)
        wide = part * np.asarray(size, np.uint64)
        over = low < before
        if over.any():
            self._carry(lanes[over])
        k = np.flatnonzero(wide < _TOP)
        if len(k):
            own, top = lanes.take(k), low.take(k)
            at = self.at.take(own)
            self.flat[own * self.width + at] = top >> _32
            self.at[own] = at + 1
            low[k] = top << _32
            wide[k] = wide.take(k) << _32
        self.low[lanes], self.range[lanes] = low, wide

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.at[lanes] - 1
        while len(lanes):
            self.out[lanes, at] += np.uint32(1)
            full = self.out[lanes, at] == 0
            lanes, at = lanes[full], at[full] - 1

    def payloads(self) -> list[bytes]:
        for k in range(2):
            self.out[np.arange(len(self.at)), self.at + k] = (self.low >> np.uint64(32 - 32 * k)) & np.uint64(0xFFFFFFFF)
        return [row[: n + 2].astype(">u4").tobytes() for row, n in zip(self.out, self.at, strict=True)]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        ends = np.cumsum([len(p) // 4 for p in payloads])
        self.data = np.frombuffer(b"".join(payloads) + bytes(8), ">u4").astype(np.uint64)
        self.at = np.concatenate(([0], ends[:-1])).astype(np.int64) + 2
        self.end = len(self.data) - 1
        self.value = (self.data[self.at - 2] << _32) | self.data[self.at - 1]
        self.range = np.full(len(payloads), 0xFFFFFFFFFFFFFFFF, np.uint64)

    def place(self, lanes: np.ndarray, part: np.ndarray) -> np.ndarray:
        """In which of the parts of the width ``part`` each lane's value lies."""
        return (self.value.take(lanes) // part).astype(np.int64)

    def code(self, lanes: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        value = self.value.take(lanes) - part * start.astype(np.uint64, copy=False)
        wide = part * np.asarray(size, np.uint64)
        k = np.flatnonzero(wide < _TOP)
        if len(k):
            own = lanes.take(k)
            at = self.at.take(own)
            value[k] = (value.take(k) << _32) | self.data.take(np.minimum(at, self.end))
            self.at[own] = at + 1
            wide[k] = wide.take(k) << _32
        self.value[lanes], self.range[lanes] = value, wide


class _Model:
    """What all lanes have seen so far; the same steps serve for writing and reading."""

    def __init__(self, lanes: int, coder: _Writer | _Reader, ids: int):
        self.coder = coder
        self.writing = isinstance(coder, _Writer)
        # Both orders' slots, order 2 first: the id last seen and one, and in the lowest 12 bits its trust; zero is empty.
        if ids >= 1 << 19:
            raise ValueError("too many ids")
        self.slots, self.order1 = np.zeros(2 * lanes * SLOTS, np.int32), lanes * SLOTS
        self.plain = np.full(2 * lanes, FIRST, np.int32)
        self.weights = [np.full(2 * lanes, 1 << 14, np.int32) for _ in range(3)]
        self.base = base = max(2, math.ceil(round(ids ** (1 / DIGITS), 6)))
        # The last digits have nearly all nodes, so their counts are bytes.
        self.counts = [np.ones((lanes * base**k, base), np.uint8 if k == DIGITS - 1 else np.int16) for k in range(DIGITS)]

    def mix(self, lanes: np.ndarray, best: np.ndarray, trust: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """How likely predictions are right, out of ``_ONE``, and what that was mixed from; ``best`` is the order that gave each."""
        at = lanes * 2 + best
        plain = self.plain.take(at)
        inputs = [_STRETCH.take(x) for x in (*trust, plain)]
        weights = [w.take(at) for w in self.weights]
        dot = sum((w >> 4) * x >> 6 for w, x in zip(weights, inputs, strict=True)) >> 6
        return _SQUASH.take(np.minimum(np.maximum(dot, -2047), 2047) + 2047), [at, plain, *inputs, *weights]

    def flag(self, lanes: np.ndarray, p: np.ndarray, truth: np.ndarray | None) -> np.ndarray:
        """Code whether predictions hold."""
        part = self.coder.range.take(lanes) >> _12
        bit = truth if self.writing else self.coder.place(lanes, part) < p
        self.coder.code(lanes, part, np.where(bit, 0, p), np.where(bit, p, _ONE - p))
        return bit

    def learn(self, p: np.ndarray, of: list[np.ndarray], bit: np.ndarray) -> None:
        """Adapt to whether predictions held, be that coded or not."""
        at, plain, inputs, weights = of[0], of[1], of[2:5], of[5:]
        error = np.where(bit, _ONE, 0) - p
        for held, w, x in zip(self.weights, weights, inputs, strict=True):
            held[at] = np.minimum(np.maximum(w + (x * error >> 8), -(1 << 18)), 1 << 18)
        self.plain[at] = plain + np.where(bit, (4095 - plain) >> 5, -(plain >> 5))

    def digit(self, table: np.ndarray, lanes: np.ndarray, node: np.ndarray, truth: np.ndarray | None) -> np.ndarray:
        """Code a digit by the counts of its node, and count it."""
        counts = table.take(node, axis=0)
        upto = np.cumsum(counts, axis=1, dtype=np.int32)
        total = upto[:, -1]
        part = self.coder.range.take(lanes) // total.astype(np.uint64)
        digit = truth if self.writing else (upto > np.minimum(self.coder.place(lanes, part), total - 1)[:, None]).argmax(axis=1)
        cell = np.arange(len(lanes)) * self.base + digit
        size = counts.reshape(-1).take(cell)
        self.coder.code(lanes, part, upto.reshape(-1).take(cell) - size, size)
        table.reshape(-1)[node * self.base + digit] = size + table.dtype.type(GAIN)
        full = node[size > MOST_BYTE if table.dtype == np.uint8 else total > MOST]
        if len(full):
            table[full] -= table[full] >> 1
        return digit

    def fresh(self, lanes: np.ndarray, truth: np.ndarray | None) -> np.ndarray:
        """Code ids that no context predicted, by the order-0 counts of their digits."""
        found = np.zeros(len(lanes), np.int64)
        for k, table in enumerate(self.counts):
            digit = None if truth is None else truth // self.base ** (DIGITS - 1 - k) % self.base
            found = found * self.base + self.digit(table, lanes, lanes * self.base**k + found, digit)
        return found

    def step(self, n: int, before: np.ndarray, before2: np.ndarray, truth: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first ``n`` lanes."""
        lanes = np.arange(n)
        own = lanes * SLOTS
        slots = np.concatenate((own + (((before2[:n] * 40503 + before[:n] * 30011) >> 3) & (SLOTS - 1)), own + (self.order1 + ((before[:n] * 40503 >> 4) & (SLOTS - 1)))))
        found = np.full(n, -1, np.int32)
        held = self.slots.take(slots)
        seen, was = (held >> 12) - 1, held & 4095
        guesses, trust = (seen[:n], seen[n:]), (was[:n], was[n:])
        # The prediction that was right more often; a slot that is empty has no trust.
        best = (trust[1] > trust[0]).astype(np.int64)
        guess = np.where(best, guesses[1], guesses[0])
        own = np.flatnonzero(guess >= 0)
        if len(own):
            p, of = self.mix(own, best.take(own), [x.take(own) for x in trust])
            use = np.flatnonzero(p >= LEAST)
            if len(use):
                asked = own.take(use)
                bit = self.flag(asked, p.take(use), None if truth is None else truth.take(asked) == guess.take(asked))
                hit = asked[bit]
                found[hit] = guess.take(hit)
        left = np.flatnonzero(found < 0)
        if len(left):
            found[left] = self.fresh(left, None if truth is None else truth.take(left))
        if len(own):
            self.learn(p, of, found.take(own) == guess.take(own))
        now = np.concatenate((found, found))
        later = np.where(seen == now, was + (4095 - was >> 2), np.where(seen < 0, FIRST, was - (was >> 2)))
        self.slots[slots] = (now + 1 << 12) | later
        return found


def _walk(lengths: np.ndarray, coder: _Writer | _Reader, ids: int, blocks: np.ndarray | None) -> np.ndarray:
    """Code all blocks, one a column; ``lengths`` fall, and so the lanes still busy are the first ones."""
    model = _Model(len(lengths), coder, ids)
    # A row for each step, so that a step's ids lie together.
    found = np.zeros((int(lengths[0]) if len(lengths) else 0, len(lengths)), np.int32)
    before = np.zeros(len(lengths), np.int64)
    before2 = np.zeros(len(lengths), np.int64)
    for t in range(len(found)):
        if blocks is not None:
            coder.room()
        n = int(np.searchsorted(-lengths, -t, "left"))
        now = model.step(n, before, before2, None if blocks is None else blocks[t, :n].astype(np.int64))
        if blocks is None:
            found[t, :n] = now
        before2[:n] = before[:n]
        before[:n] = now
    return found.T


def encode(blocks: list[np.ndarray], ids: int) -> list[bytes]:
    """The payload of each block of ids (0 <= id < ``ids``, which is at most a few hundred thousand)."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    order = np.argsort(-lengths, kind="stable")
    table = np.zeros((int(lengths.max()), len(blocks)), np.int32)
    for row, i in enumerate(order):
        table[: lengths[i], row] = blocks[i]
    coder = _Writer(len(blocks), len(table))
    _walk(lengths[order], coder, ids, table)
    payloads = coder.payloads()
    found: list[bytes] = [b""] * len(blocks)
    for row, i in enumerate(order):
        found[i] = payloads[row]
    return found


def decode(payloads: list[bytes], lengths: list[int], ids: int) -> list[np.ndarray]:
    """The ids of each block."""
    if not payloads:
        return []
    sizes = np.array(lengths)
    order = np.argsort(-sizes, kind="stable")
    table = _walk(sizes[order], _Reader([payloads[i] for i in order]), ids, None)
    found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(payloads)
    for row, i in enumerate(order):
        found[i] = table[row, : sizes[i]]
    return found
