"""Word shingles, HyperMinHash sketches and exact similarity of shingle sets, as arrays.

A shingle is known by a 64-bit hash. A sketch deals the shingles to registers;
a register keeps the least value dealt to it in 16 bits: the number of leading
zeros and the bits behind the first one. Equal registers of two sketches
estimate their similarity, less the share that is equal by chance.
"""

from __future__ import annotations

import numpy as np

from .common import SPACES, mixed

REGISTERS = 128
MANTISSA = 10
BANDS = 48
# Share of pairs just similar enough that may miss all bands, were registers independent.
MISSED = 1e-6
# Bits of a value behind those that choose the register.
VALUE_BITS = 57
# Constant of the expected chance collisions of a HyperMinHash sketch.
COLLISIONS = 0.169919487159739

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_BASE = 0x9E3779B97F4A7C55
_SEED = np.uint64(0x5851F42D4C957F2D)

_dice = np.random.default_rng(20)
# Where an empty register looks for a value.
_OFFSET, _STRIDE = _dice.integers(0, REGISTERS, REGISTERS), 2 * _dice.integers(0, REGISTERS // 2, REGISTERS) + 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        power = np.ones(1, np.uint64)
        while len(power) < n:
            step = np.uint64(pow(base, len(power), 1 << 64))
            power = np.concatenate([power, power * step])
        out.append(power[:n])
    return out[0], out[1]


def shingle_sets(texts: list[bytes], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer words than ``width`` is one shingle, one without words none.
    """
    flat = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), np.uint8)
    if not len(flat):
        return [np.zeros(0, np.uint64) for _ in texts]
    space = _IS_SPACE[flat]
    begin = np.flatnonzero(~space & np.append(True, space[:-1]))
    end = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    power, inverse = _powers(len(flat))
    total = np.append(np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power))
    word = (total[end] - total[begin]) * inverse[begin]
    word = mixed(word ^ mixed((end - begin).astype(np.uint64)))
    # Words of text i are those that begin before its end.
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(begin, ends)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    run = np.zeros(max(len(word) - width + 1, 0), np.uint64)
    for k in range(width):
        run = run + word[k:len(word) - width + 1 + k] * factors[k]
    run = mixed(run)
    sets, first = [], 0
    for last in upto.tolist():
        n = last - first
        if n >= width:
            sets.append(np.unique(run[first:last - width + 1]))
        elif n:
            short = np.uint64(n)
            for k in range(n):
                short = short + word[first + k:first + k + 1] * factors[k]
            sets.append(mixed(short))
        else:
            sets.append(np.zeros(0, np.uint64))
        first = last
    return sets


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that tell shingle sets apart, as two columns."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    out = np.zeros((len(sets), 2), np.uint64)
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    for column, seed in enumerate((np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))):
        if len(starts):
            sums = np.add.reduceat(mixed(flat ^ seed)[:-1], starts)
            out[some, column] = mixed(sums + sizes[some].astype(np.uint64) * seed)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set; 0 is an empty register."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full(len(sets) * REGISTERS, np.uint64(1) << np.uint64(VALUE_BITS))
    if sizes.sum():
        value = mixed(np.concatenate(sets) ^ _SEED)
        register = (value >> np.uint64(VALUE_BITS)).astype(np.int64)
        value &= (np.uint64(1) << np.uint64(VALUE_BITS)) - np.uint64(1)
        np.minimum.at(least, np.repeat(np.arange(len(sets)), sizes) * REGISTERS + register, value)
    empty = least >> np.uint64(VALUE_BITS) == 1
    _, bits = np.frexp(least.astype(np.float64))
    bits = np.minimum(bits, VALUE_BITS).astype(np.int64)
    zeros = np.minimum(VALUE_BITS - bits, 62)
    down = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
    up = np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64)
    mantissa = ((least >> down) << up) & np.uint64((1 << MANTISSA) - 1)
    packed = ((zeros + 1) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    packed[empty] = 0
    return packed.reshape(len(sets), REGISTERS)


def band_places(least: float) -> np.ndarray:
    """Which registers make up each band: as many as still find pairs of similarity ``least``."""
    rows = max([r for r in range(1, 17) if (1 - least**r) ** BANDS <= MISSED], default=1)
    dice = np.random.default_rng(21)
    places = np.concatenate([dice.permutation(REGISTERS) for _ in range(-(-BANDS * rows // REGISTERS))])
    return places[:BANDS * rows].reshape(BANDS, rows)


def band_keys(registers: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys of the bands; empty registers borrow from others, always in the same order of places."""
    dense = registers.copy()
    for attempt in range(REGISTERS):
        missing = dense == 0
        if not missing.any():
            break
        lent = registers[:, (_OFFSET + attempt * _STRIDE) % REGISTERS]
        dense[missing] = lent[missing]
    keys = np.empty((len(registers), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(registers), np.uint64(band + 1))
        for column in places[band]:
            key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + dense[:, column].astype(np.uint64) + np.uint64(1))
        keys[:, band] = key
    return keys


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of pairs of sketches, and the registers that it rests on."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = COLLISIONS * 2.0 ** (np.log2(REGISTERS) - MANTISSA + 1) * 4 * ratio / (1 + ratio) ** 2
    # Only registers with different least shingles can be equal by chance.
    chance = chance * (1 - equal / np.maximum(used, 1))
    return np.clip((equal - chance) / np.maximum(used, 1), 0, 1), used


def may_be_similar(similarity: np.ndarray, used: np.ndarray, least: float) -> np.ndarray:
    """Whether a pair may reach ``least``: the estimate is within five standard errors."""
    return similarity >= least - 5 * np.sqrt(least * (1 - least) / np.maximum(used, 1))


def forest(n: int, linked) -> np.ndarray:
    """The component of each of ``n`` items, named by its first item.

    ``linked(x, others)`` tells which of the others are linked with x. Every
    item is compared with those that are not reached yet, so no link between
    components is missed and items near the first one cost one comparison.
    """
    root, open_ = np.full(n, -1, np.int64), np.arange(n)
    while len(open_):
        first = open_[0]
        root[first] = first
        open_, waiting = open_[1:], [first]
        while waiting and len(open_):
            hit = linked(waiting.pop(), open_)
            reached = open_[hit]
            root[reached] = first
            waiting.extend(reached.tolist())
            open_ = open_[~hit]
    return root


def similar_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Components of sets of which 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(names), np.int64)
    state = {"open": None, "flat": None, "starts": None}

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        if state["open"] is None or len(state["open"]) != len(others):
            counts = sizes[others]
            at = np.cumsum(counts) - counts
            place = np.arange(counts.sum()) + np.repeat(starts[others] - at, counts)
            state.update(open=others, flat=flat[place], starts=at)
        own = flat[starts[x]:starts[x] + sizes[x]]
        marked[own] = 1
        both = np.add.reduceat(marked[state["flat"]], state["starts"])
        marked[own] = 0
        return 100 * both >= percent * (sizes[x] + sizes[others] - both)

    return forest(len(sets), linked)
