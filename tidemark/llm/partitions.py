"""Signatures of sets by universe partition: equal or nearly equal parts of two sets that are similar.

Sizes fall into bands; a scheme serves the pairs whose smaller set is in its band, and their larger set is then in that band
or the next. If 100 |A n B| >= percent |A u B|, the sets differ in at most h = a (100 - percent) / percent members, a being the smaller
size. A scheme hashes the universe into m segments and gives segment i a reach v_i: 1, the parts in it must be equal, or 2, they
may differ in one member (found through the parts with one member left out). If the reaches sum to h + 1 + e, two similar sets
agree within reach on segments worth e + 1 at least.

A segment with fewer than `least` members says little and may be skipped. Two sets skip an equal part both or neither, so as long
as a set skips no more than e segments nothing is lost; a set that skips more ("over") also indexes its skipped parts, and
since a pair can only be lost if both its sets are over, those meet there. So every similar pair shares a signature.

allocate() picks m, e, least and the number of wide segments (reach 2) of a scheme by cost: signatures to index, and unrelated
sets expected to meet in parts of j members.
"""

from __future__ import annotations

import functools
from math import comb

import numpy as np

from tidemark.llm.shingles import U, mix


@functools.lru_cache(maxsize=8)
def bands(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """Least sizes of the bands: a set of band i links with sets of band i + 1 at most."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, dtype=np.int64)


@functools.lru_cache(maxsize=4096)
def allocate(band: int, percent: int, common: float = 0.1, sets: float = 1e5, check: float = 5.0) -> tuple[int, int, int, int]:
    """m, e, least, wide of the scheme; m is 0 if only equal sets can link.

    common: chance that an unrelated set also has a given member; sets: how many it is compared with; check: what one such pair
    costs, in signatures.
    """
    edge = bands(percent)
    size = int(edge[band + 1]) - 1
    most = size * (100 - percent) // percent
    if most == 0:
        return 0, 0, 0, 0
    typical = (int(edge[band]) + size) // 2

    def risk(m: int, least: int) -> float:
        p, total = 1.0 / m, 0.0
        for j in range(least, min(typical, least + 12) + 1):
            chance = comb(typical, j) * p**j * (1 - p) ** (typical - j) if m > 1 else float(j == typical)
            total += chance * common**j
        return total

    best = None
    for wide in {0, *(w for w in (1, 2, most // 4, most // 2, (most + 1) // 2) if 0 < w <= (most + 1) // 2)}:
        m = most + 1 - wide
        part = typical / m
        cost = m + wide * part + check * sets * ((m - wide) * risk(m, 0) + wide * (risk(m, 0) + part * risk(m, 0) / common))
        if best is None or cost < best[0]:
            best = (cost, m, 0, 0, wide)
    for least in (1, 2, 3):
        e = 0
        for _ in range(60):  # enough slack for nearly all sets to stay within it
            m = most + 1 + e
            p = 1.0 / m
            small = sum(comb(typical, j) * p**j * (1 - p) ** (typical - j) for j in range(least)) if typical < 5000 else np.exp(-typical * p) * sum((typical * p) ** j / [1, 1, 2][j] for j in range(least))
            need = int(np.ceil(m * small + 3 * np.sqrt(m * small + 0.01)))
            if need <= e:
                break
            e = need
        else:
            continue
        m = most + 1 + e
        cost = m - m * small + check * sets * m * (risk(m, least) if typical < 5000 else common**least)
        if cost < best[0]:
            best = (cost, m, e, least, 0)
    return best[1:]


def _sums(segment: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit numbers by segment, modulo 2^64."""
    low = np.bincount(segment, (value & U(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(segment, (value >> U(32)).astype(np.float64), n)
    return low + (np.mod(high, 2.0**32).astype(np.uint64) << U(32))


def signatures(sets: list[np.ndarray], percent: int, total: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set), for all sets at once; sets are arrays of distinct hashes, of a corpus of `total` sets.

    All sets of a corpus must be given the same total.
    """
    corpus = float(10 ** len(str(max(1, total) - 1)))  # few different plans, and all of one corpus the same
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    if not len(owner):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    members = np.concatenate(sets)
    place, value = mix(members ^ U(0x5851F42D4C957F2D)) >> U(32), mix(members + U(0x14057B7EF767814F))
    band = np.searchsorted(bands(percent), sizes, side="right") - 1
    out_sig, out_set = [], []
    for scheme in (band, band - 1):
        plan = np.array([allocate(int(s), percent, sets=corpus) if s >= 0 and n else (0, 0, 0, 0) for s, n in zip(scheme, sizes, strict=True)], dtype=np.int64).reshape(-1, 4)
        m, slack, least, wide = plan.T
        base = np.concatenate(([0], np.cumsum(m)))
        own = m[owner] > 0
        if not own.any():
            continue
        mine, v = owner[own], value[own]
        segment = base[mine] + ((place[own] * m[mine].astype(np.uint64)) >> U(32)).astype(np.int64)
        n = int(base[-1])
        count, total = np.bincount(segment, minlength=n), _sums(segment, v, n)
        of = np.repeat(np.arange(len(sets)), m)
        number = np.arange(n) - base[of]
        tag = mix(((scheme[of] + 1) << 32).astype(np.uint64) + number.astype(np.uint64))
        small = count < least[of]
        over = np.bincount(of[small], minlength=len(sets)) > slack
        kept = ~small | over[of]
        name = lambda t, c, g: mix(t + mix(c.astype(np.uint64) + g))
        out_sig.append(name(total[kept], count[kept], tag[kept]))
        out_set.append(of[kept])
        out = np.flatnonzero(number[segment] < wide[mine])
        if len(out):
            g = segment[out]
            out_sig.append(name(total[g] - v[out], count[g] - 1, tag[g]))
            out_set.append(mine[out])
    return (np.concatenate(out_sig), np.concatenate(out_set)) if out_sig else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
