"""Removal of repeated byte strings with suffix arrays: every byte under a string of `length` bytes that also starts elsewhere.

A suffix array over all text cannot be merged from arrays of arbitrary shards without meeting every shard with every other. So
shards are made by content: of the `gram`-byte windows inside a string of `length` bytes, the one of least hash (leftmost if
equal) is its anchor; equal strings have equal anchors, so all places of a string come to the shard of its anchor, and each
place (document, start) comes to exactly one shard.

1. One scan finds anchors (about 1.5 % of the positions at length 200). An anchor that a block of texts has twice is known to occur
   again; once a block, 8 bytes go to the partition of its hash, which says of the others which occur again. Nearly all text ends here.
2. Anchors with `hot` places or more, as passages that many documents share have, are looked at closely: the same is done with the
   64-bit hashes of their strings, and only strings whose hash occurs again go on. What is left of such a passage is equal in all its
   documents, while its different surroundings would make as many stretches as there are documents.
3. Texts meet their repeated anchors by a hash join. For each, the stretch of text whose strings have that anchor goes to the
   anchor's partition. A stretch that a block has twice is covered at once, and goes on once, without places.
4. A partition makes shards of its distinct stretches of `shard_bytes` at most. A shard's suffix array to depth `length`
   comes by Larsson-Sadakane refinement in numpy: ranks by 8 bytes, then by doubling, only groups not yet apart being sorted.
   Common prefixes of neighbours follow Kasai: where both neighbours' predecessors are neighbours too, the prefix is one
   shorter; other places are compared. Neighbours with `length` bytes in common are one string. Shards take whole anchors;
   where one anchor needs several shards, their strings meet by binary search in the sorted lists.
5. Covered ranges go back to their document, which is cut.

The text is shuffled once (all joins read the same exchange). Of a passage that a third of all documents share, each block sends a
row for each anchor, and a range to each document; no group's text or places are gathered. Partitions are as many as
spark.sql.shuffle.partitions, or more where 64 MB of text or more would come to one.

Defined results: null and empty texts have 0 bytes and the digest of nothing; texts shorter than `length` lose nothing; equal rows are
each other's elsewhere; a row is known by a 128-bit hash of id and text, which null ids and repeated ids do not disturb.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Tables, parts, parts_of, release, table, text_bytes, written
from tidemark.llm.shingles import U, _tables, mix

_LOW = U((1 << 20) - 1)
_CHUNK = (1 << 18) - 4096


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first start, last start) of each run of string starts that share an anchor."""
    hashes, firsts, lasts = [], [], []
    window = length - gram + 1
    for base in range(0, max(0, len(data) - length + 1), _CHUNK):
        part = data[base : base + _CHUNK + length - 1]
        up, down = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + U(1)) * up[: len(part)], out=sums[1:])
        h = mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        n = len(key) - window + 1
        blocks = np.full(-(-len(key) // window) * window, U(0xFFFFFFFFFFFFFFFF))
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, window)
        ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        back = np.minimum.accumulate(blocks, axis=1).ravel()
        at = (np.minimum(ahead[:n], back[window - 1 : window - 1 + n]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        hashes.append(h[at[first]])
        firsts.append(first + base)
        lasts.append(np.append(first[1:], n) - 1 + base)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U(16)


def strings(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of `length` bytes that start from first to last (whole ranges, one after the other)."""
    out = [np.zeros(0, dtype=np.uint64)]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        part = data[a : b + length]
        up, down = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + U(1)) * up[: len(part)], out=sums[1:])
        out.append(mix((sums[length:] - sums[:-length]) * down[: b + 1 - a]))
    return np.concatenate(out)


def _names(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(-1, 2)


def _packed_rows(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "packed"])


def _by_row(found: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(row in two numbers, from, to), packed by the bucket of the row."""
    home = (found[:, 0].view(np.uint64) >> U(20)) % U(buckets)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(buckets + 1))
    return _packed_rows([(b, found[order[cut[b] : cut[b + 1]]].tobytes()) for b in np.flatnonzero(np.diff(cut)).tolist()])


def _send(keys_of, buckets: int, starts: bool):
    """Packed rows for each bucket: of each key (48 bits of a hash) of a block its number there and one of the rows that have it;
    to one bucket also what is known already: (row, key) of keys that the block has more than once, or with `starts` ranges (row, from, to)
    of them."""
    enough = min(max(200_000, 32 * buckets), 4_000_000)

    def packed(names: np.ndarray, h: np.ndarray, at: np.ndarray, owner: np.ndarray, home: int) -> pa.RecordBatch:
        order = np.argsort(h, kind="stable")
        h, at, owner = h[order], at[order], owner[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), dtype=bool), h[1:] != h[:-1])))
        size = np.diff(np.append(first, len(h)))
        known, rest = np.repeat(size > 1, size), None
        if known.any():
            if starts:
                rest = merged(np.column_stack((names[owner[known]].view(np.int64), at[known], at[known] + 1))).tobytes()
            else:
                pairs = np.stack((h[known], owner[known].astype(np.uint64)), axis=1)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))]
                rest = names[pairs[:, 1].astype(np.int64)].tobytes(), pairs[:, 0].tobytes()
        h, at, owner, many = h[first], at[first], owner[first], np.minimum(size, 255).astype(np.uint8)
        bucket = (h >> U(16)) % U(buckets)
        order = np.argsort(bucket, kind="stable")
        h, at, owner, many = h[order], at[order], owner[order], many[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.union1d(np.flatnonzero(np.diff(cut)), [home] if rest else []).astype(np.int64).tolist():
            own = slice(cut[b], cut[b + 1])
            used, who = np.unique(owner[own], return_inverse=True)
            small = np.uint16 if len(used) < 1 << 16 else np.uint32
            pack = (h[own].astype(np.uint32).tobytes(), (h[own] >> U(32)).astype(np.uint16).tobytes(), many[own].tobytes(), small is np.uint16, who.astype(small).tobytes(), names[used].tobytes(), at[own].astype(np.uint32).tobytes() if starts else b"")
            out.append((b, pickle.dumps((*pack, rest if b == home else None), protocol=5)))
        return _packed_rows(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, at, size, home = [], [], [], 0, TaskContext.get().partitionId()

        def send() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            return packed(_names(names), np.concatenate(keys), np.concatenate(at) if starts else np.zeros(len(owner), dtype=np.int64), owner, home % buckets)

        for part in parts_of(batches):
            for name, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found, places = keys_of(*row)
                names.append(name)
                keys.append(_short(found))
                at.append(places)
                size += len(found)
                if size >= enough or len(names) >= 50_000:
                    yield send()
                    names, keys, at, size, home = [], [], [], 0, home + 7919
        if names:
            yield send()
        release()

    return scan


def _again(hot: int, buckets: int, starts: bool):
    """(row, key) of keys that occur more than once, and (null, key) of those that occur `hot` times or more; with `starts` ranges of
    places whose key occurs more than once, packed by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(names: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(keys), 100_000):
                part = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in names[part]], pa.binary()), pa.array(keys[part].astype(np.int64), pa.int64())], names=["row", "key"])

        held: dict[int, list] = {}
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                *pack, rest = pickle.loads(packed.as_buffer())
                if rest and starts:
                    yield _by_row(np.frombuffer(rest, np.int64).reshape(-1, 4), buckets)
                elif rest:
                    yield from rows(np.frombuffer(rest[0], np.uint64).reshape(-1, 2), np.frombuffer(rest[1], np.uint64))
                held.setdefault(bucket, []).append(pack)
        for bucket in list(held):
            packs = held.pop(bucket)
            key = np.concatenate([np.frombuffer(p[0], np.uint32) for p in packs]).astype(np.uint64)
            key |= np.concatenate([np.frombuffer(p[1], np.uint16) for p in packs]).astype(np.uint64) << U(32)
            many = np.concatenate([np.frombuffer(p[2], np.uint8) for p in packs]).astype(np.int64)
            names = [np.frombuffer(p[5], np.uint64).reshape(-1, 2) for p in packs]
            base = np.cumsum([0, *map(len, names)])
            who = np.concatenate([np.frombuffer(p[4], np.uint16 if p[3] else np.uint32).astype(np.int64) + at for p, at in zip(packs, base[:-1], strict=True)])
            at = np.concatenate([np.frombuffer(p[6], np.uint32) for p in packs]).astype(np.int64)
            del packs
            if not len(key):
                continue
            names = np.concatenate(names)
            order = np.argsort(key, kind="stable")
            key, who, many = key[order], who[order], many[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            total = np.add.reduceat(many, first)
            learns = np.repeat(total > 1, np.diff(np.append(first, len(key)))) & (many == 1)
            if starts:
                if learns.any():
                    at = at[order][learns]
                    yield _by_row(merged(np.column_stack((names[who[learns]].view(np.int64), at, at + 1))), buckets)
                continue
            yield from rows(names[who[learns]], key[learns])
            often = key[first[total >= hot]]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), pa.binary()), pa.array(often.astype(np.int64), pa.int64())], names=["row", "key"])

    return run


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from first to last, range by range."""
    many = last - first + 1
    return np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _hot_strings(data: np.ndarray, hot: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all strings of data under hot anchors."""
    h, first, last = anchors(data, length, gram)
    mine = np.isin(_short(h), hot)
    return strings(data, first[mine], last[mine], length), _spread(first[mine], last[mine])


def _send_stretches(length: int, gram: int, buckets: int):
    """Packed rows for each bucket: distinct stretches (anchor, bytes, place); to one bucket also ranges that are covered already."""

    def packed(found: dict[tuple[int, int, bytes], list[tuple[int, int]]], names: np.ndarray, home: int) -> pa.RecordBatch:
        out: dict[int, list] = {}
        done = []
        for (b, a, stretch), places in found.items():
            if len(places) > 1:
                done += [(n, start, start + len(stretch)) for n, start in places]
                out.setdefault(b, []).append((a, stretch, None))
            else:
                n, start = places[0]
                out.setdefault(b, []).append((a, stretch, names[n].tobytes() + start.to_bytes(8, "little")))
        ready = b""
        if done:
            done = np.array(done, dtype=np.int64)
            ready = merged(np.column_stack((names[done[:, 0]].view(np.int64), done[:, 1:]))).tobytes()
            out.setdefault(home, [])
        return _packed_rows([(b, pickle.dumps((own, ready if b == home else b""), protocol=5)) for b, own in out.items()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
        names, size, home = [], 0, TaskContext.get().partitionId()
        for part in parts_of(batches):
            columns = [part.column(c).to_pylist() for c in ("_row", "_text", "again")]
            for row, text, again, *lists in zip(*columns, part.column("wanted"), part.column("hot"), strict=True):
                wanted, hot = (x.values.to_numpy().astype(np.uint64) for x in lists)
                data = _bytes(text)
                raw = data.tobytes()
                h, first, last = anchors(data, length, gram)
                mine = np.isin(_short(h), wanted)
                keys, a, z = h[mine], first[mine], last[mine]
                if len(hot):
                    close = np.isin(_short(keys), hot)
                    start, owner = _spread(a[close], z[close]), np.repeat(keys[close], (z - a + 1)[close])
                    keys, a, z = keys[~close], a[~close], z[~close]
                    spans, step = np.frombuffer(again or b"", dtype=np.int64).reshape(-1, 2), np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(step, spans[:, 0], 1)
                    np.add.at(step, spans[:, 1], -1)
                    on = np.cumsum(step)[start] > 0
                    start, owner = start[on], owner[on]
                    if len(start):
                        begin = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1]))))
                        keys, a, z = np.concatenate((keys, owner[begin])), np.concatenate((a, start[begin])), np.concatenate((z, start[np.append(begin[1:], len(start)) - 1]))
                for b, key, s, e in zip(((_short(keys) >> U(16)) % U(buckets)).tolist(), keys.tolist(), a.tolist(), z.tolist(), strict=True):
                    found.setdefault((b, key, raw[s : e + length]), []).append((len(names), s))
                    size += 1
                names.append(row)
            if size >= 10_000:
                yield packed(found, _names(names), home % buckets)
                found, names, size, home = {}, [], 0, home + 7919
        if names:
            yield packed(found, _names(names), home % buckets)
        del found
        release()

    return cut


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number that orders like them; text must be padded by 8 bytes."""
    n = len(text) - 8
    out = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        out = (out << U(8)) | text[i : n + i]
    return out


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all positions by their first `depth` bytes (a power of two from 8 on), by Larsson-Sadakane refinement.

    text is padded with `depth` + 8 zero bytes. A rank is the place of its group's first member, so that a group can be split
    in place; positions alone in their group are not touched again.
    """
    words = _words(text)
    order = np.argsort(words)
    sorted_words = words[order]
    n = len(order)
    starts = np.concatenate(([True], sorted_words[1:] != sorted_words[:-1]))
    place = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = place
    lone = starts & np.concatenate((starts[1:], [True]))
    active = order[~lone]  # in order of rank
    h = 8
    while h < depth and len(active):
        behind = np.minimum(active + h, n - 1)
        key = (rank[active].astype(np.uint64) << U(32)) | rank[behind].astype(np.uint64)
        by = np.argsort(key)
        active, key = active[by], key[by]
        group = key >> U(32)
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.concatenate(([True], group[1:] != group[:-1]))
        index = np.arange(len(active))
        base = np.maximum.accumulate(np.where(first, index, 0))
        within = np.maximum.accumulate(np.where(fresh, index, 0)) - base
        rank[active] = group.astype(np.int64) + within
        active = active[~(fresh & np.concatenate((fresh[1:], [True])))]
        h *= 2
    return rank


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of `order` has in common with the one before it there (0 for the first), `most` at most.

    After Kasai: if p follows q, and p - 1 follows q - 1, the prefix of p is one shorter than that of p - 1, if that is 1 at
    least. Only the heads of such runs are compared, eight bytes at a time; after a prefix of 0, which at most 255 neighbours
    have, a run has a new head.
    """
    out = np.zeros(len(order), dtype=np.int64)
    if len(order) < 2:
        return out
    p, q = order[1:], order[:-1]
    by = np.argsort(p, kind="stable")
    sp, sq = p[by], q[by]
    head = np.concatenate(([True], (sp[1:] != sp[:-1] + 1) | (sq[1:] != sq[:-1] + 1)))
    begin, length = np.flatnonzero(head), np.zeros(len(sp), dtype=np.int64)
    end = np.append(begin[1:], len(sp))
    while len(begin):
        hp, hq, run = sp[begin], sq[begin], end - begin
        limit = np.minimum(most + run, len(text) - 8 - np.maximum(hp, hq))
        same, active, done = np.zeros(len(hp), dtype=np.int64), np.arange(len(hp)), 0
        while len(active):
            a, b = hp[active] + done, hq[active] + done
            apart = np.full(len(active), 8, dtype=np.int64)
            for i in range(7, -1, -1):
                apart[text[a + i] != text[b + i]] = i
            same[active] += apart
            done += 8
            active = active[(apart == 8) & (limit[active] > done)]
        same = np.minimum(same, limit)
        within = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
        length[np.repeat(begin, run) + within] = np.repeat(same, run) - within
        more = same + 1 < run
        begin, end = (begin + same + 1)[more], end[more]
    out[1:][by] = np.clip(length, 0, most)
    return out


class Shard:
    """Distinct stretches with their suffix array: the distinct strings in order, and which string each start has."""

    def __init__(self, stretches: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(s) for s in stretches], dtype=np.int64)
        self.text = np.concatenate((np.frombuffer(b"".join(stretches), dtype=np.uint8), np.zeros(2 * length + 512, dtype=np.uint8)))
        base = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        self.stretch = np.repeat(np.arange(len(sizes)), counts)
        self.offset = np.arange(len(self.stretch)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = base[self.stretch] + self.offset
        depth = 8
        while depth * 2 <= length:
            depth *= 2
        rank = suffix_ranks(self.text[: int(sizes.sum()) + length + 8], depth)
        order = np.argsort((rank[starts].astype(np.uint64) << U(32)) | rank[starts + length - depth].astype(np.uint64), kind="stable")
        shared = common_prefixes(self.text, starts[order], length)
        fresh = shared < length
        self.string = np.empty(len(order), dtype=np.int64)
        self.string[order] = np.cumsum(fresh) - 1
        self.first = starts[order][fresh]
        self.words = None

    def key(self, which: np.ndarray, step: int) -> np.ndarray:
        """Bytes 8 * step and on of strings as numbers; the last number overlaps the one before."""
        if self.words is None:
            self.words = _words(self.text)
        return self.words[self.first[which] + min(8 * step, self.length - 8)]

    def find(self, other: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(own string, other's string) of equal strings, by binary search for each of the other's strings."""
        want = np.arange(len(other.first))
        low, high = np.zeros(len(want), dtype=np.int64), np.full(len(want), len(self.first), dtype=np.int64)
        while len(active := np.flatnonzero(low < high)):
            middle = (low[active] + high[active]) // 2
            less = _compare(self, middle, other, want[active]) < 0
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
        inside = np.flatnonzero(low < len(self.first))
        equal = inside[_compare(self, low[inside], other, want[inside]) == 0]
        return low[equal], want[equal]


def _compare(a: Shard, i: np.ndarray, b: Shard, j: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as strings i of a are below, equal to or above strings j of b."""
    out, active = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
    for step in range(-(-a.length // 8)):
        x, y = a.key(i[active], step), b.key(j[active], step)
        out[active[x < y]], out[active[x > y]] = -1, 1
        active = active[x == y]
        if not len(active):
            break
    return out


def repeated(stretches: list[tuple[int, bytes]], places: list[int], length: int, shard_bytes: int) -> Iterator[tuple[int, int, int]]:
    """(stretch, from, to): ranges under strings that start at two places at least.

    stretches: (anchor, bytes), distinct and in order of anchors; places: how many places each has. Shards take whole anchors as
    far as they fit; only shards that share an anchor (one with more bytes than a shard) need to meet.
    """
    many = np.array(places, dtype=np.int64)
    open_: list[tuple[int, Shard, np.ndarray, int]] = []  # first stretch, shard, places of its strings, last anchor

    def done() -> Iterator[tuple[int, int, int]]:
        twice = [total > 1 for _, _, total, _ in open_]
        for i in range(len(open_)):
            for j in range(i):
                mine, other = open_[i][1].find(open_[j][1])
                twice[i][mine] = True
                twice[j][other] = True
        for (begun, s, _, _), again in zip(open_, twice, strict=True):
            on = again[s.string]
            edge = np.concatenate(([True], s.stretch[1:] != s.stretch[:-1], [True]))
            first = on & (edge[:-1] | np.concatenate(([True], ~on[:-1])))
            last = on & (edge[1:] | np.concatenate((~on[1:], [True])))
            yield from zip((begun + s.stretch[first]).tolist(), s.offset[first].tolist(), (s.offset[last] + length).tolist(), strict=True)
        open_.clear()

    begun, size = 0, 0
    for n, (anchor, stretch) in enumerate(stretches):
        if size and (size + len(stretch) > shard_bytes and size > shard_bytes // 2 and (anchor != stretches[n - 1][0] or size + len(stretch) > 2 * shard_bytes)):
            if open_ and open_[-1][3] != stretches[begun][0]:
                yield from done()
            s = Shard([x for _, x in stretches[begun:n]], length)
            open_.append((begun, s, np.bincount(s.string, many[begun + s.stretch], len(s.first)), stretches[n - 1][0]))
            begun, size = n, 0
        size += len(stretch)
    if open_ and open_[-1][3] != stretches[begun][0]:
        yield from done()
    s = Shard([x for _, x in stretches[begun:]], length)
    open_.append((begun, s, np.bincount(s.string, many[begun + s.stretch], len(s.first)), stretches[-1][0]))
    yield from done()


def _shards(length: int, shard_bytes: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}  # number of places (those of a stretch that is covered already count twice), and places
        done = []
        for batch in batches:
            for packed in batch.column(1):
                own, ready = pickle.loads(packed.as_buffer())
                if ready:
                    done.append(np.frombuffer(ready, dtype=np.int64).reshape(-1, 4))
                for anchor, stretch, place in own:
                    entry = held.setdefault((anchor, stretch), [0, []])
                    entry[0] += 1 if place else 2
                    if place:
                        entry[1].append(place)
        stretches = sorted(held)
        places = [held[s] for s in stretches]
        held.clear()
        where = [np.frombuffer(b"".join(p[1]), dtype=np.int64).reshape(-1, 3) for p in places]
        for n, a, b in repeated(stretches, [p[0] for p in places], length, shard_bytes) if stretches else ():
            if len(where[n]):
                done.append(np.column_stack((where[n][:, :2], where[n][:, 2] + a, where[n][:, 2] + b)))
        if not done:
            return
        yield _by_row(merged(np.concatenate(done)), buckets)
        del stretches, places, where, done
        release()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, spans) with one row for each document row that loses anything."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(bucket, []).append(packed)
    for bucket in list(held):
        found = merged(np.frombuffer(b"".join(held.pop(bucket)), dtype=np.int64).reshape(-1, 4))
        first = np.flatnonzero(np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1))))
        cut = np.append(first, len(found)).tolist()
        names, spans = np.ascontiguousarray(found[:, :2]), np.ascontiguousarray(found[:, 2:])
        for n in range(0, len(first), 20_000):
            part = range(n, min(n + 20_000, len(first)))
            yield pa.RecordBatch.from_arrays([pa.array([names[cut[i]].tobytes() for i in part], pa.binary()), pa.array([spans[cut[i] : cut[i + 1]].tobytes() for i in part], pa.binary())], names=["row", "spans"])


def merged(found: np.ndarray) -> np.ndarray:
    """(row in two numbers, from, to) as maximal ranges, by row and place; ranges that touch are one."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    row = np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1)))
    # ranges are raised by a step a row, so that one running maximum serves all rows
    step = (np.cumsum(row) - 1) * (int(found[:, 3].max()) + 2)
    reach = np.maximum.accumulate(found[:, 3] + step)
    first = np.flatnonzero(np.concatenate(([True], (found[1:, 2] + step[1:]) > reach[:-1])))
    return np.column_stack((found[first, :3], (reach - step)[np.append(first[1:], len(found)) - 1]))


def keep(raw: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left of raw, bytes removed, and runs removed; spans: maximal ranges in order."""
    if not spans:
        return raw, 0, 0
    left, at, ranges = [], 0, np.frombuffer(spans, dtype=np.int64).reshape(-1, 2).tolist()
    for start, end in ranges:
        left.append(raw[at:start])
        at = end
    left.append(raw[at:])
    kept = b"".join(left)
    return kept, len(raw) - len(kept), len(ranges)


def _covered(docs: DataFrame, text: str, key: str, others: list, length: int, gram: int, shard_bytes: int, hot: int, tables: Tables) -> DataFrame:
    """(row, text, others, spans) of each row of docs."""
    buckets = parts(docs.sparkSession, text_bytes(docs, text))
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, text)]
    rows = docs.select(F.unhex(F.md5(F.concat(said[0], F.lit(" "), said[1]).cast("binary"))).alias("_row"), F.col(text).cast("string").alias("_text"), *others)
    long = rows.select("_row", "_text").where(F.octet_length("_text") >= length)
    packed = "bucket int, packed binary"
    no_places = np.zeros(0, dtype=np.int64)
    sent = long.mapInArrow(_send(lambda t: (anchors(_bytes(t), length, gram)[0], no_places), buckets, False), packed).repartitionById(buckets, "bucket")
    found = tables.written(sent.mapInArrow(_again(hot, buckets, False), "row binary, key long"), "anchors")
    often = found.where(F.col("row").isNull()).select("key").distinct()
    n_hot = often.count()
    often = (F.broadcast(often) if n_hot <= 1_000_000 else often).withColumn("is_hot", F.lit(True))
    marked = found.where(F.col("row").isNotNull()).join(often, "key", "left")
    wanted = tables.written(marked.groupBy("row").agg(F.collect_set("key").alias("wanted"), F.collect_set(F.when(F.col("is_hot"), F.col("key"))).alias("hot")), "wanted")
    # all columns go along, so that this join's exchange of the texts is the one that the last join reads
    with_anchors = rows.join(wanted.hint("shuffle_hash"), F.col("_row") == F.col("row")).drop("row")
    if n_hot:
        close = long.join(wanted.where(F.size("hot") > 0).hint("shuffle_hash"), F.col("_row") == F.col("row")).select("_row", "_text", "hot")
        sent = close.mapInArrow(_send(lambda t, h: _hot_strings(_bytes(t), np.array(h, dtype=np.int64).astype(np.uint64), length, gram), buckets, True), packed).repartitionById(buckets, "bucket")
        places = sent.mapInArrow(_again(hot, buckets, True), packed).repartitionById(buckets, "bucket")
        again = tables.written(places.mapInArrow(_gather, "row binary, spans binary"), "strings").withColumnRenamed("spans", "again")
        with_anchors = with_anchors.join(again.hint("shuffle_hash"), F.col("_row") == F.col("row"), "left").drop("row")
    else:
        with_anchors = with_anchors.withColumn("again", F.lit(None).cast("binary"))
    stretches = with_anchors.select("_row", "_text", "wanted", "hot", "again").mapInArrow(_send_stretches(length, gram, buckets), packed).repartitionById(buckets, "bucket")
    covered = stretches.mapInArrow(_shards(length, shard_bytes, buckets), packed).repartitionById(buckets, "bucket")
    spans = written(covered.mapInArrow(_gather, "row binary, spans binary"), "spans").withColumnRenamed("spans", "_spans")
    return rows.join(spans.hint("shuffle_hash"), F.col("_row") == F.col("row"), "left").drop("row")


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 64, shard_bytes: int = 1 << 20, hot: int = 2048) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            found = [keep(raw, spans) for raw, spans in zip(raws, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f(r, x) for r, x in zip(raws, found, strict=True)], pa.int64()) for f in (lambda r, x: len(r), lambda r, x: x[1], lambda r, x: x[2])), pa.array([hashlib.sha256(x[0]).hexdigest() for x in found], pa.string())],
                names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    with Tables() as tables:
        rows = _covered(docs, text, key, [F.col(key).alias("_key")], length, gram, shard_bytes, hot, tables).select("_key", "_text", "_spans")
    out = rows.mapInArrow(finish, f"k {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("k", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 64, shard_bytes: int = 1 << 20, hot: int = 2048) -> DataFrame:
    """docs with covered bytes cut out of their texts (a character that is cut in part goes whole); all columns stay."""
    names = docs.columns
    others = [F.col(c).alias(f"_c{n}") for n, c in enumerate(names) if c != text]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            texts = [None if t is None else t if not s else keep(t.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") for t, s in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(f"_c{n}") for n, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    with Tables() as tables:
        rows = _covered(docs, text, key, others, length, gram, shard_bytes, hot, tables)
    return rows.drop("_row").mapInArrow(finish, docs.schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, row_number() OVER () AS r FROM documents),
w AS (SELECT r, s, hash(b[s + 1 : s + 200]) AS h FROM (SELECT r, b, unnest(range(0, greatest(octet_length(b) - 199, 0))) AS s FROM d)),
again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
runs AS (SELECT r, s, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS run FROM (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 200, true) AS fresh FROM again)),
spans AS (SELECT r, run, min(s) AS a, max(s) + 200 AS z FROM runs GROUP BY r, run),
cuts AS (SELECT r, list(a ORDER BY a) AS la, list(z ORDER BY a) AS lz, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed FROM spans GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(CASE WHEN la IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(0, len(la) + 1), lambda i: hex(b[CASE WHEN i = 0 THEN 1 ELSE lz[i] + 1 END : CASE WHEN i = len(la) THEN octet_length(b) ELSE la[i + 1] END])), '')) END) AS kept_sha256
FROM d LEFT JOIN cuts ON d.r = cuts.r
"""
