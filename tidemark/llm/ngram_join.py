"""N-gram Jaccard join by universe partition and pigeonhole; see partitions.py for the signatures and why none is missed.

1. One scan turns each text into its set of shingles and its set's signatures. Equal sets are one class (a 128-bit hash of the
   set), whose signatures a task sends once. Sets that share a signature are grouped in the task already where `hot` or more of a
   block have it: they become a star, and only its centre goes on, so what a signature of a third of all rows sends is a few rows a
   task. What goes to one partition from one block is one packed row: 8 bytes a signature.
2. A partition sorts its signatures; classes under one signature form a group, sent on as a star around the class that most groups have.
3. Star edges are verified: first by parity bits (differing bits are a lower bound of differing members), which the scan has made,
   then by the sets, which are made anew only for classes of edges that the bits leave open.
4. Verified links give components. In a group that still spans several components, members outside its largest one are
   compared with all others by their parity bits, in blocks of bounded size. Of what may link, first just enough pairs to
   connect the group are verified, then, where components are still apart, all: with that every pair that shares a
   signature is either verified, too far apart, or already connected. The pairs of a group are listed nowhere.
5. A class's component is its smallest document id.

Copies never multiply: classes are told apart before anything is grouped. Nothing is collected but counts; ids of documents
whose sets are needed are broadcast while they are few (`most_broadcast`), else joined by shuffle. Partitions are as many as
spark.sql.shuffle.partitions, or more where 64 MB of text or more would come to one. Tables written on the way are deleted when the
result stands. Classes are numbered as they are read: docs should be a table, or another plan whose partitions bring the same rows in
the same order when a lost task is run again.

Defined results: a null or empty text has an empty set, links with nothing and is its own component; with fewer than k words the whole
sequence is the one shingle; rows without an id have no component and take no part; rows of one id are nodes of their own. Shingles are
64-bit hashes: that two texts differ only in shingles of one hash has a chance of 2^-64 a pair of shingles compared.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.llm.common import Tables, parts, parts_of, release, removed, table, written
from tidemark.llm.components import components
from tidemark.llm.partitions import signatures
from tidemark.llm.shingles import U, shingle_set

LEAST_BITS = 512
DOC, CLASS, EDGE, MEMBER = 0, 1, 2, 3
_AT_ONCE = 400
_SEEN = 300_000
_BLOCK = 2048
_CLASS = "class of its words, while copies are told apart"
_ROWS = "kind int, a long, b long, n long, c binary, bits binary"


def class_of(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def _rows(kind: int, a, b=None, n=None, c=None, bits=None) -> pa.RecordBatch:
    given = (("a", a, pa.int64()), ("b", b, pa.int64()), ("n", n, pa.int64()), ("c", c, pa.binary()), ("bits", bits, pa.binary()))
    columns = [pa.array(np.full(len(a), kind), pa.int32()), *(pa.nulls(len(a), t) if x is None else pa.array(x, t) for _, x, t in given)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", *(g[0] for g in given)])


def _groups(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry and size of each run of equal signatures."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(sig)), dtype=bool), sig[1:] != sig[:-1])))
    return first, np.diff(np.append(first, len(sig)))


def _distinct(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by signature and member, each once."""
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    fresh = np.concatenate((np.ones(min(1, len(sig)), dtype=bool), (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])))
    return sig[fresh], who[fresh]


def _stars(first: np.ndarray, size: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the groups the centre of its star, and the distinct edges (centre, member).

    The centre is the member that most groups have, as the source of many near copies is, and of those the least.
    """
    names, number, weight = np.unique(who, return_inverse=True, return_counts=True)
    rank = np.lexsort((-names, weight))
    place = np.empty(len(names), dtype=np.int64)
    place[rank] = np.arange(len(names))
    hub = np.repeat(names[rank[np.maximum.reduceat(place[number], first)]], size)
    return hub, np.unique(np.stack((hub[hub != who], who[hub != who]), axis=1), axis=0)


class Block:
    """What one task has read since it last sent: rows about documents and classes, and signatures."""

    def __init__(self, base: int):
        self.base, self.docs, self.classes = base, [], []
        self.sig: list[np.ndarray] = []
        self.who: list[np.ndarray] = []
        self.size = 0

    def add(self, sets: list[np.ndarray], percent: int, total: int) -> None:
        """The sets of the classes that were last added."""
        if sets:
            sig, of = signatures(sets, percent, total)
            self.sig.append(sig >> U(16))
            self.who.append(of + (len(self.classes) - len(sets)))
            self.size += len(sig)

    def packed(self, buckets: int, home: int, many: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed): signatures of 48 bits by the bucket that their upper bits say; the rest goes along to bucket `home`.

        Groups of `many` members or more become stars here, and only their centres are sent.
        """
        sig, who = (np.concatenate(x) if x else np.zeros(0, dtype=kind) for x, kind in ((self.sig, np.uint64), (self.who, np.int64)))
        sig, who = _distinct(sig, who)
        first, size = _groups(sig)
        hot, stars, members = np.zeros(0, dtype=np.uint64), None, None
        if (size >= many).any():
            of_hot = np.repeat(size >= many, size)
            s, w = sig[of_hot], who[of_hot]
            f, n = _groups(s)
            hub, star = _stars(f, n, w)
            hot, stars, members = s[f], star + self.base, (s.astype(np.int64), w + self.base)
            keep = ~of_hot
            keep[np.flatnonzero(of_hot)[w == hub]] = True
            sig, who = sig[keep], who[keep]
        bucket = ((sig >> U(16)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sig, who = sig[order], who[order]
        marked = np.isin(sig, hot)
        small = np.uint16 if len(self.classes) < 1 << 16 else np.uint32
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.union1d(np.flatnonzero(np.diff(cut)), [home]).tolist():
            s, w, m = (x[cut[b] : cut[b + 1]] for x in (sig, who, marked))
            pack = (self.base, s.astype(np.uint32).tobytes(), (s >> U(32)).astype(np.uint16).tobytes(), small is np.uint16, w.astype(small).tobytes(), s[m].tobytes())
            yield b, pickle.dumps((pack, (self.docs, self.classes, stars, members) if b == home else None), protocol=5)


def _scan(k: int, percent: int, buckets: int, total: int, hot: int):
    """Packed rows for each bucket; see Block. A block is sent when its signatures are worth it: many for each bucket, but bounded.

    A class is numbered by partition, block and place in it.
    """
    enough = min(max(200_000, 32 * buckets), 4_000_000)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        part_no, block_no = TaskContext.get().partitionId(), 0

        def send(block: Block) -> pa.RecordBatch:
            out = list(block.packed(buckets, (part_no + 7919 * block_no) % buckets, hot))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "packed"])

        block = Block(part_no << 40)
        for part in parts_of(batches, _AT_ONCE):
            sets: list[np.ndarray] = []
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = shingle_set(t, k)
                c = class_of(found) if len(found) else None
                if c is not None and i is not None and c not in seen:
                    seen[c] = block.base + len(block.classes)
                    sets.append(found)
                    block.classes.append((seen[c], len(found), c, parity(found)))
                block.docs.append((i, seen.get(c) if i is not None else None, len(found)))
            block.add(sets, percent, total)
            if len(seen) > _SEEN:
                seen.clear()  # from here on a class may come again under another number
            if block.size >= enough or len(block.docs) >= 20_000:
                yield send(block)
                block_no += 1
                block = Block(part_no << 40 | block_no << 20)
        if block.docs:
            yield send(block)
        release()

    return scan


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, class, size), classes (number, size, hash, bits), star edges (class, class), members of larger groups (group, class)."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            pack, rest = pickle.loads(packed.as_buffer())
            if rest:
                docs, classes, stars, members = rest
                yield _rows(DOC, *([d[n] for d in docs] for n in range(3)))
                if classes:
                    yield _rows(CLASS, [c[0] for c in classes], n=[c[1] for c in classes], c=[c[2] for c in classes], bits=[c[3] for c in classes])
                if stars is not None:
                    yield _rows(EDGE, stars[:, 0], stars[:, 1])
                    yield _rows(MEMBER, *members)
            if pack[1]:
                held.setdefault(bucket, []).append(pack)
    for bucket in list(held):
        packs = held.pop(bucket)
        sig = np.concatenate([np.frombuffer(p[1], np.uint32) for p in packs]).astype(np.uint64)
        sig |= np.concatenate([np.frombuffer(p[2], np.uint16) for p in packs]).astype(np.uint64) << U(32)
        who = np.concatenate([np.frombuffer(p[4], np.uint16 if p[3] else np.uint32).astype(np.int64) + p[0] for p in packs])
        hot_sig = np.unique(np.concatenate([np.frombuffer(p[5], np.uint64) for p in packs]))
        del packs
        order = np.argsort(sig, kind="stable")
        sig, who = sig[order], who[order]
        again = np.concatenate(([False], sig[1:] == sig[:-1]))
        shared = again | np.concatenate((again[1:], [False]))
        sig, who = _distinct(sig[shared], who[shared])
        if not len(sig):
            continue
        first, size = _groups(sig)
        _, star = _stars(first, size, who)
        yield _rows(EDGE, star[:, 0], star[:, 1])
        hot = np.isin(sig[first], hot_sig) if len(hot_sig) else np.zeros(len(first), dtype=bool)
        groups: dict[int, np.ndarray] = {}
        many = (size > 2) | hot & (size > 1)
        for f, n, h in zip(first[many].tolist(), size[many].tolist(), hot[many].tolist(), strict=True):
            # where members were named by tasks, the group has its signature's name, else one that equal groups have in common
            groups[int(sig[f]) if h else xxhash.xxh3_64_intdigest(who[f : f + n].tobytes()) - (1 << 63)] = who[f : f + n]
        if groups:
            yield _rows(MEMBER, np.repeat(np.array(list(groups), dtype=np.int64), [len(g) for g in groups.values()]), np.concatenate(list(groups.values())))
    release()


def parity(members: np.ndarray) -> bytes:
    """For each of some 2^k bits whether an odd number of members hash to it; 2^k grows with the set."""
    bits = max(LEAST_BITS, 1 << (len(members) - 1).bit_length())
    return np.packbits(np.bincount((members >> U(13)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(rows: list[bytes]) -> np.ndarray:
    """Parities as rows of 64-bit numbers, folded to the shortest of them (halves are added up)."""
    least = min(map(len, rows))
    out = np.empty((len(rows), least // 8), dtype=np.uint64)
    for n, row in enumerate(rows):
        bits = np.frombuffer(row, np.uint64)
        out[n] = bits if len(row) == least else np.bitwise_xor.reduce(bits.reshape(-1, least // 8), axis=0)
    return out


def may_link(a, b, apart, percent: int):
    """Whether sets of sizes a and b that differ in `apart` members at least can link."""
    return 100 * (a + b - apart) >= percent * (a + b + apart)


def _sets(k: int):
    """(number, set) of texts given with the number of their class; a text of another class under the same id is left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, _AT_ONCE):
            found = [(no, s) for t, no, c in zip(*(part.column(n).to_pylist() for n in ("t", "no", "c")), strict=True) if len(s := shingle_set(t, k)) and class_of(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([no for no, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["no", "members"])

    return make


def _forest(apart: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which candidate pairs, nearest first, would join the labels (left, right) to as few components as all of them."""
    order = np.lexsort((apart, right, left))
    fresh = np.concatenate(([True], (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])))
    best = order[fresh]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(above, above)
        return x

    kept = []
    for n in best[np.argsort(apart[best], kind="stable")].tolist():
        x, y = find(int(left[n])), find(int(right[n]))
        if x != y:
            root[x] = y
            kept.append(n)
    return np.array(kept, dtype=np.int64)


def _pairs(found) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)], names=["u", "v"])


def _across(percent: int, forest: bool):
    """Pairs of a group's outside members (side 0) with all its members (side 1) under other labels that may link by their parities;
    with `forest`, no more of them than could join the group's labels.

    Rows come sorted by group and blocks of it; one such block at a time is held.
    """

    def compare(own: list[tuple]) -> list[tuple[int, int]]:
        left, right = ([o for o in own if o[0] == side] for side in (0, 1))
        if not left or not right:
            return []
        bits = folded([o[4] for o in left + right])
        classes, labels, sizes = (np.array([o[n] for o in right], dtype=np.int64) for n in (1, 2, 3))
        found = []
        for n, (_, c, label, size, _) in enumerate(left):
            near = np.flatnonzero((labels != label) & (np.abs(sizes - size) * percent <= np.maximum(sizes, size) * (100 - percent)))
            apart = np.bitwise_count(bits[len(left) + near] ^ bits[n]).sum(axis=1).astype(np.int64)
            good = may_link(sizes[near], size, apart, percent)
            near = near[good]
            found.append(np.column_stack((apart[good], np.full(len(near), c), classes[near], np.full(len(near), label), labels[near])))
        pairs = np.concatenate(found)
        if forest and len(pairs):
            pairs = pairs[_forest(pairs[:, 0], pairs[:, 3], pairs[:, 4])]
        return [(min(c, d), max(c, d)) for c, d in pairs[:, 1:3].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block, found = None, set()
        for batch in batches:
            for g, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != block:
                    found.update(compare(held))
                    held, block = [], (g, i, j)
                held.append(tuple(row))
            if len(found) > 50_000:
                yield _pairs(found)
                found = set()
        found.update(compare(held))
        yield _pairs(found)

    return run


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that may link by their parities."""
    side = lambda name: classes.select(F.col("no").alias(name), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b, x, y in zip(*(batch.column(n).to_pylist() for n in ("u_n", "v_n", "u_bits", "v_bits")), strict=True):
                good.append(min(a, b) * 100 >= percent * max(a, b) and may_link(a, b, int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()), percent))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(by_bits, "u long, v long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that link."""
    side = lambda name: sets.select(F.col("no").alias(name), F.col("members").alias(f"{name}_members"))

    def by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            good = []
            for a, b in zip(batch.column("u_members"), batch.column("v_members"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((a, b)))
                met = int((both[1:] == both[:-1]).sum())
                good.append(100 * met >= percent * (len(both) - met))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    full = pairs.join(side("v"), "v").join(side("u"), "u")
    return full.select("u", "v", "u_members", "v_members").mapInArrow(by_sets, "u long, v long")


def _candidates(members: DataFrame, label: DataFrame, classes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (u, v) of classes that share a group, have different labels and may link by their parities; see _across."""
    placed = members.join(label.withColumnRenamed("node", "no"), "no", "left").withColumn("label", F.coalesce("label", "no"))
    by_label = placed.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    split = by_label.groupBy("g").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("all"), F.max("n").alias("most")).where(F.col("labels") > 1)
    main = by_label.join(split.select("g", F.col("most").alias("n")), ["g", "n"]).groupBy("g").agg(F.min("label").alias("main"))
    split = split.join(main, "g").select("g", "main", F.ceil((F.col("all") - F.col("most")) / _BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / _BLOCK).cast("int").alias("columns"))
    open_ = placed.join(split, "g").join(classes.select("no", "n", "bits"), "no")
    nth = lambda of: F.pmod(F.xxhash64("no"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    row = [F.lit(0).alias("side"), "no", "label", "n", "bits"]
    outside = open_.where(F.col("label") != F.col("main")).select("g", nth("rows").alias("i"), each("columns").alias("j"), *row)
    everyone = open_.select("g", each("rows").alias("i"), nth("columns").alias("j"), F.lit(1).alias("side"), *row[1:])
    blocks = outside.unionByName(everyone).repartition(parts(members.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return blocks.mapInArrow(_across(percent, forest), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, most_broadcast: int = 500_000, hot: int = 16) -> DataFrame:
    """One row per row of docs: key (as long), n_shingles, component_id, class, and component (a number, which tells components of one id apart)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    total, n_bytes = slim.agg(F.count(F.lit(1)), F.sum(F.octet_length("t").cast("long"))).first()
    buckets = parts(spark, n_bytes or 0)
    few = lambda df: F.broadcast(df) if df.count() <= most_broadcast else df
    with Tables() as tables:
        packed = slim.mapInArrow(_scan(k, percent, buckets, total, hot), "bucket int, packed binary").repartitionById(buckets, "bucket")
        met = tables.written(packed.mapInArrow(_meet, _ROWS), "signatures", "kind")
        seen = met.where(F.col("kind") == CLASS).select(F.col("a").alias("no"), "n", "c", "bits")
        # a class that several blocks have goes by its least number
        first = seen.groupBy("c").agg(F.min("no").alias("own"))
        numbered = tables.written(seen.join(first, "c"), "numbers")
        others = tables.written(numbered.where("no <> own").select("no", "own"), "other-numbers")
        others = few(others)

        def by_class(df: DataFrame, column: str) -> DataFrame:
            joined = df.join(others, df[column] == others["no"], "left").drop("no")
            return joined.withColumn(column, F.coalesce("own", column)).drop("own")

        rows = by_class(met.where(F.col("kind") == DOC).select(F.col("a").alias("id"), F.col("b").alias("number"), "n"), "number")
        each = rows.where(F.col("id").isNotNull() & F.col("number").isNotNull()).groupBy("number", "id").agg(F.count(F.lit(1)).alias("copies"))
        least = each.groupBy(F.col("number").alias("no")).agg(F.min("id").alias("id"), F.max("copies").alias("copies"))
        classes = tables.written(numbered.where("no = own").drop("own").join(least, "no"), "classes")
        # most edges come from many partitions; they are brought to one before anything is joined
        edges = met.where(F.col("kind") == EDGE).select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
        edges = by_class(by_class(edges, "x"), "y").where("x <> y")
        edges = edges.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        members = by_class(met.where(F.col("kind") == MEMBER).select(F.col("a").alias("g"), F.col("b").alias("number")), "number").withColumnRenamed("number", "no").distinct()

        def sets_of(pairs: DataFrame, made: DataFrame | None) -> DataFrame:
            ends = pairs.select(F.col("u").alias("no")).unionByName(pairs.select(F.col("v").alias("no"))).distinct()
            ends = ends if made is None else ends.join(made.select("no"), "no", "left_anti")
            needed = tables.written(classes.join(ends, "no").select(F.col("id").alias("i"), "no", "c", "copies"), "needed")
            sets = slim.join(few(needed.select("i", "no", "c")), "i").select("t", "no", "c").mapInArrow(_sets(k), "no long, members binary")
            if needed.where("copies > 1").take(1):  # rows that repeat an id with its text
                sets = sets.dropDuplicates(["no"])
            sets = tables.written(sets, "sets")
            return sets if made is None else made.unionByName(sets)

        tried = tables.written(_likely(edges, classes, percent), "likely")
        sets = sets_of(tried, None)
        links = tables.written(_verify(tried, sets, percent), "links")
        label = components(links, tables)
        for forest in (True, False):
            across = tables.written(_candidates(members, label, classes, percent, forest).join(tried, ["u", "v"], "left_anti"), "across")
            if not across.take(1):
                continue  # the nearest pairs may all have been tried, which says nothing of the others
            sets = sets_of(across, sets)
            more = tables.written(_verify(across, sets, percent), "links")
            if more.take(1):
                links = links.unionByName(more)
                label = components(links, tables)
            tried = tried.unionByName(across)

        least = classes.join(label.withColumnRenamed("node", "no"), "no").groupBy("label").agg(F.min("id").alias("least"))
        linked = label.join(least, "label").select(F.col("node").alias("no"), "least", "label")
        named = classes.join(linked, "no", "left").select(F.col("no").alias("number"), F.coalesce("least", "id").alias("component_id"), F.coalesce("label", "no").alias("component"), "c")
        out = rows.join(named, "number", "left")
        own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
        return written(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("c").alias("class"), "component"), "near-duplicates")


def _with_class(docs: DataFrame, text: str, k: int) -> DataFrame:
    at, names = docs.columns.index(text), [*docs.columns, _CLASS]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            found = [shingle_set(t, k) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([class_of(s) if len(s) else None for s in found], pa.binary())], names=names)

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(_CLASS, BinaryType())]))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, most_broadcast: int = 500_000) -> DataFrame:
    """docs with one document of each group of near duplicates, the one of least id; all columns stay.

    Rows without an id or without words are in no group and stay; of rows with one id, those of one group are one document, and those of
    other groups are judged each on its own.
    """
    found = near_duplicates(docs, key, text, k, percent, most_broadcast)
    known = found.where(F.col(key).isNotNull() & F.col("class").isNotNull()).select(F.col(key).alias("_id"), F.col("class").alias("_class"), F.col("component_id").alias("_least"), F.col("component").alias("_component"))
    again = written(known.groupBy("_id").count().where("count > 1").select("_id"), "again")
    gone = written(known.where("_id <> _least").select("_id").distinct().join(again, "_id", "left_anti"), "gone")
    some = again.take(1)
    stays = written(known.join(again, "_id", "left_semi").where("_id = _least").groupBy("_id", "_component").agg(F.min("_class").alias("_class")), "stays") if some else None
    removed(found)
    small = lambda ids: F.broadcast(ids) if ids.count() <= most_broadcast else ids
    kept = docs.join(small(gone), docs[key].cast("long") == gone["_id"], "left_anti")
    if not some:
        return kept
    again = small(again)
    match = kept[key].cast("long") == again["_id"]
    repeated = _with_class(kept.join(again, match, "left_semi"), text, k)
    alike = repeated.join(stays, (repeated[key].cast("long") == stays["_id"]) & (repeated[_CLASS] == stays["_class"]), "left_semi").dropDuplicates([key, _CLASS])
    return kept.join(again, match, "left_anti").unionByName(alike.unionByName(repeated.where(F.col(_CLASS).isNull())).drop(_CLASS))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE said AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 2, 2)) END) AS i FROM said),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM cut),
sizes AS (SELECT said.doc_id, count(s) AS n FROM said LEFT JOIN shingles ON said.doc_id = shingles.doc_id GROUP BY ALL),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * both_n >= 85 * (p.n + q.n - both_n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT sizes.doc_id, n AS n_shingles, min(y) AS component_id FROM sizes JOIN reach ON reach.x = sizes.doc_id GROUP BY ALL
"""
