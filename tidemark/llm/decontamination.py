"""Benchmark decontamination by greedy string tiling.

Texts become lower-cased words (a character of a script without spaces is a word). Words of a document that no benchmark item has
break it into runs; a Karp-Rabin hash runs along the rest, and windows of `min_match` words whose hash an item has are the shared
seeds. Seeds on one diagonal join to matches; the longest match that overlaps none taken before is marked, again and again (a match
that is partly marked comes back as what is left of it; of equally long ones the first in the item, then in the document, is
marked), down to `min_match` words. An item is leaked into a document if the marked tiles cover at least `coverage` of its words:
reordered passages count, since tiles may stand in any order.

Scale: a benchmark of at most `most_chars` characters is broadcast, and documents are decided where they are read, without a shuffle. A
larger one is joined by its seeds: documents send the 128-bit hashes of those windows that pass a filter of 2^26 bits made of all the
benchmark's seeds, which a shuffle brings together with the seeds of the same hash; tiles are then marked for each pair of a document and an
item that share any. There hashes alone decide; that two different windows have one hash has a chance of 2^-128 a pair.

Defined results: null and empty texts match nothing; an item of fewer than `min_match` words matches as its whole sequence; of several
texts under one item id the best covered counts; rows with equal ids are decided one by one.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Tables, parts_of, table, written
from tidemark.llm.shingles import mix

#: Scripts that are written without spaces: kana, Han, Hangul.
_UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_FILTER_BITS = 1 << 26
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def running_hash(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k numbers."""
    out = np.zeros(max(0, len(ids) - k + 1), dtype=np.uint64)
    for j in range(k if len(out) else 0):
        out = out * _BASE + (ids[j : len(ids) - k + 1 + j].astype(np.uint64) + np.uint64(1))
    return out ^ (out >> np.uint64(29))


class Slice:
    """A part of the benchmark, ready for lookup."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int):
        self.k, self.vocabulary, self.items = min_match, {}, []
        self.short: dict[int, dict[tuple[int, ...], list]] = {}
        for item, text in dict.fromkeys(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], dtype=np.int64)
            if len(ids) >= min_match:
                self.items.append((item, ids))
            elif len(ids):
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids.tolist()), []).append(item)
        seeds = [(h, n, p) for n, (_, ids) in enumerate(self.items) for p, h in enumerate(running_hash(ids, min_match).tolist())]
        seeds.sort()
        self.hashes, first = np.unique(np.array([s[0] for s in seeds], dtype=np.uint64), return_index=True)
        self.starts = np.append(first, len(seeds)).astype(np.int64)
        self.seed_item = np.array([s[1] for s in seeds], dtype=np.int64)
        self.seed_at = np.array([s[2] for s in seeds], dtype=np.int64)

    def ids(self, text: str) -> np.ndarray:
        """Numbers of the words of a text, -1 for words that no item has; long texts are read in pieces."""
        get, parts, start = self.vocabulary.get, [], 0
        while start < len(text):
            end = start + _PIECE
            while end < len(text) and not text[end].isspace():
                end += 1
            parts.append(np.array([get(w, -1) for w in words(text[start:end])], dtype=np.int64))
            start = end
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def leaks(self, text: str | None, coverage: float) -> dict[int | None, tuple[int, int]]:
        """Item id to (words covered, words) for items that are covered enough."""
        out: dict[int | None, tuple[int, int]] = {}
        if not text or not (len(self.hashes) or self.short):
            return out
        ids = self.ids(text)
        for n, whole in self.short.items():
            own = ids.tolist()
            for met in set(zip(*(own[j:] for j in range(n)), strict=False)) & set(whole):
                out.update(dict.fromkeys(whole[met], (n, n)))
        if not len(self.hashes):
            return out
        known = ids >= 0
        if known.sum() < self.k:
            return out
        hashes = running_hash(ids, self.k)
        runs = np.convolve(known, np.ones(self.k, dtype=np.int64), "valid") == self.k
        at = np.flatnonzero(runs)
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[at]
        at, place = at[same], place[same]
        if not len(at):
            return out
        many = self.starts[place + 1] - self.starts[place]
        seed = np.repeat(self.starts[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        doc_at, item, item_at = np.repeat(at, many), self.seed_item[seed], self.seed_at[seed]
        for n in np.unique(item).tolist():
            own = item == n
            name, need = self.items[n]
            reach = np.zeros(len(need) + 1, dtype=np.int64)
            places = np.unique(item_at[own])
            np.add.at(reach, places, 1)
            np.add.at(reach, places + self.k, -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < coverage * len(need):
                continue
            covered = tile(ids, need, doc_at[own], item_at[own], self.k)
            if covered >= coverage * len(need) and covered * out.get(name, (0, 1))[1] > out.get(name, (-1, 1))[0] * len(need):
                out[name] = (covered, len(need))
        return out


def tile(doc: np.ndarray | None, item: np.ndarray | int, doc_at: np.ndarray, item_at: np.ndarray, k: int) -> int:
    """Words of item under greedy tiles, from seeds of k words at (doc_at, item_at).

    Without doc, seeds are taken as equal words, and item is the number of its words.
    """
    order = np.lexsort((item_at, doc_at - item_at))
    doc_at, item_at = doc_at[order], item_at[order]
    cut = np.flatnonzero((np.diff(doc_at - item_at) != 0) | (np.diff(item_at) != 1)) + 1
    firsts, lasts = np.concatenate(([0], cut)), np.concatenate((cut, [len(item_at)])) - 1
    heap = []
    for d, i, n in zip(doc_at[firsts].tolist(), item_at[firsts].tolist(), (item_at[lasts] - item_at[firsts] + k).tolist(), strict=True):
        if doc is None or (doc[d : d + n] == item[i : i + n]).all():
            heap.append((-n, i, d))
    heapq.heapify(heap)
    doc_free, item_free = defaultdict(lambda: True), np.ones(item if doc is None else len(item), dtype=bool)
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [bool(item_free[i + j]) and doc_free[d + j] for j in range(-n)]
        if all(free):
            item_free[i : i - n] = False
            for j in range(-n):
                doc_free[d + j] = False
            continue
        start = None
        for j, f in enumerate([*free, False]):
            if f and start is None:
                start = j
            elif not f and start is not None:
                if j - start >= k:
                    heapq.heappush(heap, (start - j, i + start, d + start))
                start = None
    return int((~item_free).sum())


def _hashes(text: str | None, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Two hashes of each window of k words (fewer, if the text has fewer), and the number of words."""
    ids = np.array([xxhash.xxh3_64_intdigest(w) for w in words(text)], dtype=np.uint64)
    k = min(k, len(ids))
    return running_hash(ids, k), running_hash(mix(ids), k) ^ np.uint64(k), len(ids)


def _seeds(k: int, bits: np.ndarray | None):
    """(row, words, at, h1, h2) of the windows of (row, text, sizes): of k words, and of the sizes below; with bits only of those whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches):
            rows = []
            for row, text, sizes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for size in sizes:
                    first, second, n = _hashes(text, size)
                    if n >= size or bits is None:
                        at = np.arange(len(first)) if bits is None else np.flatnonzero(bits[(first % np.uint64(_FILTER_BITS)).astype(np.int64)])
                        rows.append((row, n, at, first[at].view(np.int64), second[at].view(np.int64)))
            many = [len(r[2]) for r in rows]
            repeat = lambda n, kind: pa.array([r[n] for r in rows], kind).take(pa.array(np.repeat(np.arange(len(rows)), many), pa.int64()))
            joined = [np.concatenate([np.zeros(0, dtype=np.int64), *(r[n] for r in rows)]) for n in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([repeat(0, pa.binary()), repeat(1, pa.int32()), *(pa.array(x, pa.int64()) for x in joined)], names=["row", "words", "at", "h1", "h2"])

    return run


def _joined(docs: DataFrame, items: DataFrame, min_match: int, coverage: float, tables: Tables) -> DataFrame:
    """(row, item, covered_words, item_words) of leaked pairs, by a join of seeds; docs (row, text), items (item, text) with binary names."""
    kind = "row binary, words int, at long, h1 long, h2 long"
    sizes = lambda *n: F.array(*[F.lit(x) for x in n])
    own = items.select(F.col("item").alias("row"), "text", sizes(min_match)).mapInArrow(_seeds(min_match, None), kind)
    own = tables.written(own.select(F.col("row").alias("item"), F.col("words").alias("item_words"), F.col("at").alias("item_at"), "h1", "h2").distinct(), "seeds")
    bit = F.pmod(F.expr(f"cast((h1 & {_FILTER_BITS - 1}) as int)"), F.lit(_FILTER_BITS))
    set_bits = own.groupBy((bit / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h1 & {_FILTER_BITS - 1}) % 64 as int))")).alias("b")).collect()
    held = np.zeros(_FILTER_BITS // 64, dtype=np.int64)  # 8 MB, whatever the benchmark's size
    held[[r["w"] for r in set_bits]] = [r["b"] for r in set_bits]
    bits = np.unpackbits(held.view(np.uint8), bitorder="little").astype(bool)
    short = [r["n"] for r in own.where(F.col("item_words") < min_match).select(F.col("item_words").alias("n")).distinct().collect()]
    found = docs.select("row", "text", sizes(min_match, *sorted(short))).mapInArrow(_seeds(min_match, bits), kind).drop("words")
    met = found.join(own, ["h1", "h2"]).groupBy("row", "item", "item_words").agg(F.collect_set(F.struct(F.col("at").alias("d"), F.col("item_at").alias("i"))).alias("seeds"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches):
            covered = []
            for n, seeds in zip(part.column("item_words").to_pylist(), part.column("seeds").to_pylist(), strict=True):
                at = np.array([(x["d"], x["i"]) for x in seeds], dtype=np.int64)
                covered.append(tile(None, n, at[:, 0], at[:, 1], min(n, min_match)))
            keep = pa.array([c >= coverage * n for c, n in zip(covered, part.column("item_words").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("item"), pa.array(covered, pa.int32()), part.column("item_words")], names=["row", "item", "covered_words", "item_words"]).filter(keep)

    return met.mapInArrow(mark, "row binary, item binary, covered_words int, item_words int")


def _benchmark(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    return rows, rows.agg(F.sum(F.length("t"))).first()[0] or 0


def _name(*columns: str):
    """128 bits that tell rows apart by these columns."""
    return F.unhex(F.md5(F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]).cast("binary")))


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = 5, coverage: float = 0.5, most_chars: int = 4_000_000) -> DataFrame:
    """One row per document row and leaked item: key, item, covered_words, item_words, coverage."""
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kinds = slim.schema["k"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    rows, size = _benchmark(benchmark, item, item_text)
    if size <= most_chars:
        held = docs.sparkSession.sparkContext.broadcast(Slice([(r["i"], r["t"]) for r in rows.sort("i", "t").collect()], min_match))
        item_type = benchmark.schema[item].dataType

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            for batch in parts_of(batches):
                found = [(n, i, c, w) for n, t in enumerate(batch.column(1).to_pylist()) for i, (c, w) in held.value.leaks(t, coverage).items()]
                keys = batch.column(0).take(pa.array([r[0] for r in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in found], to_arrow_type(item_type)), pa.array([r[2] for r in found], pa.int32()), pa.array([r[3] for r in found], pa.int32())], names=["k", "i", "covered_words", "item_words"])

        found = slim.mapInArrow(find, f"k {kinds[0]}, i {kinds[1]}, covered_words int, item_words int")
    else:
        with Tables() as tables:
            named = rows.select("i", "t", _name("i", "t").alias("item"))
            pairs = _joined(slim.select(_name("k", "t").alias("row"), F.col("t").alias("text")).dropDuplicates(["row"]), named.select("item", F.col("t").alias("text")).distinct(), min_match, coverage, tables)
            pairs = written(pairs.join(named.select("item", "i").distinct(), "item"), "leaked")
        best = pairs.groupBy("row", "i").agg(F.max(F.struct((F.col("covered_words") / F.col("item_words")).alias("share"), "covered_words", "item_words")).alias("best"))
        found = slim.withColumn("row", _name("k", "t")).join(best, "row").select("k", "i", "best.covered_words", "best.item_words")
    return found.select(F.col("k").alias(key), F.col("i").alias(item), "covered_words", "item_words", (F.col("covered_words") / F.col("item_words")).alias("coverage"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = 5, coverage: float = 0.5, most_chars: int = 4_000_000) -> DataFrame:
    """docs without the rows into which an item is leaked; all columns stay."""
    at = docs.columns.index(text)
    rows, size = _benchmark(benchmark, item, item_text)
    if size <= most_chars:
        held = docs.sparkSession.sparkContext.broadcast(Slice([(r["i"], r["t"]) for r in rows.sort("i", "t").collect()], min_match))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts_of(batches):
                yield batch.filter(pa.array([not held.value.leaks(t, coverage) for t in batch.column(at).to_pylist()], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)
    with Tables() as tables:
        texts = docs.select(F.col(text).cast("string").alias("text")).withColumn("row", _name("text"))
        items = rows.select(F.col("t").alias("text")).withColumn("item", _name("text"))
        gone = written(_joined(texts.dropDuplicates(["row"]), items.distinct(), min_match, coverage, tables).select(F.col("row").alias("_leaked")).distinct(), "leaked")
    return docs.join(gone, _name(text) == gone["_leaked"], "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
