"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities and counts of lexicon words (a short fixed list, and words and word beginnings learnt from
the labels), lexicon words near a second-person word, capitals, punctuation, and obfuscation (digits or signs inside words,
letters spaced out, drawn-out letters; such words are also looked up after undoing it).

Fitting uses at most about `sample` labelled rows, picked by a hash of the id (all toxic ones up to a third of them), with texts
of at most `fit_chars` characters; near copies among them count once when the lexicon is learnt. The sample's ids are
broadcast: the parameter bounds them. Scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts get the score of a text without any feature. Labels that disagree on an id count as toxic;
null labels are not learnt from. Without any toxic or any clean label, only the fixed list decides. Rows are never dropped.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, parts_of, release, table

#: Insults to start from. Fixed values.
SEED = frozenset("idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumb".split())
#: Second-person words of a few languages. Fixed values.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus su".split())
#: What a sign or digit inside a word may stand for. Fixed values.
LEET = str.maketrans("013457@$!|", "oieastasil")
HIT, SEEDED, YOU, CAPS, LOUD, ODD, HIDDEN, LETTER, SOFT = (1 << i for i in range(9))
NAMES = (
    "log words", "hit density", "log hits", "distinct hits", "seed density", "log seed hits", "hits near second person", "second person density",
    "capital words", "capital letters", "loud words", "punctuation", "odd words", "hidden hits", "spaced hits", "soft density", "log soft hits",
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1+")
#: Bytes that are ASCII capitals (1), small letters (2), or punctuation (3).
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123] = 1, 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3


def terms(word: str) -> list[str]:
    """What the lexicon may hold of a word: the word, and its beginnings with a sign behind them."""
    return [word, *(f"{word[:n]}~" for n in range(4, 9) if len(word) > n)]


class Tokens(dict):
    """Token to flags, worked out once a token; emptied when it has grown to a hundred thousand."""

    def __init__(self, lexicon: frozenset[str], soft: frozenset[str]):
        super().__init__()
        self.lexicon, self.soft = lexicon, soft
        self.flat = frozenset(_RUN.sub(r"\1", w) for w in (lexicon | SEED) if w[-1:] != "~" and len(w) > 3)
        # most words are told to be in no list by their first letters
        self.heads = frozenset(w[:4] for w in lexicon | soft | SEED)
        self.first = frozenset(w[0] for w in self.flat)

    def listed(self, word: str) -> int:
        if word[:4] not in self.heads:
            return 0
        own = terms(word)
        return (HIT if any(t in self.lexicon for t in own) else 0) | (SEEDED if word in SEED else 0) | (SOFT if any(t in self.soft for t in own) else 0)

    def __missing__(self, token: str) -> int:
        plain = token.isalpha()
        bare = token if plain else _EDGE.sub("", token)
        word = bare.lower()
        flags = self.listed(word) | (YOU if word in SECOND else 0)
        if len(bare) > 2 and bare.isupper():
            flags |= CAPS
        if token[-1:] in ("!", "?"):
            flags |= LOUD
        letters = [word] if word.isalpha() else _INNER.findall(word)
        if len(word) == 1 and letters:
            flags |= LETTER
        if letters and letters != [word] or not plain and token != bare and any(c in token for c in "@$"):
            flags |= ODD
            if not flags & (HIT | SEEDED):
                for guess in ("".join(letters), "".join(_INNER.findall(token.strip(".,;:?\"'()[]").lower().translate(LEET)))):
                    if (found := self.listed(guess)) & (HIT | SEEDED) and len(guess) > 3:
                        flags |= HIDDEN | found
        elif word[:1] in self.first and not flags & (HIT | SEEDED) and _RUN.search(word) and _RUN.sub(r"\1", word) in self.flat:
            flags |= HIDDEN | HIT
        if len(self) > 100_000:
            self.clear()
        self[token] = flags
        return flags


def features(text: str | None, tokens: Tokens) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    words = text.split()
    return _measured(np.fromiter(map(tokens.__getitem__, words), dtype=np.int64, count=len(words)), text, tokens)


def _measured(flags: np.ndarray, text: str, tokens: Tokens) -> list[float]:
    """Features of a text whose words have these flags."""
    n = max(1, len(flags))
    words = text.split() if (flags & (HIT | SEEDED | LETTER)).any() else []
    count = np.bincount(flags, minlength=len(_ALL))
    with_flag = lambda f: int(count[(_ALL & f) != 0].sum())
    hits, seeds, second = with_flag(HIT | SEEDED), with_flag(SEEDED), with_flag(YOU)
    distinct = near = spaced = 0
    if hits:
        at = np.flatnonzero(flags & (HIT | SEEDED))
        distinct = len({words[i].lower() for i in at})
        if second:
            you = np.flatnonzero(flags & YOU)
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(at - you[np.maximum(right - 1, 0)]))
            near = int((gap <= 4).sum())
    if with_flag(LETTER) >= 4:
        single = np.concatenate(([0], (flags & LETTER) != 0, [0])).astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(single) == 1), np.flatnonzero(np.diff(single) == -1)
        for s, e in zip(starts[ends - starts >= 4], ends[ends - starts >= 4], strict=True):
            said = "".join(_EDGE.sub("", w) for w in words[s:e]).lower()
            spaced += sum(w in said for w in tokens.flat)
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)], minlength=4)
    return [
        np.log1p(n), hits / n, np.log1p(hits), float(distinct), seeds / n, np.log1p(seeds), near / max(1, hits), second / n,
        with_flag(CAPS) / n, kinds[1] / max(1, kinds[1] + kinds[2]), with_flag(LOUD) / n, kinds[3] / max(1, kinds.sum()), with_flag(ODD) / n, float(with_flag(HIDDEN)), float(spaced), with_flag(SOFT) / n, np.log1p(with_flag(SOFT)),
    ]


_ALL = np.arange(512)


class Sample:
    """Labelled texts with their words as numbers, so that lexicons can be learnt and features made for several parts of them.

    Terms are known by 64-bit hashes; each can be spelt from a token that has it.
    """

    def __init__(self, texts: list[str]):
        token_no: dict[str, int] = {}
        self.texts = texts
        self.words = [np.array([token_no.setdefault(w, len(token_no)) for w in t.split()], dtype=np.int32) for t in texts]
        self.tokens = list(token_no)
        del token_no
        # tokens of one word, as with other signs or capitals, share its terms: a stretch of one list
        word_no: dict[str, int] = {}
        of_token = np.array([word_no.setdefault(word, len(word_no)) if (word := bare(t)) else -1 for t in self.tokens], dtype=np.int32)
        self.spoken = list(word_no)
        del word_no
        marks, many, hashes = np.zeros(len(self.spoken), dtype=np.uint32), np.zeros(len(self.spoken), dtype=np.int32), array("Q")
        for n, word in enumerate(self.spoken):
            own = terms(word)
            marks[n], many[n] = zlib.crc32(word.encode()), len(own)
            hashes.extend(map(xxhash.xxh3_64_intdigest, own))
        self.first = np.cumsum(many) - many
        unique, self.spelt, flat = np.unique(np.frombuffer(hashes, dtype=np.uint64) if hashes else np.zeros(0, dtype=np.uint64), return_index=True, return_inverse=True)
        self.n_terms, self.spelt, flat = len(unique), self.spelt.astype(np.int32), flat.astype(np.int32)
        del unique, hashes
        self.has: list[np.ndarray] = []
        self.sketch: list[list[int]] = []
        for tokens in self.words:
            own = np.unique(of_token[tokens])
            own = own[own >= 0]
            size = many[own]
            self.has.append(np.unique(flat[np.repeat(self.first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())]))
            self.sketch.append(np.unique(marks[own])[:6].tolist())

    def term(self, number: int) -> str:
        at = int(self.spelt[number])
        word = int(np.searchsorted(self.first, at, side="right")) - 1
        return terms(self.spoken[word])[at - int(self.first[word])]

    def features(self, tokens: Tokens) -> np.ndarray:
        flags = np.array([tokens[t] for t in self.tokens] or [0], dtype=np.int64)
        return np.array([_measured(flags[w], t, tokens) if t else [0.0] * len(NAMES) for w, t in zip(self.words, self.texts, strict=True)])


def bare(token: str) -> str:
    """The word of a token, or nothing where it has none of three letters or more."""
    word = _EDGE.sub("", token).lower()
    return word if len(word) > 2 and word.isalpha() else ""


def learn_lexicon(sample: Sample, rows: list[int], toxic: list[int], most: int = 400) -> tuple[frozenset[str], frozenset[str]]:
    """From the given rows: terms that mark toxic texts, being in more of them than chance gives any term and in hardly any clean one; and
    terms that are three times as frequent in toxic texts, far beyond chance. Near copies count once."""
    seen: set[tuple[int, int]] = set()
    counts, n = np.zeros((2, sample.n_terms), dtype=np.int64), [0, 0]
    for row in rows:
        y, sketch = toxic[row], sample.sketch[row]
        same = [(y, s) for s in sketch]
        again = len(sketch) > 3 and sum(s in seen for s in same) >= len(sketch) // 2 + 1
        seen.update(same)
        if not again:
            n[y] += 1
            counts[y, sample.has[row]] += 1
    clean, k = counts
    chance = max(1, n[1]) / max(2, n[0] + n[1])  # of a term's text being toxic if the term says nothing
    least = max(4, int(np.ceil((np.log(max(2, int((k > 0).sum()))) + 3) / -np.log(min(0.9, chance)))))
    found = np.flatnonzero((k >= least) & (clean * max(1, n[1]) <= 0.02 * k * max(1, n[0])))
    share = n[1] / max(1, n[0] + n[1])
    z = (k - share * (k + clean)) / np.sqrt(share * (1 - share) * (k + clean) + 1)
    far = np.flatnonzero((k >= 6) & (k * (n[0] + 1) >= 3 * (clean + 1) * max(1, n[1])) & (z >= 4))
    first = lambda at, by, top: frozenset(t for _, t in sorted((-by[i], sample.term(i)) for i in at.tolist())[:top])
    return first(found, k, most), first(far, z, 4 * most)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, depth: int, rate: float) -> list[tuple]:
    """A tree on binned x: (feature, bin, left, right) of inner nodes, (value,) of leaves; node 0 is the root."""
    nodes: list = []

    def build(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append(None)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if level < depth and len(rows) >= 8:
            for f in range(x.shape[1]):
                at = x[rows, f]
                gl = np.cumsum(np.bincount(at, g[rows], bins))[:-1]
                hl = np.cumsum(np.bincount(at, h[rows], bins))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                if (top := gain.max()) > best[0] + 1e-9:
                    best = (top, f, int(gain.argmax()))
        if best[1] is None:
            nodes[me] = (float(-gs / (hs + 1) * rate),)
        else:
            left = x[rows, best[1]] <= best[2]
            nodes[me] = (best[1], best[2], build(rows[left], level + 1), build(rows[~left], level + 1))
        return me

    build(np.arange(len(x)), 0)
    return nodes


def _walk(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))

    def go(node: int, rows: np.ndarray) -> None:
        if len(tree[node]) == 1:
            out[rows] = tree[node][0]
        elif len(rows):
            left = x[rows, tree[node][0]] <= tree[node][1]
            go(tree[node][2], rows[left])
            go(tree[node][3], rows[~left])

    go(0, np.arange(len(x)))
    return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64) -> dict:
    """Boosted trees for logistic loss on features cut at quantiles."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    binned = to_bins(x, edges)
    prior = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    start = float(np.log(prior / (1 - prior)))
    margin, trees = np.full(len(x), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, weight * (p - y), weight * p * (1 - p), bins, depth, rate)
        trees.append(tree)
        margin += _walk(tree, binned)
    return {"edges": edges, "trees": trees, "start": start}


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    binned = to_bins(x, model["edges"])
    return model["start"] + sum(_walk(t, binned) for t in model["trees"])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places (middles of the pools) and their rising values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for at, target, w in zip(x[order], y[order], weight[order], strict=True):
        pools.append([target * w, w, at, at])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w2, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w2
            pools[-1][3] = hi
    flat = [(at, p[0] / p[1]) for p in pools for at in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    return np.array([f[0] for f in flat]), np.array([f[1] for f in flat])


def fit(texts: list[str], toxic: list[int], weight: list[float], folds: int = 3) -> dict:
    """Lexicon, trees, and a calibration from margins that each come from a lexicon and trees that have not seen the row."""
    if len(set(toxic)) < 2:
        return {"lexicon": frozenset(), "soft": frozenset()}
    y, w = np.array(toxic, dtype=float), np.array(weight)
    w = w / w.mean()

    sample = Sample(texts)

    def learn(rows: np.ndarray) -> tuple[frozenset, frozenset, np.ndarray, dict]:
        lexicon, soft = learn_lexicon(sample, rows.tolist(), toxic)
        x = sample.features(Tokens(lexicon, soft))
        return lexicon, soft, x, boost(x[rows], y[rows], w[rows])

    everything, out = np.arange(len(texts)), np.zeros(len(texts))
    for k in range(folds):
        held = everything % folds == k
        if len(set(y[~held])) < 2:
            return {"lexicon": frozenset(), "soft": frozenset()}
        _, _, x, trees = learn(everything[~held])
        out[held] = margins(trees, x[held])
    lexicon, soft, _, trees = learn(everything)
    return {"lexicon": lexicon, "soft": soft, "trees": trees, "steps": isotonic(out, y, w)}


def score(texts: list[str | None], model: dict, tokens: Tokens) -> np.ndarray:
    x = np.array([features(t, tokens) for t in texts], dtype=float).reshape(len(texts), len(NAMES))
    if "trees" not in model:
        return np.where(x[:, NAMES.index("log seed hits")] > 0, 0.9, 0.05)
    return np.clip(np.interp(margins(model["trees"], x), *model["steps"]), 0, 1)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000, fit_chars: int = 50_000) -> dict:
    """labels: key and toxic (0 or 1), of the rows that may be learnt from."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = min(sizes.get(1, 0), sample // 3)
    rate = {1: toxic / max(1, sizes.get(1, 0)), 0: min(1.0, (sample - toxic) / max(1, sizes.get(0, 0)))}
    place = F.pmod(F.xxhash64(F.col("k"), F.lit(7)), F.lit(2**31)) / 2**31
    picked = rows.where(place < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.length("t") <= fit_chars).join(F.broadcast(picked), "k").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r["k"]).encode()), str(r["k"]), r["t"]))
    model = fit([r["t"] for r in found], [r["y"] for r in found], [1 / rate[r["y"]] for r in found])
    del found
    release()
    return model


def toxicity(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, score, predicted."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model["lexicon"], model["soft"])
        for batch in parts_of(batches):
            found = score(batch.column(1).to_pylist(), model, tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["k", "score"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    scored = slim.mapInArrow(apply, f"k {slim.schema['k'].dataType.simpleString()}, score double")
    return scored.select(F.col("k").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs without the rows that toxicity() would call toxic; all columns stay."""
    at = docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model["lexicon"], model["soft"])
        for batch in parts_of(batches):
            yield batch.filter(pa.array(score(batch.column(at).to_pylist(), model, tokens) < 0.5, pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)


def learnt(spark: SparkSession, sf_dir: str) -> dict:
    """The model of the query and of the pipeline: from the labels of rows whose crc32 leaves a remainder by 5."""
    labels = table(spark, sf_dir, "labels").where(F.pmod(crc_of_id(), F.lit(5)) != 0).select("doc_id", "toxic")
    return train(table(spark, sf_dir, "documents"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), learnt(spark, sf_dir))
    return found.select("doc_id", (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out"), "score", "predicted")
