import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontamination, html_text, language_id, mixing, ngram_join, partitions, suffix_dedup, token_counts, topk_search, toxicity
from tidemark.llm.common import Tables
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_set

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---- op1 -------------------------------------------------------------------------------------------------------------------
def brute_top(rows, k, scale):
    ints = {i: [int(np.floor(scale * x)) for x in v] for i, v in rows}
    out = {}
    for q in ints:
        if q % 100 == 0:
            score = lambda i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[q], ints[i], strict=True))))  # noqa: B023, E731
            scored = [(-score(i), i) for i in ints if i != q and len(ints[i]) == len(ints[q])]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("size", [1.0, 1e5, 1e14])
def test_top_k(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * size).tolist()) for i in range(0, 700)] + [(10_000 + i, [0.5 * size] * 6) for i in range(300)]
    odd = [(9001, None), (9002, [1.0, float("nan")] * 3), (9003, [None] * 6), (None, [1.0] * 6), (9100, [float("inf")] * 6), (9200, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("tree", F.lit(1))
    found = topk_search.top_k(df, df.where("vec_id % 100 = 0"), k=10, slice_rows=64, query_rows=4, pivots=5).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == brute_top(rows, 10, 1024)


def test_top_k_of_repeated_ids(spark):
    rng = np.random.default_rng(19)
    rows = [(i % 90, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)] + [(0, [1.0, 2.0, 3.0, 0.0])] * 3 + [(100, [1.0, 0.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df, df.where("vec_id % 100 = 0"), k=7, scale=1, slice_rows=40, query_rows=2).collect())
    want = Counter()
    for q, x in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        best = sorted((-int(np.dot(x, v)), i) for i, v in rows if i != q)[:7]
        want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert got == want


def test_cover_tree_holds_and_prunes():
    rng = np.random.default_rng(20)
    centres = rng.normal(size=(40, 24)) * 300
    points = np.concatenate([np.round(c + rng.normal(size=(80, 24)) * 8) for c in centres]).astype(np.int64)
    tree = topk_search.Tree(np.arange(len(points)), points, 16)
    assert sorted(tree.ids.tolist()) == list(range(len(points))) and tree.points.dtype == np.int16
    for n, below in enumerate(tree.children):
        own = tree.points[tree.start[n] : tree.end[n]].astype(float)
        assert np.sqrt(((own - tree.centre[n]) ** 2).sum(axis=1)).max() <= tree.radius[n] + 1e-9
        if below:
            centre = [tree.centre[c] for c in below]
            assert any((c == tree.centre[n]).all() for c in centre)  # nested
            apart = [np.sqrt(((a - b) ** 2).sum()) for i, a in enumerate(centre) for b in centre[:i]]
            assert min(apart) > tree.radius[n] / 1.3 and max(tree.radius[c] for c in below) <= tree.radius[n] / 1.3 + 1e-9
    asked = topk_search.Tree(np.arange(10_000, 10_200), points[::16][:200], 16)
    search = topk_search.Search(asked, 10)
    search.meet(tree)
    scores = asked.points.astype(np.int64) @ points.T
    for row in range(200):
        best = sorted(zip((-scores[row]).tolist(), range(len(points)), strict=True))[:10]
        assert [(-s, i) for s, i in best] == list(zip(search.scores[row].tolist(), search.ids[row].tolist(), strict=True))
    assert search.computed < 0.25 * scores.size


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, df).collect() == []
    one = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(one, one).collect() == []


# ---- op2 -------------------------------------------------------------------------------------------------------------------
def test_token_counts(spark, odd_docs, no_docs):
    sp, cuts, beside = token_counts._model(MODEL)
    assert cuts and beside
    rows = odd_docs.collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(odd_docs, MODEL).collect())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in rows)
    assert got == want
    assert token_counts.token_counts(no_docs, MODEL).collect() == []


def test_cuts_do_not_change_counts(spark, sf_dir):
    sp, _, beside = token_counts._model(MODEL)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + ["</s>[INST] a  b   c", " lead", "trail ", "\t tab", "▁ ▁", "a ▁b ▁ c"]
    rng = random.Random(3)
    unspaced = "".join(rng.choice("的一是不了人我在有他这为之大来以个中上们") for _ in range(20_000))
    texts += [unspaced, "".join(rng.choices("abcXYZ019+/=😀ñж", k=5000)), "🎉" * 3000, "x" * 3000]
    assert max(len(piece) for piece, _ in token_counts.segments(unspaced, 400, beside)) < 1000
    for size in (3, 40, 400):
        assert token_counts.count_tokens(texts, MODEL, segment_chars=size) == [len(x) for x in sp.encode(texts)]


# ---- op3 -------------------------------------------------------------------------------------------------------------------
def test_toxicity_learns(spark):
    rng = random.Random(2)
    plain = [f"w{i}x" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=60)
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["zorkel", "blamfu", f"quuxal{rng.choice(['a', 'en', 'ig'])}"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marked.where("doc_id % 5 <> 0"))
    assert "zorkel" in model["lexicon"] and "quuxal~" in model["lexicon"]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, model).collect()}
    held = [(got[i], y) for i, y in labels if i % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    tokens = toxicity.Tokens(model["lexicon"], model["soft"])
    for text in ("z0rkel", "Zorkel!!", "zo.rk.el", "zooorkel"):
        assert toxicity.features(f"so {text} there", tokens)[2] > 0, text


def test_toxicity_odd(spark, odd_docs, no_docs):
    none = toxicity.train(odd_docs, spark.createDataFrame([(7, None)], "doc_id long, toxic int"))
    got = toxicity.toxicity(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(no_docs, none).collect() == []
    assert toxicity.without_toxic(odd_docs, none).count() == odd_docs.count()
    assert toxicity.score(["you idiot", "fine"], none, toxicity.Tokens(frozenset(), frozenset())).tolist() == [0.9, 0.05]


def test_isotonic_rises():
    x = np.array([1.0, 2.0, 3.0, 4.0])
    at, value = toxicity.isotonic(x, np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert (np.diff(value) >= 0).all() and np.interp(2.5, at, value) == 0.5


def slow_margin(trees, row):
    """The sum of the leaves that a row of features falls into, tree by tree, on values and not on bins."""
    out = trees["start"]
    for tree in trees["trees"]:
        node = tree[0]
        while len(node) > 1:
            edge = trees["edges"][node[0]]
            node = tree[node[2] if node[1] >= len(edge) or row[node[0]] <= edge[node[1]] else node[3]]
        out += node[0]
    return out


def test_toxicity_query_equals_slow_scoring(spark, sf_dir):
    model = toxicity.learnt(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at, value = model["steps"]
    for r in toxicity.op3_toxicity(spark, sf_dir).collect():
        row = toxicity.features(texts[r["doc_id"]], toxicity.Tokens(model["lexicon"], model["soft"]))
        x = slow_margin(model["trees"], row)
        if x <= at[0] or x >= at[-1]:
            want = value[0] if x <= at[0] else value[-1]
        else:
            n = max(i for i in range(len(at)) if at[i] <= x)
            want = value[n] if n + 1 == len(at) or at[n + 1] == at[n] else value[n] + (value[n + 1] - value[n]) * (x - at[n]) / (at[n + 1] - at[n])
        assert r["score"] == pytest.approx(min(1, max(0, want)), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)


def test_sample_features_are_the_texts_features(spark, sf_dir):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["you ID10T!! m.o.r.o.n i d i o t", "", "Zorkel zorkel?"]
    tokens = toxicity.Tokens(frozenset(["zorkel", "quux~"]), frozenset(["the"]))
    assert toxicity.Sample(texts).features(tokens).tolist() == [[float(v) for v in toxicity.features(t, tokens)] for t in texts]


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(21)
    for _ in range(30):
        n = int(rng.integers(2, 12))
        y, w = rng.integers(0, 2, n).astype(float), rng.random(n) + 0.1
        at, value = toxicity.isotonic(np.arange(n, dtype=float), y, w)
        mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.interp(np.arange(n), at, value) == pytest.approx(want)


# ---- op4 -------------------------------------------------------------------------------------------------------------------
def test_chats_round_trip(spark):
    rng = random.Random(4)
    bits = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/TURN]", "\\", "\\\\s", "<", "[", "x", "\n", "é😀", " ", "<s>", ">"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "[/ROLE]", None]), rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(0, 9)))])))
    rows += [(61, None, "user", "late"), (61, 3, "assistant", "x"), (61, 3, "assistant", "x"), (None, 0, "assistant", "no id"), (62, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_key", F.lit(0)).withColumn("example_no", F.lit(0))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is None, t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = sorted(turns, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_chats(df.where("false"))).collect() == []


def test_examples_hold_all_turns_before(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")], "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(df).orderBy("example_no").collect()
    assert [r["text"] for r in got] == ["[INST]a[/INST]b</s>", "[INST]a[/INST]b</s>[INST]c[/INST]d</s>", "[INST]a[/INST]b</s>[INST]c[/INST]d</s>[INST]e[/INST]"]
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in got] == ["b", "d", ""]


# ---- op5 -------------------------------------------------------------------------------------------------------------------
def water_fill(sizes):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, full = {s: i % 3 + 1 for i, s in enumerate(names)}, {}
    while True:
        rest = [s for s in names if s not in full]
        share = (total - sum(full.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if weight[s] * share > 3 * sizes[s]]
        if not over:
            return full | {s: weight[s] * share for s in rest}
        full |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), rng.choice(["big"] * 30 + ["a", "b", "é", None, "tiny"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    targets, taken = water_fill(sizes), Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(64, 0.005 * targets[s])
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}
    spans = mixing.block_spans(mixing.mix_sources(df)).collect()
    assert all(sum((x["last"] - x["first"]) * x["copies"] for x in r["spans"]) == r["taken"] for r in spans)


def test_mixing_cuts_large_shards(spark):
    rng = random.Random(18)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["big"] * 9 + ["small"])) for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=64, buckets=8, block_words=2).collect()
    sizes, taken, shards = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    targets = water_fill(sizes)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        shards[r["source"], r["shard"], r["part"]] += r["size"]
    assert len(got) == len(rows) and max(r["part"] for r in got) > 10 and max(shards.values()) < 3000
    assert all(abs(taken[s] - targets[s]) <= max(64, 0.01 * targets[s]) for s in sizes)


def test_mixing_odd(spark, odd_docs, no_docs):
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(no_docs).collect() == []
    silent = mixing.mix_sources(odd_docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(r["target"], r["taken"]) for r in silent} == {(0.0, 0)}


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(6)
    for seats in (0, 1, 7, 100, 5000):
        weights = [rng.choice([0, rng.randint(1, 50), rng.randint(1000, 9000)]) for _ in range(12)] + [100]
        df = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "i int, w long, seats long")
        got = {r["i"]: r["q"] for r in mixing._apportion(df, [], "w", "seats", ["i"], "q").collect()}
        want = Counter()
        for _ in range(seats):
            want[max(range(13), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))] += 1
        assert [got[i] for i in range(13)] == [want[i] for i in range(13)], seats


# ---- op6 -------------------------------------------------------------------------------------------------------------------
def test_language_id(spark):
    rng = random.Random(7)
    letters = {"aa": "abcde", "bb": "efghi", "cc": "ijklm", "dd": "mnopq", "ee": "qrstu", "ff": "uvwxy", "gg": "yzabc"}
    rows = [(i, " ".join("".join(rng.choices(letters[g], k=5)) for _ in range(20)), g) for i in range(700) for g in [rng.choice(list(letters))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.labelled(docs, F.col("doc_id") % 3 != 1))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert np.mean([got[i][0] == g for i, _, g in rows if i % 3 == 1]) > 0.98
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_id_odd(spark, odd_docs, no_docs):
    for model in (language_id.train(language_id.labelled(odd_docs, F.lit(True))), language_id.train(language_id.labelled(odd_docs, F.col("lang") == "en")), language_id.train(language_id.labelled(no_docs, F.lit(True)))):
        got = language_id.identify(odd_docs, model).collect()
        assert len(got) == odd_docs.count()
        names = {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)}
        assert names == {"und"}
        if model is not None:
            assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 7)} <= set(model["classes"])
    assert language_id.identify(no_docs, None).collect() == []


def test_decoding_by_its_definition():
    rng = np.random.default_rng(22)
    for n in (2, 4, 7):
        code = language_id.codewords(n)
        model = {"code": code, "w": rng.normal(size=(6, code.shape[1])), "trust": rng.random(code.shape[1]) + 0.01}
        x = rng.normal(size=(20, 5)) * 3
        best, share, close = language_id.decode(model, x)
        for row in range(20):
            margin = [sum(x[row, i] * model["w"][i, b] for i in range(5)) + model["w"][5, b] for b in range(code.shape[1])]
            loss = [sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(model["trust"], margin, word, strict=True)) / model["trust"].sum() for word in code]
            each = np.exp([-(v - min(loss)) * code.shape[1] for v in loss])
            each = np.sort(each / each.sum())[::-1]
            assert best[row] == int(np.argmin(loss)) and share[row] == pytest.approx(each[0]) and close[row] == (each[0] - each[1] < 0.2)


def test_language_query_equals_slow_prediction(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(language_id.crc_of_id(), F.lit(3)) == 1
    model = language_id.train(language_id.labelled(docs, ~held))
    rows = {r["doc_id"]: r for r in docs.select("doc_id", "text", "lang", held.alias("held")).collect()}
    right = []
    for r in language_id.op6_language_id(spark, sf_dir).collect():
        own = rows[r["doc_id"]]
        x = language_id.features(own["text"])
        if x is None:
            assert r["lang_pred"] == "und"
            continue
        best, share, _ = language_id.decode(model, x[None])
        assert r["lang_pred"] == model["classes"][best[0]] and r["score"] == pytest.approx(share[0], abs=1e-6) and r["held_out"] == own["held"]
        if own["held"] and own["lang"] is not None:
            right.append(r["lang_pred"] == own["lang"])
    assert np.mean(right) > 0.9


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 30):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n


# ---- op7 -------------------------------------------------------------------------------------------------------------------
def brute_tiles(doc, item, k):
    """Greedy string tiling by its definition."""
    doc_free, item_free = [True] * len(doc), [True] * len(item)
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item_free[i + n] and doc_free[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        if best[0] < k:
            return item_free.count(False)
        n, i, d = best
        item_free[i : i + n], doc_free[d : d + n] = [False] * n, [False] * n


def test_tiling_matches_definition():
    rng = random.Random(8)
    for _ in range(200):
        item = [rng.choice("abcdefg") for _ in range(rng.randint(5, 25))]
        doc = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] + item[rng.randint(0, 10) :] + [rng.choice("abcdefgh") for _ in range(9)] + item[: rng.randint(0, 15)]
        own = decontamination.Slice([(1, " ".join(item))], 3)
        got = own.leaks(" ".join(doc), 0.0).get(1, (0, 0))[0]
        want = brute_tiles(doc, item, 3)
        assert got == want


def test_decontamination(spark, odd_docs, no_docs):
    item = " ".join(f"Q{i}," for i in range(30))
    words = item.split()
    swapped = " ".join(words[20:] + words[10:20] + words[:10])
    docs = spark.createDataFrame([(1, f"pre {item.upper()} post"), (2, swapped), (3, " ".join(words[:10])), (4, "clean text of many words that nobody asked for"), (5, None), (6, item.replace(",", " -"))], "doc_id long, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(9, item), (9, "other text here of words more"), (10, None), (None, item), (11, "three short ones"), (9, item)], "item_id long, text string")
    got = decontamination.leaked_pairs(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in got) == [(i, j) for i in (1, 2, 6) for j in (0, 9)]
    assert sorted(decontamination.leaked_pairs(docs, items, most_chars=0).collect(), key=str) == sorted(got, key=str)
    for most in (0, 4_000_000):
        assert sorted(r["doc_id"] for r in decontamination.decontaminated(docs, items, most_chars=most).collect()) == [3, 4, 5]
    assert decontamination.decontaminated(odd_docs, items.where("false")).count() == odd_docs.count()
    assert decontamination.leaked_pairs(no_docs, items).collect() == [] and decontamination.leaked_pairs(docs, items.where("false")).collect() == []


def test_decontamination_odd(spark, odd_docs):
    """Short items, items in a script without spaces, and odd documents, with both ways of finding seeds."""
    han = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少"
    items = spark.createDataFrame([(1, "five six"), (2, "alpha beta gamma delta alpha beta"), (3, han), (4, "x"), (5, "é" * 500), (6, ""), (None, "seven")], "item_id long, text string")
    docs = odd_docs.unionByName(odd_docs.limit(2).withColumn("text", F.lit(f"前言。{han[10:]}，{han[:10]}。").cast("string")).withColumn("doc_id", F.lit(77).cast("long")))
    every = [{tuple(r)[:4] for r in decontamination.leaked_pairs(docs, items, most_chars=most).collect()} for most in (0, 4_000_000)]
    assert every[0] == every[1]
    pairs = {(d, i) for d, i, _, _ in every[0]}
    assert pairs == {(4, 2), (5, 2), (6, 4), (7, 1), (8, 1), (None, 1), (7, None), (8, None), (None, None), (77, 3), (9, 5), (10, 4)}
    for most in (0, 4_000_000):
        kept = decontamination.decontaminated(docs, items, most_chars=most)
        assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]


# ---- op8 -------------------------------------------------------------------------------------------------------------------
def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><header><h1>A &amp; b&#33;</h1></header><p>one <b>two<br>three<p>four&nbsp; five<aside>side</aside><div class='ad-box'>buy</div><div id='cookieBanner'>ok</div><ul><li>x<li>y</ul><section id=comments><p>me too</section></article><footer>f</footer><script>s('<p>')</script></body></html>"
    assert html_text.main_text(page) == "A & b!\none two three\nfour five\nx\ny"
    plain = "<div class='cookie-notice'>ok?</div><div class='content has-sidebar'><h1>T</h1>body<p>more</div><form>f<input></form><div class=sidebar>no</div>"
    assert html_text.main_text(plain) == "T\nbody\nmore"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<!-- x") == ""
    assert html_text.main_text("just text & more") == "just text & more"
    assert html_text.main_text("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == "deep\ner"


def test_style_tree_finds_repeated_branches(spark):
    rows = []
    for i in range(40):
        body = f"<div class='q7'>Call us now at any time</div><div class='zz'><p>story {i} has words of its own {i * 7}</p><p>and a second part {i}</p></div><div class='q8'>best offers of the week</div>"
        rows.append((i, f"https://www.shop.example/{i}", f"<html><body>{body}</body></html>"))
    rows += [(100, None, None), (101, "no url", "<p>x</p>"), (102, "http://one.example/", "<div>alone</div>"), (0, "https://www.shop.example/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("nodes", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[3] == "story 3 has words of its own 21\nand a second part 3"
    assert (got[100], got[101], got[102]) == ("", "x", "alone")
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.where("false")).collect() == []
    for many in (1, 1000):
        shuffled = html_text.extract(df, most_broadcast=0, many_pages=many).collect()
        assert {r["page_id"]: r["text"] for r in shuffled} == got and len(shuffled) == len(rows)


def test_the_tree_alone_finds_the_article(spark):
    """All names are random and no element says what it is: entropy decides, and other hosts have other thresholds."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    rows, want = [], {}
    for site in range(4):
        names = [word() for _ in range(5)]
        links, offers, foot = [word() for _ in range(6)], [" ".join(word() for _ in range(5)) for _ in range(4 + 3 * site)], " ".join(word() for _ in range(9))
        for page in range(60 + 20 * site):
            title, paragraphs = f"{word()} {word()} {page}", [" ".join(word() for _ in range(20)) for _ in range(rng.randint(1, 4))]
            n = len(rows)
            rare = f"<div class={names[1]}><blockquote>{word()} {n}</blockquote></div>" if page == 7 else ""
            html = f"<body><div class={names[0]}>{''.join(f'<span><i>{x}</i></span> ' for x in links)}</div><div class={names[3]}>{rng.choice(offers)}</div><div class={names[1]}><div class={names[2]}>{title}</div>{''.join(f'<div>{p}</div>' for p in paragraphs)}</div>{rare}<div class={names[4]}>{foot}</div></body>"
            rows.append((n, f"http://site{site}.example/{page}", html))
            want[n] = "\n".join([title, *paragraphs, *([rare.split("<blockquote>")[1].split("<")[0]] if rare else [])])
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_importance_by_its_definition(spark):
    rng = random.Random(16)
    pages = [[rng.choice("abc") for _ in range(rng.randint(1, 3))] for _ in range(30)]
    rows = [(f"http://h.example/{i}", "<body>" + "".join(f"<div class=x>{t}</div>" for t in page) + "</body>") for i, page in enumerate(pages)]
    counts = spark.createDataFrame(rows, "url string, html string").select(F.lit("h"), "html").mapInArrow(html_text._counts, "host string, node long, kind int, value long, pages long, prior double")
    counts = counts.groupBy("host", "node", "kind", "value").agg(F.sum("pages").alias("pages"), F.sum("prior").alias("prior"))
    node = html_text.parse(rows[0][1])[0][0][0]
    got = html_text.importance(counts).where(F.col("node") == node).first()
    uses = {t: sum(t in page for page in pages) for t in "abc"}
    # a text on n of m pages: its entropy over the pages it is on, in base m
    content = 1 - np.mean([-sum(1 / n * np.log(1 / n) for _ in range(n)) / np.log(30) for n in uses.values()])
    assert got["m"] == 30 and got["prior"] == pytest.approx(0.6) and got["entropy"] == pytest.approx(0.9 * content + 0.1 * 1.0)
    assert got["importance"] == pytest.approx(30 / 55 * got["entropy"] + 25 / 55 * 0.6)


def test_split_has_the_greatest_variance():
    rng = np.random.default_rng(17)
    for _ in range(50):
        w = rng.integers(0, 4, 20).astype(float)
        at, values = np.arange(20), np.repeat(np.arange(20), w.astype(int))
        best = max(((values < c).sum() * (values >= c).sum() * (values[values >= c].mean() - values[values < c].mean()) ** 2 for c in range(1, 20) if 0 < (values < c).sum() < len(values)), default=0)
        cut, apart = html_text.split(w)
        low, high = w[at < cut].sum(), w[at >= cut].sum()
        assert low * high * apart**2 == pytest.approx(best)


def test_copies_on_a_large_host_stay(spark):
    notice = "<p>all rights are with their owners</p>"
    rows = [(i, f"https://a.example/{i}", f"<div class='zz'><p>{'one story for a third' if i < 100 else f'story {i}'}</p>{notice if i % 10 else ''}</div>") for i in range(300)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "one story for a third" if i < 100 else f"story {i}" for i in range(300)}


@pytest.mark.parametrize("opening", ["<article class='post'>", "<main id=content>", "<main><div class=x><article class='post'>", "<div role=main class=c>"])
def test_plain_tags_of_a_named_main_part_stay(opening):
    page = f"{opening}<p>one</p><p class=x>two</p>"
    nodes = [b[0] for b in html_text.parse(page)[0]]
    tree = html_text.SiteTree(nodes, [0.1, 0.1], [html_text.hash_of("one"), html_text.hash_of("two")], 0.5)
    assert html_text.main_text(page, tree) == "one"


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(50_000)) + "</article>"
    rows = [(1, "http://a.example/", long), (1, "http://a.example/", long), (None, None, "<title>t"), (3, "::", "<select><option>x<p>y"), (4, "http://b.example", "a<title>b</title>c<textarea>d"), (5, "http://b.example", "")]
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    whole = "\n".join(f"line {i}" for i in range(50_000))
    assert got == sorted([(1, whole, len(whole))] * 2 + [(0, "", 0), (3, "x\ny", 3), (4, "ac", 2), (5, "", 0)], key=str)


def test_empty_and_unclosed_elements_do_not_swallow_the_page():
    assert html_text.main_text("<p>a</p><svg class='x' /><p>b</p><svg><text>no</text></svg><math/><p>c</p>") == "a\nb\nc"
    assert html_text.main_text("<p>a</p><object data='x'><p>b</p><video src=y><p>c</p><script>no") == "a\nb\nc"


# ---- op9 -------------------------------------------------------------------------------------------------------------------
def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode())) if x]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, share):
    return [rng.choice("abcdefghijklmnop") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_ngram_join(spark, k, percent):
    rng = random.Random(9 + k)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for base in range(30):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 8, 20, 60, 200, 600]))]
        words = words + passage if base % 3 == 0 else words
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows) * 7 % 1009, " ".join(edited(rng, words, rng.choice([0, 0.005, 0.01, 0.03])))))
    rows += [(5000, None), (5001, " \n"), (5002, "One  TWO"), (5003, "one\ttwo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, k=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)
    other = ngram_join.near_duplicates(df.repartition(3), k=k, percent=percent, most_broadcast=0, hot=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in other} == got and len(other) == len(rows)


def test_ngram_join_looks_past_tried_pairs(spark):
    """The nearest pair by parity bits is a star edge that failed; the pair that links is another one of the group."""
    rows = []
    for seed in (1607, 1750, 2603):
        words, others = [f"s{seed}w{i}" for i in range(130)], [f"s{seed}x{i}" for i in range(5)]
        rows += [(3 * seed, " ".join(words[:104])), (3 * seed + 1, " ".join(words)), (3 * seed + 2, " ".join(words[:109] + others))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 5, 80)


def test_no_similar_pair_lacks_a_signature():
    rng = np.random.default_rng(10)
    for percent in (85, 80, 50):
        for size in (4, 6, 9, 15, 40, 130, 700, 3000):
            for _ in range(25):
                a = rng.integers(0, 2**63, size, dtype=np.uint64)
                most = size * (100 - percent) // percent
                gone = int(rng.integers(0, most + 1)) if most else 0
                b = np.concatenate((a[gone:], rng.integers(0, 2**63, int(rng.integers(0, most - gone + 1)), dtype=np.uint64)))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and set(a.tolist()) != set(b.tolist()):
                    sig, of = partitions.signatures([np.unique(a), np.unique(b)], percent)
                    assert np.intersect1d(sig[of == 0], sig[of == 1]).size, (percent, size)


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    got = ngram_join.near_duplicates(odd_docs, k=5, percent=80).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[5] == 4 and by[8] == 7 and by[1] == 1 and by[None] is None
    assert ngram_join.near_duplicates(no_docs).collect() == []
    kept = ngram_join.one_of_each(odd_docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 2, 3, 4, 6, 7, 9, 10] and len(kept) == 10
    texts = {n: " ".join(f"{n}{i}" for i in range(60)) for n in "xyz"}
    mixed = spark.createDataFrame([(3, texts["x"]), (7, texts["x"] + " end"), (7, texts["y"]), (7, texts["z"]), (7, texts["z"]), (9, texts["y"] + " end")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"][:2]) for r in ngram_join.one_of_each(mixed).collect()) == [(3, "x0"), (7, "y0"), (7, "z0")]
    twice = odd_docs.where("doc_id = 7").unionByName(odd_docs.where("doc_id = 7"))
    assert ngram_join.one_of_each(twice).count() == 1


def test_components(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(80)] + [(500, 600 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    with Tables() as tables:
        got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long"), tables).collect()}
        assert components(spark.createDataFrame([], "u long, v long"), tables).collect() == []
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_shingles_see_whole_texts():
    long = " ".join(f"w{i}" for i in range(200_000))
    assert len(shingle_set(long, 4)) == 199_997
    assert (shingle_set("A b\tC\nd", 4) == shingle_set("a B c  d", 4)).all() and not len(shingle_set(" ", 4))


# ---- op10 ------------------------------------------------------------------------------------------------------------------
def brute_cut(texts, length):
    raws, count = [(t or "").encode() for t in texts], Counter()
    for r in raws:
        count.update(r[s : s + length] for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, dtype=int)
        for s in range(len(r) - length + 1):
            if count[r[s : s + length]] > 1:
                cover[s] += 1
                cover[s + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_suffix_dedup(spark, shard_bytes):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    texts += [texts[0][20:] + "|" + texts[1], "x" * 150, "xy" * 90, texts[2], texts[2], None, "", "é" * 60, "a" + "é" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.repeated_bytes(df, length=24, gram=8, shard_bytes=shard_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts, 24)
    passage = "".join(rng.choice("fghij") for _ in range(70))
    texts += ["".join(rng.choice("abcde") for _ in range(40)) + passage + "".join(rng.choice("abcde") for _ in range(40)) for _ in range(30)]
    texts += ["0123456789" + texts[-1][5:], "9876543210" + texts[-2][30:] + "9876", passage[3:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (2, 8, 1000):
        got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.repeated_bytes(df.repartition(5), length=24, gram=8, shard_bytes=shard_bytes, hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == brute_cut(texts, 24), hot


def test_suffix_array_order():
    rng = random.Random(13)
    stretches = sorted({bytes(rng.choices(b"ab", k=rng.randint(20, 50))) for _ in range(40)})
    shard = suffix_dedup.Shard(stretches, 20)
    strings = [bytes(shard.text[f : f + 20]) for f in shard.first]
    want = sorted({s[i : i + 20] for s in stretches for i in range(len(s) - 19)})
    assert strings == want
    assert all(stretches[n][o : o + 20] == strings[x] for n, o, x in zip(shard.stretch, shard.offset, shard.string, strict=True))


def test_common_prefixes_after_a_difference():
    rng = random.Random(14)
    same = bytes(rng.choices(range(99, 123), k=300))
    shard = suffix_dedup.Shard([b"a" + same, b"b" + same], 200)
    strings = {x[i : i + 200] for x in (b"a" + same, b"b" + same) for i in range(102)}
    assert len(shard.first) == len(strings) == 103
    found = sorted(suffix_dedup.repeated([(1, b"a" + same), (1, b"b" + same)], [1, 1], 200, 1 << 20))
    assert found == [(0, 1, 301), (1, 1, 301)]


def test_suffix_dedup_odd(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.repeated_bytes(odd_docs).collect())
    assert sum(got.values()) == len(rows) and sum(n * c for (_, n, _, _), c in got.items()) == sum(len((r["text"] or "").encode()) for r in rows)
    assert suffix_dedup.repeated_bytes(no_docs).collect() == []
    cut = suffix_dedup.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == len(rows)
    assert {r["text"] for r in cut.where("doc_id in (4, 5)").collect()} == {""} and cut.where("doc_id = 7").first()["text"] == rows[7]["text"]


# ---- all -------------------------------------------------------------------------------------------------------------------
def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        last, rows = rows, stage(spark, rows, sf_dir)
        if name != "mixing":
            assert rows.columns == docs.columns and rows.count() <= last.count()
    assert rows.count() == last.count() and {"doc_id", "taken"} <= set(rows.columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name


def test_pipeline_on_odd_documents(spark, sf_dir, odd_docs):
    """Null ids and texts, repeated rows and columns with clashing names go through all stages; columns stay as they are."""
    import corpus_pipeline

    rows = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, sf_dir)
        if name != "mixing":
            assert rows.schema.names == odd_docs.schema.names, name
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        assert rows.count() <= before.count(), name
        if name == "near duplicates":
            assert Counter(r["doc_id"] for r in rows.collect()) == {i: 1 for i in (1, 2, 3, 4, 6, 7, 9, 10)} | {None: 2}
    assert rows.where("taken > 3 * size or taken < 0").count() == 0


def test_registry():
    from tidemark.llm import registry

    names = registry.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(registry.oracle_sql()) <= set(names)
