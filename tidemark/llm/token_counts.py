"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts travel to Python in Arrow batches; what goes to the tokenizer at once is bounded by bytes, not rows. A long
text is cut at safe boundaries first, so that no call sees more than a bounded piece and memory stays flat.

Why a boundary is safe. The model turns a space into U+2581 and puts one more U+2581 before each text. A merge makes a
piece of the vocabulary, so nothing is ever joined over two neighbouring characters that no piece has next to each other.

* At a space: no piece holds U+2581 after another character (checked when the model is loaded). Cutting at one space between
  two characters that are neither space nor U+2581, and dropping that space (the mark before the next segment stands for
  it), leaves all merges as they were.
* Elsewhere, as in scripts without spaces, before a character that no piece has after the one before it, nor after U+2581: the mark
  before the next segment stays a token of its own, and is taken off its count. This needs bytes as tokens for unknown characters.

If a vocabulary fails these checks, texts are encoded whole, as are stretches that have no such boundary.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows are never merged or dropped.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import parts_of, table

MARK = "▁"


@functools.lru_cache(maxsize=2)
def _model(path: str):
    """The processor, whether its texts may be cut at spaces, and the neighbours that pieces have (None: no other cuts)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = proto.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    n = spec.normalizer_spec
    plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
    inner = re.compile(f"[^{MARK}]{MARK}")
    whole = any(inner.search(p.piece) for p in spec.pieces)
    cuts = bool(plain and not whole and not spec.trainer_spec.treat_whitespace_as_suffix)
    merges = spec.trainer_spec.model_type == proto.TrainerSpec.BPE and spec.trainer_spec.byte_fallback
    beside = {p.piece[i : i + 2] for p in spec.pieces for i in range(len(p.piece) - 1)}
    return sp, cuts, beside if cuts and merges and any(p.piece == MARK for p in spec.pieces) else None


def segments(text: str, size: int, beside: set[str] | None = None) -> Iterator[tuple[str, int]]:
    """text cut at safe boundaries into segments of about size characters, with the tokens that each has too many; the space at a
    cut is left out."""
    start, end, extra = 0, len(text), 0
    while end - start > size:
        cut, to = -1, -1
        for at in range(start + size, end - 1):
            before, here, after = text[at - 1], text[at], text[at + 1]
            if here == " " and before not in (" ", MARK) and after not in (" ", MARK):
                cut, to, more = at, at + 1, 0
                break
            if beside is not None and here not in (" ", MARK) and before not in (" ", MARK) and before + here not in beside and MARK + here not in beside:
                cut, to, more = at, at, 1
                break
        if cut == -1:
            break
        yield text[start:cut], extra
        start, extra = to, more
    yield text[start:], extra


def count_tokens(texts: list[str | None], path: str, batch_bytes: int = 1 << 20, segment_chars: int = 400) -> list[int]:
    """Tokens of each text; the tokenizer gets batches of about batch_bytes bytes."""
    sp, cuts, beside = _model(path)
    counts, held, owner, weight = [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, ids in zip(owner, sp.encode(held, num_threads=1), strict=True):
            counts[i] += len(ids)
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        for piece, extra in segments(text, segment_chars, beside) if cuts else ((text, 0),):
            held.append(piece)
            owner.append(i)
            counts[i] -= extra
            weight += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
            if weight >= batch_bytes:
                flush()
                weight = 0
    if held:
        flush()
    return counts


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit (more than limit tokens)."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            n_tokens = pa.array(count_tokens(texts.to_pylist(), model_path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], names=["k", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()
    counted = slim.mapInArrow(lengths, f"k {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
