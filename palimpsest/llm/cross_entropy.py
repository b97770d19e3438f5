"""LM scoring by cross-entropy difference of a target and a background bigram model.

Both models share one vocabulary (every word of the corpus, and one that is unknown), one
order and one smoothing, and together count every document. A document's score is the mean
over its words of the loss under the target minus the loss under the background: lower is
closer to the target.

A model of every word has about as many bigrams as the corpus has words, so neither the model
nor the documents' bigrams can be sent row by row. Instead

1. documents are dealt to blocks of about BLOCK bytes by a hash of their ids, which bring the
   target ids to the same blocks; their texts are shuffled this once;
2. a block names each of its distinct words and bigrams once, with its own counts: sorted
   codes, cut into buckets by their leading bits, as packed differences of a few bytes;
3. a bucket adds up what all blocks name, and answers each block with the totals in the order
   in which it asked, again a few bytes each;
4. the block takes its answers, in the order of its sorted codes, and scores its documents.

So a frequent word or bigram is one entry per block however often it occurs, nothing is
broadcast, and blocks and buckets grow in number and not in size with the corpus.

Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of the word model in each bigram distribution, in counts.
PRIOR = 10.0
#: Bytes of text in a block, and codes in a bucket, about.
BLOCK, BUCKET = 8_000_000, 1 << 21
#: Rows of one id are dealt to so many blocks.
SALTS = 8
#: Bytes hashed at once.
HASHED = 1_000_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15
#: What precedes the first word of a text, beside the hashes of words.
BEGIN = -(1 << 63)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return tuple(out)


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text.

    Words are runs of ASCII letters (A-Z in lower case), digits and all other characters
    beyond ASCII. A word longer than its block is hashed like any other.
    """
    data = b" " + b"  ".join(r.translate(_TABLE) for r in raws) + b" "
    b = np.frombuffer(data, np.uint8)
    inside = b != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(1 << max(20, len(b).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[: len(b)])))
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    bounds = np.cumsum([0] + [len(r) + 2 for r in raws])
    return h.view(np.int64), np.diff(np.searchsorted(starts, bounds))


def _slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of rows of about HASHED bytes, or of one row."""
    start, held = 0, []
    size = 0
    for k in range(len(texts)):
        raw = texts[k].as_py() or b""
        if held and size + len(raw) > HASHED:
            yield start, k, held
            start, held, size = k, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, len(texts), held


def bigram_codes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of all texts in order the word before it (BEGIN for the first) and the bigram's code."""
    before = np.concatenate((np.array([BEGIN]), words))[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = BEGIN
    h = (before.view(np.uint64) ^ np.uint64(_BASE)) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    h = (h + words.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return before, h


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each slice (kind 0), tokens by id (1), or without one (2), and bytes (3)."""
    for batch in batches:
        ids = batch.column("id")
        for a, b, raws in _slices(batch.column("raw")):
            words, counts = word_hashes(raws)
            words, own = np.unique(words), ids.slice(a, b - a)
            known = own.is_valid().to_numpy(zero_copy_only=False)
            rest = np.array([[2, 0, counts[~known].sum()], [3, 0, sum(map(len, raws))]])
            kinds = np.concatenate((np.zeros(len(words)), np.ones(known.sum()), rest[:, 0]))
            values = np.concatenate((words, own.drop_null().to_numpy(), rest[:, 1]))
            n = np.concatenate((np.zeros(len(words)), counts[known], rest[:, 2]))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (kinds, values, n)], names=["kind", "value", "n"])


class Sizes(NamedTuple):
    """Of the corpus: words of the vocabulary with the unknown one, tokens of the target and of the rest, bytes."""

    vocabulary: int
    target: int
    background: int
    bytes: int


def sizes(rows: DataFrame, ids: DataFrame) -> Sizes:
    """``rows``: id, raw; ``ids``: id. One shuffle of distinct words and of ids."""
    marked = ids.select(F.lit(1).cast("long").alias("kind"), F.col("id").alias("value"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("marked"))
    all_ = rows.mapInArrow(_summary, "kind long, value long, n long").withColumn("marked", F.lit(False)).unionByName(marked)
    each = all_.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.max("marked").alias("marked"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    found = each.agg(F.count_if(F.col("kind") == 0), total((F.col("kind") == 1) & F.col("marked")), total(F.col("kind").isin(1, 2)), total(F.col("kind") == 3)).first()
    return Sizes(found[0] + 1, found[1], found[2] - found[1], found[3])


def pack_codes(codes: np.ndarray, base: int) -> bytes:
    """Sorted codes from ``base`` on as differences, byte by byte of all of them: those bytes that any of them needs."""
    steps = np.diff(codes, prepend=np.uint64(base))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_codes(raw: bytes, base: int) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    steps = np.zeros((parts.shape[1], 8), np.uint8)
    steps[:, : raw[0]] = parts.T
    steps = steps.view("<u8")[:, 0]
    steps[0] += np.uint64(base)
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as a byte each, those from 255 on as 255 and in full at the end."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(raw: bytes, rows: int, n: int) -> np.ndarray:
    """``rows`` rows of ``n`` counts."""
    out = np.frombuffer(raw, np.uint8, rows * n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=rows * n)
    return out.reshape(rows, n)


class Block(NamedTuple):
    """Tokens of a block's documents. ``words`` and ``pairs`` are its sorted codes, the others places in these."""

    tokens: np.ndarray  # by document
    words: np.ndarray
    pairs: np.ndarray
    word: np.ndarray  # of each token
    context: np.ndarray
    pair: np.ndarray


def block_of(raws: pa.ChunkedArray) -> Block:
    parts = [word_hashes(raws_) for _, _, raws_ in _slices(raws)]
    words, tokens = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    before, pairs = bigram_codes(words, tokens) if len(words) else (words, words.view(np.uint64))
    pairs, pair = np.unique(pairs, return_inverse=True)
    codes, places = np.unique(np.concatenate((words, before)).view(np.uint64), return_inverse=True)
    return Block(tokens, codes, pairs, places[: len(words)], places[len(words) :], pair)


class Buckets(NamedTuple):
    """Numbers of buckets of words (the first ones) and of bigrams."""

    words: int
    pairs: int

    def base(self, bucket: int) -> int:
        """The least code that can be in a bucket."""
        bucket, n = (bucket, self.words) if bucket < self.words else (bucket - self.words, self.pairs)
        return -(-(bucket << 32) // n) << 32

    def rows(self, bucket: int) -> int:
        """Counts by code: of words as such and as contexts, in the target and the rest; of bigrams in both."""
        return 4 if bucket < self.words else 2

    def cut(self, codes: np.ndarray, pairs: bool) -> Iterator[tuple[int, slice]]:
        """Buckets of sorted codes that have any."""
        n = self.pairs if pairs else self.words
        at = (codes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        bounds = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else []
        for a, b in zip(bounds, bounds[1:]):
            yield int(at[a]) + pairs * self.words, slice(a, b)


def _marks(ids: pa.ChunkedArray, targets: pa.ChunkedArray) -> np.ndarray:
    own = ids.fill_null(0).to_numpy()
    return np.isin(own, targets.drop_null().to_numpy()) & ids.is_valid().to_numpy()


_ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])


def _ask(buckets: Buckets):
    """A block's distinct words and bigrams with its own counts."""

    def run(docs: pa.Table, targets: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _ASKED.empty_table()
        block = block_of(docs.column("raw"))
        own = np.repeat(_marks(docs.column("id"), targets.column("id")), block.tokens)
        number = docs.column("block")[0].as_py()
        count = lambda places, of, n: np.bincount(places[of], minlength=n)
        words = np.stack([count(p, o, len(block.words)) for p in (block.word, block.context) for o in (own, ~own)])
        pairs = np.stack([count(block.pair, o, len(block.pairs)) for o in (own, ~own)])
        out = []
        for codes, counts, is_pair in ((block.words, words, False), (block.pairs, pairs, True)):
            for bucket, at in buckets.cut(codes, is_pair):
                out.append((number, bucket, pack_codes(codes[at], buckets.base(bucket)), pack_counts(counts[:, at].ravel())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ASKED, strict=True)], schema=_ASKED) if out else _ASKED.empty_table()

    return run


_ANSWERED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary())])


def _answer(buckets: Buckets):
    """A bucket's totals, to each block in the order of its codes."""

    def run(asked: pa.Table) -> pa.Table:
        bucket = asked.column("bucket")[0].as_py()
        base, rows = buckets.base(bucket), buckets.rows(bucket)
        codes = [unpack_codes(c.as_py(), base) for c in asked.column("codes")]
        counts = np.concatenate([unpack_counts(c.as_py(), rows, len(own)) for c, own in zip(asked.column("counts"), codes, strict=True)], axis=1)
        bounds = np.cumsum([0] + [len(c) for c in codes])
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        new = np.concatenate(([True], codes[1:] != codes[:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        totals = np.add.reduceat(counts[:, order], np.flatnonzero(new), axis=1)
        out = [pack_counts(totals[:, place[a:b]].ravel()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.Table.from_arrays([asked.column("block"), asked.column("bucket"), pa.array(out, pa.binary())], schema=_ANSWERED)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("is_target", pa.bool_()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])


def _losses(buckets: Buckets, of: Sizes, prior: float):
    """Score a block's documents by the answers it got."""

    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORED.empty_table()
        block = block_of(docs.column("raw"))
        answers = dict(zip(got.column("bucket").to_pylist(), got.column("counts").to_pylist(), strict=True))
        filled = []
        for codes, is_pair in ((block.words, False), (block.pairs, True)):
            totals = np.zeros((2 if is_pair else 4, len(codes)))
            for bucket, at in buckets.cut(codes, is_pair):
                totals[:, at] = unpack_counts(answers[bucket], len(totals), at.stop - at.start)
            filled.append(totals)
        words, pairs = filled
        first = np.zeros(len(block.pairs), np.int64)
        first[block.pair] = np.arange(len(block.pair))  # a token of each bigram
        owner = np.repeat(np.arange(docs.num_rows), block.tokens)
        means = []
        for k, tokens in enumerate((of.target, of.background)):
            share = (words[k] + 1) / (tokens + of.vocabulary)
            loss = np.log(words[2 + k][block.context[first]] + prior) - np.log(pairs[k] + prior * share[block.word[first]])
            means.append(np.bincount(owner, loss[block.pair], docs.num_rows) / np.maximum(1, block.tokens))
        is_target = _marks(docs.column("id"), got.column("id"))
        return pa.Table.from_arrays([docs.column("id"), *(pa.array(x) for x in (is_target, block.tokens, *means))], schema=_SCORED)

    return run


def score(docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: float = PRIOR, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, is_target, n_tokens, target_loss, background_loss, score`` of each row.

    The target model counts the documents whose ids are in ``target_ids`` (one column
    ``doc_id``; nulls are in no set), the background model all others. Losses are mean
    negative log-likelihoods (natural logarithm) of the words given the previous one;
    ``score`` is target minus background loss. Texts without words, null ones too, have
    losses and score zero. Repeated rows are counted and scored each. An empty table gives an
    empty result; with no target (or nothing else) that model is uniform over the vocabulary.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("raw"))
    ids = target_ids.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    of = sizes(rows, ids)
    blocks = F.lit(max(1, -(-of.bytes // block)))
    buckets = Buckets(max(1, 4 * of.vocabulary // bucket), max(1, (of.target + of.background) // bucket))
    # Repeated rows stand in several partitions of the input or are one partition's.
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    place = F.when(F.col("id").isNull(), F.xxhash64("raw", F.spark_partition_id())).otherwise(F.xxhash64("id", salt))
    dealt = rows.select(F.pmod(place, blocks).alias("block"), "id", "raw")
    to = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    to = to.select(F.pmod(F.xxhash64("id", "salt"), blocks).alias("block"), "id")
    asked = dealt.groupBy("block").cogroup(to.groupBy("block")).applyInArrow(_ask(buckets), "block long, bucket long, codes binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer(buckets), "block long, bucket long, counts binary")
    got = answered.select("block", "bucket", "counts", F.lit(None).cast("long").alias("id"))
    got = got.unionByName(to.select("block", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "id"))
    scored = dealt.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(_losses(buckets, of, prior), "doc_id long, is_target boolean, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def targets(labels: DataFrame) -> DataFrame:
    """Ids labelled as of good quality."""
    return labels.where("quality = 1").select("doc_id")
