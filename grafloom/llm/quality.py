"""Quality rules: hashed n-gram log-likelihood ratio, trusted target against raw corpus.

Words and word pairs are hashed into a fixed number of buckets.  Two multinomials are
counted over the buckets: the raw corpus (every document) and the trusted target (the
labelled documents of good quality and without toxicity, a bounded sample of them).
A document's score is its n-grams' summed log ratio divided by their number; the
ratios are held as integers, so sums and verdicts do not depend on row order.

Texts are worked off in slices laid end to end as one array of bytes: counts of a document
are sums over its stretch, and each distinct word of a slice is hashed once.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, gathered, mix64, short_batches, slices, utf8

#: Bytes of texts in a slice.
SLICE = 8_000_000
SCALE = 1 << 20


@dataclass(frozen=True)
class QualityParams:
    """Production defaults.

    buckets: size of both multinomials (all that is broadcast: 8 bytes each).
    trusted_rows: bound on the sample of trusted rows, those with the least md5 of doc_id.
    threshold: least score per n-gram that is kept.
    prior: smoothing counts of a bucket in the raw multinomial.
    ballast: n-grams of score zero added to each text, so that a few rare words in a very
    short text do not decide its fate.
    """

    buckets: int = 1 << 16
    trusted_rows: int = 20_000
    threshold: float = -0.08
    prior: int = 32
    ballast: int = 16
    min_words: int = 10
    repeat_percent: int = 20


#: Fixed values of MD5: the starting state, and the shifts of its four rounds.
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First 32 bits, read big-endian, of the MD5 of each word; words of up to 55 bytes in step, a block each."""
    start, lengths = ends[:-1], np.diff(ends)
    out = np.zeros(len(start), np.int64)
    for i in np.flatnonzero(lengths > 55).tolist():
        out[i] = int.from_bytes(hashlib.md5(raw[ends[i] : ends[i + 1]].tobytes()).digest()[:4], "big")
    short = np.flatnonzero(lengths <= 55)
    for k in range(0, len(short), 1 << 14):
        some = short[k : k + (1 << 14)]
        n = lengths[some]
        block = np.zeros((len(some), 64), np.uint8)
        row, upto = np.repeat(np.arange(len(some)), n), np.cumsum(n)
        column = np.arange(int(upto[-1])) - np.repeat(upto - n, n)
        block[row, column] = raw[np.repeat(start[some], n) + column]
        block[np.arange(len(some)), n] = 0x80
        block[:, 56], block[:, 57] = (8 * n) & 255, (8 * n) >> 8
        message = np.ascontiguousarray(block.view("<u4").T)
        a, b, c, d = (np.full(len(some), x, np.uint32) for x in _STATE)
        for i in range(64):
            turn = i // 16
            if turn == 0:
                f, g = d ^ (b & (c ^ d)), i
            elif turn == 1:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif turn == 2:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f = f + a + np.uint32(_SINES[i]) + message[g]
            shift = _SHIFTS[turn][i % 4]
            a, d, c, b = d, c, b, b + (f << np.uint32(shift) | f >> np.uint32(32 - shift))
        out[some] = (a + np.uint32(_STATE[0])).byteswap().astype(np.int64)
    return out


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SPACE, _SYMBOL = _table(b" \t\n\v\f\r"), _table(b"#*$%&|<>")
_CONTINUES = _table(bytes(range(0x80, 0xC0)))


class Slice:
    """Words of texts laid end to end.

    ends: where texts begin, and the end; first, last: of every word; upto: number of words
    before each text, and of all; which: each word's place among ``words``, the distinct ones.
    """

    def __init__(self, texts: pa.Array):
        self.raw, self.ends = utf8(texts)
        self.space = _SPACE[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.ends] = True
        inner = np.concatenate([[True], self.space[:-1]]) if len(self.raw) else self.space
        self.first = np.flatnonzero(~self.space & (inner | edge[:-1]))
        after = np.concatenate([self.space[1:], [True]]) if len(self.raw) else self.space
        self.last = np.flatnonzero(~self.space & (after | edge[1:])) + 1
        self.upto = np.searchsorted(self.first, self.ends)
        lengths = self.last - self.first
        flat = gathered(self.raw, self.first, lengths)
        self.which, self.words = distinct(flat, np.cumsum(lengths) - lengths, len(flat))

    def sums(self, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Sums of values between neighbouring cuts."""
        out, some = np.zeros(len(cuts) - 1, np.int64), cuts[1:] > cuts[:-1]
        if some.any():
            out[some] = np.add.reduceat(values[: cuts[-1]], cuts[:-1][some], dtype=np.int64)
        return out

    def gram_buckets(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of every word, and of the pair that it ends; -1 for the first word of a text."""
        hashes = word_hashes(*utf8(self.words))[self.which]
        pairs = np.full(len(hashes), -1, np.int64)
        pairs[1:] = (hashes[:-1] * 31 + hashes[1:]) % buckets
        starts = self.upto[:-1]
        pairs[starts[starts < len(hashes)]] = -1
        return hashes % buckets, pairs

    def repeated_words(self, width: int = 5) -> np.ndarray:
        """For each text, its words in windows that occur in it twice or more."""
        n = len(self.which)
        text = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.upto))
        m = max(n - width + 1, 0)
        at = np.flatnonzero(text[:m] == text[width - 1 :]) if m else np.zeros(0, np.int64)
        key = text[at].astype(np.uint64)
        for k in range(width):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + self.which[at + k].astype(np.uint64))
        order = np.argsort(key)
        at, key = at[order], key[order]
        like = key[1:] == key[:-1]
        same = like.copy()
        for k in range(width):
            same &= self.which[at[1:] + k] == self.which[at[:-1] + k]
        same &= text[at[1:]] == text[at[:-1]]
        twice = np.zeros(n + 1, bool)
        twice[at[1:][same]] = True
        twice[at[:-1][same]] = True
        for i in np.unique(text[at[1:][like & ~same]]).tolist():  # two windows share a hash: compare this text's outright
            a, b = int(self.upto[i]), int(self.upto[i + 1])
            seen = Counter(tuple(self.which[j : j + width].tolist()) for j in range(a, b - width + 1))
            twice[a : b - width + 1] = [seen[tuple(self.which[j : j + width].tolist())] > 1 for j in range(a, b - width + 1)]
        edge = np.zeros(n + width + 1, np.int64)
        edge[: n + 1] += twice
        edge[width : n + width + 1] -= twice
        return self.sums(np.cumsum(edge)[:n] > 0, self.upto)

    def base_counts(self) -> tuple[np.ndarray, ...]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
        chars = self.sums(~self.space & ~_CONTINUES[self.raw], self.ends)
        lines = np.zeros(len(self.ends) - 1, np.int64)
        for i in np.flatnonzero(self.sums(self.raw == 10, self.ends)).tolist():
            found = [x for x in self.raw[self.ends[i] : self.ends[i + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\v\f\r")]
            lines[i] = len(found) - len(set(found))
        return np.diff(self.upto), chars, self.sums(_SYMBOL[self.raw], self.ends), lines, self.repeated_words()


def trusted_ids(labels: DataFrame, params: QualityParams) -> np.ndarray:
    """Bounded sample of the ids whose every label says good and none says toxic."""
    rows = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
        .where("q = 1 and t = 0")
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
        .limit(params.trusted_rows)
        .select("doc_id")
    )
    return np.sort(np.array([r[0] for r in rows.collect()], np.int64))


def corpus_counts(docs: DataFrame, trusted: np.ndarray, params: QualityParams) -> DataFrame:
    """(bucket, raw, target) over every n-gram of docs; one row per task and bucket is shuffled."""
    buckets = params.buckets

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in (part for big in batches for part in slices(big, "text", SLICE)):
            words = Slice(batch.column(1))
            ids = np.array([trusted[0] - 1 if d is None else d for d in batch.column(0).to_pylist()], np.int64) if len(trusted) else np.zeros(0, np.int64)
            good = np.repeat(np.isin(ids, trusted) if len(trusted) else np.zeros(batch.num_rows, bool), np.diff(words.upto))
            for found in words.gram_buckets(buckets):
                raw += np.bincount(found[found >= 0], minlength=buckets)
                target += np.bincount(found[good & (found >= 0)], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    parts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list, buckets: int, prior: int) -> np.ndarray:
    """Integer log ratio of every bucket; zeros without a target.

    Both multinomials get the same prior: ``prior`` counts a bucket
    in the raw one, as many times the target's share of all n-grams in the target.
    A bucket with little evidence so has a ratio near 0, whatever the sizes of corpus and
    target, and clean texts with rare words are not taken for bad ones.
    """
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for b, r, t in counts:
        raw[b], target[b] = r, t
    if not target.any():
        return np.zeros(buckets, np.int64)
    raws, targets = float(raw.sum()), float(target.sum())
    ratio = np.log((target * raws + prior * targets) / (targets * (raw + float(prior))))
    return np.floor(ratio * SCALE + 0.5).astype(np.int64)


def _scorer(docs: DataFrame, labels: DataFrame, params: QualityParams):
    """A function from (texts, ratios) to columns of counts, verdicts and scores, and the broadcast ratios."""
    short_batches(docs.sparkSession)
    trusted = trusted_ids(labels, params)
    counts = corpus_counts(docs, trusted, params).collect()  # params.buckets rows at most
    table = docs.sparkSession.sparkContext.broadcast(log_ratios(counts, params.buckets, params.prior).tobytes())
    floor = round(params.threshold * SCALE)

    def score(texts: pa.Array, ratio: np.ndarray) -> list[np.ndarray]:
        words = Slice(texts)
        n, chars, symbols, dup_lines, repeat = words.base_counts()
        single, pairs = words.gram_buckets(params.buckets)
        total = words.sums(ratio[single] + np.where(pairs >= 0, ratio[pairs], 0), words.upto)
        failed = (n < params.min_words) | (100 * repeat > params.repeat_percent * n)
        size = np.maximum(2 * n - 1, 0) + params.ballast
        return [n, chars, symbols, dup_lines, repeat, failed, ~failed & (total >= floor * size), total / SCALE / np.maximum(size, 1)]

    return score, table


def quality_rules(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """Every row of docs with its base counts, score and verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, llr (score per n-gram) for each input row; other columns of docs are not read.
    A null or blank text has no words: all counts but n_symbols are 0 and base_failed holds.
    Rows with a null doc_id are scored, never trusted.  Repeated rows are all returned.
    Without trusted labels every score is 0 and the base rules alone decide.  An empty
    table gives an empty result.
    """
    score, table = _scorer(docs, labels, params or QualityParams())
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"

    def run(batches):
        ratio = np.frombuffer(table.value, np.int64)
        for batch in (part for big in batches for part in slices(big, "text", SLICE)):
            found = score(batch.column(1), ratio)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that the base rules and the score keep.

    Null, empty and blank texts fail the base rules and go.  Rows with a null doc_id are
    scored, never trusted; repeated rows are kept or go alike.  Columns of any name pass
    unchanged; without trusted labels the base rules alone decide; an empty table gives an
    empty result.
    """
    score, table = _scorer(docs, labels, params or QualityParams())
    name = next(c for c in docs.columns if c.lower() == "text")
    at = docs.columns.index(name)

    def run(batches):
        ratio = np.frombuffer(table.value, np.int64)
        for batch in (part for big in batches for part in slices(big, name, SLICE)):
            yield batch.filter(pa.array(score(batch.column(at), ratio)[6]))

    return docs.mapInArrow(run, docs.schema)
