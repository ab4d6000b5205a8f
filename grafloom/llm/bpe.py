"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's frequent words (a word is a stretch without white space and the space before
it) are encoded once and compiled into a minimal automaton: common prefixes and common
suffixes are shared, every edge carries how many words it skips, and so a walk ends at the
word's number, which leads to its ids.  The automaton is one flat file, its edges an
open-addressed table, that the Python workers of an executor map into memory.  Words it
does not hold are split by the tokenizer's pattern and merged exactly; both ways lead to
the same ids.

A slice of texts is encoded at once: its bytes are cut into words, its distinct words walk the
automaton in step, byte by byte, and those left merge in step, a pair of each at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, distinct, gathered, materialize, mix64, short_batches, slices, utf8

_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space as the tokenizer's pattern sees it, cut the same way; the rest is left to words.
CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

#: Texts longer than SEGMENT characters are cut between two words; slices hold about SLICE bytes.
SEGMENT, SLICE = 4_000_000, 8_000_000
#: Pieces up to this many bytes are merged together; the few longer ones alone.
TOGETHER = 48
#: Stands for a pair that no merge joins; above every rank and place.
NO_PAIR = np.int32(np.iinfo(np.int32).max)


class Table:
    """Integers below 2**32 - 1 to places of an array, by open addressing."""

    EMPTY = np.uint32(0xFFFFFFFF)

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple["Table", np.ndarray]:
        """The table of distinct keys, and the place of each."""
        out = cls(np.full(1 << max(4 * len(keys), 2).bit_length(), cls.EMPTY, np.uint32))
        slot, open_ = out._slot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[out.keys[slot[open_]] == cls.EMPTY]
            out.keys[slot[free]] = keys[free]  # of those that meet, the last one stays
            open_ = open_[out.keys[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + 1) & (len(out.keys) - 1)
        return out, slot

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, slot, -1)
        open_ = np.flatnonzero((there != keys) & (there != self.EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (there != self.EMPTY)]
        return out


def _kinds() -> np.ndarray:
    """For each byte: 1 white space, 2 may be part of a word of Latin letters alone, 0 neither."""
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(9, 14), 32]] = 1
    kinds[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC9), *range(0x80, 0xC0)]] = 2
    return kinds


KINDS = _kinds()


def odd_spaces(raw: np.ndarray) -> np.ndarray:
    """Places of white space of more than one byte."""
    out = []
    for head, rest in ((0xC2, {b"\x85", b"\xa0"}), (0xE1, {b"\x9a\x80"}), (0xE3, {b"\x80\x80"}), (0xE2, {b"\x81\x9f", *(bytes((0x80, b)) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF))})):
        n = len(next(iter(rest)))
        at = np.flatnonzero(raw[: max(len(raw) - n, 0)] == head)
        if len(at):
            tail = np.stack([raw[at + 1 + k] for k in range(n)], axis=1)
            out.append(at[np.any([(tail == np.frombuffer(x, np.uint8)).all(axis=1) for x in rest], axis=0)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def word_starts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the words of CHUNK start in texts laid end to end; begins: where the texts do, and the end."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    space = KINDS[raw] == 1
    first = np.zeros(n + 1, bool)
    first[begins] = True
    before = np.concatenate([[False], space[:-1]]) & ~first[:n]
    word_next = np.concatenate([~space[1:], [False]]) & ~first[1:]
    after_other = np.concatenate([[False], raw[:-1] != 32]) & before
    start = first[:n] | np.where(space, ~before | word_next, after_other)
    for k in np.unique(np.searchsorted(begins, odd_spaces(raw), side="right") - 1).tolist():
        a, b = int(begins[k]), int(begins[k + 1])
        lengths = [len(x.encode()) for x in CHUNK.findall(raw[a:b].tobytes().decode("utf-8"))]
        start[a:b] = False
        start[a + np.cumsum([0, *lengths[:-1]])] = True
    return np.flatnonzero(start)


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library, without normaliser or prefix space."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or spec["post_processor"] or pre != pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("not a plain byte-level BPE")
        chars = _byte_chars()
        to_bytes = lambda t: bytes(map(chars.__getitem__, t))
        self.tokens = {i: to_bytes(t) for t, i in model["vocab"].items()}
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that touch their surroundings")
            self.special[t["content"]] = t["id"]
            self.tokens[t["id"]] = t["content"].encode()
        self.bytes = [model["vocab"][c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        names = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.token_bytes, self.token_count = np.frombuffer(b"".join(names), np.uint8), np.array(list(map(len, names)))
        self.token_start = np.cumsum(self.token_count) - self.token_count
        # rank of a merge by its left and right id, and the id it makes by its rank
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        place = model["vocab"].__getitem__
        self.merged = np.array([place(a + b) for a, b in pairs], np.int32)
        if max(self.tokens) >= 1 << 16 or len(pairs) >= 1 << 22:
            raise ValueError("ids or ranks are too large for pairs of 32 bits")
        left, right = (np.array([place(m[k]) for m in pairs], np.uint32) for k in (0, 1))
        self.pairs, slot = Table.build(left << np.uint32(16) | right)
        self.rank = np.full(len(self.pairs.keys), -1, np.int32)
        self.rank[slot] = np.arange(len(pairs))
        self.ranks = dict(zip(zip(left.tolist(), right.tolist(), strict=True), range(len(pairs)), strict=True))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one pre-token: always the leftmost pair of least rank; a heap over a linked list."""
        ids = [self.bytes[b] for b in word]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def push(k):
            if k >= 0 and after[k] < n:
                found = self.ranks.get((ids[k], ids[after[k]]))
                if found is not None:
                    heapq.heappush(heap, (found, k, ids[k], ids[after[k]]))

        for k in range(n - 1):
            push(k)
        while heap:
            found, k, a, b = heapq.heappop(heap)
            if not alive[k] or ids[k] != a or after[k] >= n or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], alive[gone], after[k] = int(self.merged[found]), False, after[gone]
            if after[k] < n:
                before[after[k]] = k
            push(before[k])
            push(k)
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of pairs in one integer, so that the least is the leftmost of least rank."""
        at = self.pairs.find(left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32))
        return np.where(at >= 0, self.rank[at] << np.int32(8) | place.astype(np.int32), NO_PAIR)

    def _merge_like(self, raw: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of pieces of about the same length, a merge of each piece at a time: all ids, and how many each has."""
        n, tall = len(start), int(lengths.max())
        text = raw[np.minimum(start + np.arange(tall)[:, None], len(raw) - 1)]
        inside = np.arange(tall)[:, None] < lengths
        ids = np.where(inside, np.array(self.bytes, np.int32)[text], -1)
        rows = np.arange(tall, dtype=np.int16)[:, None]
        # the row below tall stands for the end of every piece
        after = np.where(rows + 1 < lengths, rows + np.int16(1), np.int16(tall)).astype(np.int16)
        before = np.repeat(np.arange(-1, tall, dtype=np.int16)[:, None], n, axis=1)
        keys = np.full((tall, n), NO_PAIR, np.int32)
        if tall > 1:
            r, c = np.nonzero(inside[1:])
            keys[r, c] = self._keys(ids[r, c], ids[r + 1, c], r)
        cols = np.arange(n)  # pieces that may still merge, and where they stand
        done = ids.copy()
        while len(cols):
            best = keys.min(axis=0)
            live = np.flatnonzero(best != NO_PAIR)
            if 2 * len(live) < len(cols):  # leave the finished ones behind
                done[:, cols] = ids
                cols, ids, after, before, keys, best = cols[live], ids[:, live], after[:, live], before[:, live], keys[:, live], best[live]
                live = np.arange(len(cols))
                if not len(cols):
                    break
            best = best[live]
            at = (best & np.int32(255)).astype(np.int64)
            new = self.merged[best >> np.int32(8)]
            gone = after[at, live].astype(np.int64)
            follower = after[gone, live].astype(np.int64)
            ids[at, live], ids[gone, live], keys[gone, live] = new, -1, NO_PAIR
            after[at, live] = follower
            more = follower < tall
            f, c, k = follower[more], live[more], at[more]
            before[f, c] = k
            keys[at, live] = NO_PAIR
            keys[k, c] = self._keys(new[more], ids[f, c], k)
            front = before[at, live].astype(np.int64)
            more = front >= 0
            f, c = front[more], live[more]
            keys[f, c] = self._keys(ids[f, c], new[more], f)
        if len(cols):
            done[:, cols] = ids
        flat = np.ascontiguousarray(done.T)
        real = flat >= 0
        return flat[real].astype(np.uint32), real.sum(axis=1)

    def merge_all(self, raw: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces of raw: all ids, and where each piece's begin and how many it has."""
        count, found = np.zeros(len(start), np.int64), []
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= TOGETHER]
        for k in range(0, len(short), 4096):
            some = short[k : k + 4096]
            ids, count[some] = self._merge_like(raw, start[some], lengths[some])
            found.append(ids)
        for i in order[len(short) :].tolist():
            found.append(np.array(self.merge(raw[start[i] : start[i] + lengths[i]].tobytes()), np.uint32))
            count[i] = len(found[-1])
        begin = np.zeros(len(start), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(found) if found else np.zeros(0, np.uint32), begin, count

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words that no special token touches: a pool of ids, and where each word's begin and how many it has."""
        raw, ends = utf8(words)
        start, lengths = ends[:-1], np.diff(ends)
        if not len(start):
            return np.zeros(0, np.uint32), start, lengths
        # words of Latin letters alone are one piece; U+00D7 and U+00F7 are no letters
        plain = KINDS[raw] == 2
        sign = np.flatnonzero((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
        plain[sign] = False
        plain[start] |= (raw[start] == 32) & (lengths > 1)
        whole = np.logical_and.reduceat(plain, start)
        owner, pieces, sizes = [], [], []
        for i in np.flatnonzero(~whole).tolist():
            found = [x.encode("utf-8") for x in PATTERN.findall(raw[ends[i] : ends[i + 1]].tobytes().decode("utf-8"))]
            owner += [i] * len(found)
            pieces += found
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        more = np.frombuffer(b"".join(pieces), np.uint8)
        owner = np.concatenate([np.flatnonzero(whole), np.array(owner, np.int64)])
        size = np.concatenate([lengths[whole], sizes])
        at = np.concatenate([start[whole], len(raw) + np.cumsum(sizes) - sizes])
        order = np.argsort(owner, kind="stable")
        owner, size, at = owner[order], size[order], at[order]
        # pieces recur in many words: each distinct one is merged once
        flat = gathered(np.concatenate([raw, more]), at, size)
        which, names = distinct(flat, np.cumsum(size) - size, len(flat))
        raw, ends = utf8(names)
        ids, begin, count = self.merge_all(raw, ends[:-1], np.diff(ends))
        of_word = np.bincount(owner, weights=count[which], minlength=len(start)).astype(np.int64)
        return gathered(ids, begin[which], count[which]), np.cumsum(of_word) - of_word, of_word


class Lexicon:
    """Reader of the automaton file; numbers words from 0 in byte order."""

    def __init__(self, buffer):
        slots, states, words, ids, self.root, self.longest = np.frombuffer(buffer, np.int64, 6).tolist()
        at = 48

        def take(kind, n):
            nonlocal at
            view = np.frombuffer(buffer, kind, n, at)
            at += -(-view.nbytes // 8) * 8
            return view

        self.edges = Table(take(np.uint32, slots))  # state * 256 + byte
        self.target, self.skip = take(np.uint32, slots), take(np.uint32, slots)
        self.final = take(np.uint8, states)
        self.start, self.ids = take(np.uint32, words + 1), take(np.uint32, ids)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number, or -1."""
        text, ends = utf8(words)
        first, lengths = ends[:-1], np.diff(ends)
        state, n = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        state[lengths > self.longest] = -1
        walking = np.flatnonzero(state >= 0)
        for k in range(self.longest):
            walking = walking[lengths[walking] > k]
            if not len(walking):
                break
            edge = self.edges.find((state[walking] << 8 | text[first[walking] + k]).astype(np.uint32))
            state[walking[edge < 0]] = -1
            walking, edge = walking[edge >= 0], edge[edge >= 0]
            state[walking] = self.target[edge]
            n[walking] += self.skip[edge]
        known = np.flatnonzero(state >= 0)
        out = np.full(len(words), -1, np.int64)
        known = known[self.final[state[known]] > 0]
        out[known] = n[known]
        return out


def compile_lexicon(words: dict[bytes, bytes]) -> bytes:
    """The automaton of words and their packed ids; equal right languages share one state."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, state), ...))
    counts: list[int] = []

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(int(node[0]) + sum(counts[t] for _, t in node[1]))
        return register[key]

    ordered = sorted(words)
    path = [[False, []]]
    last = b""
    for word in ordered:
        common = len(os.path.commonprefix([last, word]))
        while len(path) - 1 > common:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    keys, target, skip = [], [], []
    for state, (final, edges) in enumerate(states):
        n = int(final)
        for byte, t in edges:
            keys.append(state << 8 | byte)
            target.append(t)
            skip.append(n)
            n += counts[t]
    edges, slot = Table.build(np.array(keys, np.uint32))
    target_at, skip_at = np.zeros(len(edges.keys), np.uint32), np.zeros(len(edges.keys), np.uint32)
    target_at[slot], skip_at[slot] = target, skip
    start = np.concatenate([[0], np.cumsum([len(words[w]) // 4 for w in ordered], dtype=np.int64)])
    head = [len(edges.keys), len(states), len(ordered), int(start[-1]), root, max(map(len, ordered), default=0)]
    parts = [np.array(head, np.int64), edges.keys, target_at, skip_at, np.array([s[0] for s in states], np.uint8), start.astype(np.uint32), np.frombuffer(b"".join(words[w] for w in ordered), "<u4")]
    return b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


def map_into_memory(data: bytes, name: str):
    """The bytes as a read-only mapped file in the executor's own folder, which its workers share and Spark removes."""
    folder = SparkFiles.getRootDirectory()
    path = os.path.join(folder if os.path.isdir(folder) else tempfile.gettempdir(), f"{name}.lexicon")
    if not os.path.exists(path):
        with open(mine := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(mine, path)
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Encoder:
    """Encodes and decodes lists of texts."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def segments(self, text: str) -> list[str | int]:
        """Parts that are encoded apart: special tokens as their ids, and long texts cut between two words."""
        split, named = self.vocabulary.split, self.vocabulary.special
        parts = split.split(text) if split is not None and split.search(text) else [text]
        out: list[str | int] = []
        for part in parts:
            if part in named:
                out.append(named[part])
                continue
            at = 0
            while len(part) - at > SEGMENT:
                cut = part.find(" ", at + SEGMENT)
                while cut > 0 and (part[cut - 1].isspace() or part[cut + 1 : cut + 2].isspace()):
                    cut = part.find(" ", cut + 1)
                if cut < 0:
                    break
                out.append(part[at:cut])
                at = cut
            out.append(part[at:])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        raw, ends = utf8(pa.array(texts, pa.large_string()))
        start = word_starts(raw, ends)
        if not len(start):
            return [b""] * len(texts)
        which, words = distinct(raw, start, len(raw))
        number = self.lexicon.numbers(words)
        known = number >= 0
        begin, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[known] = self.lexicon.start[number[known]]
        count[known] = self.lexicon.start[number[known] + 1] - self.lexicon.start[number[known]]
        ids, at, n = self.vocabulary.encode_words(words.filter(pa.array(~known)))
        begin[~known], count[~known] = at + len(self.lexicon.ids), n
        flat = gathered(np.concatenate([self.lexicon.ids, ids]), begin[which], count[which]).astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(count[which])]) * 4
        cuts = upto[np.searchsorted(start, ends)].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts = [self.segments(t) for t in texts]
        flat = [x for p in parts for x in p if isinstance(x, str)]
        found, some, size = [], [], 0
        for x in flat:
            some.append(x)
            size += len(x)
            if size >= SLICE:
                found += self._encode(some)
                some, size = [], 0
        found = iter(found + self._encode(some))
        return [b"".join(next(found) if isinstance(x, str) else x.to_bytes(4, "little") for x in p) for p in parts]

    def decode(self, lists: list[bytes]) -> list[str]:
        """Text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
        v = self.vocabulary
        ids = np.frombuffer(b"".join(lists), "<u4").astype(np.int64)
        flat = gathered(v.token_bytes, v.token_start[ids], v.token_count[ids]).tobytes()
        upto = np.concatenate([[0], np.cumsum(v.token_count[ids])])
        cuts = upto[np.cumsum([0, *(len(x) // 4 for x in lists)])].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def frequent_words(docs: DataFrame, most: int) -> list[str]:
    """At most ``most`` words: those that occur most often in all texts.

    The bound is found in a histogram of counts on a logarithmic scale; the step that does
    not fit whole gives the words of its first hash buckets.  So what reaches the driver
    never exceeds ``most`` words, whatever the number of tasks.
    """

    def count(batches):
        for big in batches:
            for batch in slices(big, "text", SLICE):
                raw, ends = utf8(batch.column(0))
                which, words = distinct(raw, word_starts(raw, ends), len(raw))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(which, minlength=len(words)))], names=["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    words = materialize(counted.where("length(word) < 100").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
    bucket = F.pmod(F.xxhash64("word"), F.lit(4096))
    least, edge, upto, room = 1 << 30, -1, 0, most  # steps from least on, and of the step at the edge the buckets below upto
    for step, n in words.groupBy("step").count().orderBy(F.desc("step")).collect():  # 8 * 63 rows at most
        if n <= room:
            least, room = step, room - n
            continue
        edge = step
        for b, m in words.where(F.col("step") == step).groupBy(bucket.alias("bucket")).count().orderBy("bucket").collect():
            if m > room:
                break
            upto, room = b + 1, room - m
        break
    taken = (F.col("step") >= least) | ((F.col("step") == edge) & (bucket < upto))
    found = [r[0] for r in words.where(taken).select("word").collect()]
    discard(words)
    return found


def packed_words(vocabulary: Vocabulary, words: list[str]) -> dict[bytes, bytes]:
    """Words and their ids as little-endian 32-bit integers."""
    ids, at, n = vocabulary.encode_words(pa.array(words, pa.string()).cast(pa.binary()))
    ids = ids.astype("<u4")
    return {w.encode("utf-8"): ids[a : a + m].tobytes() for w, a, m in zip(words, at.tolist(), n.tolist(), strict=True)}


def build_encoder(spark: SparkSession, docs: DataFrame, vocabulary_file: str, lexicon_words: int):
    """Broadcast vocabulary and automaton (bounded by the vocabulary and lexicon_words), and a maker of encoders for workers."""
    with open(vocabulary_file, encoding="utf-8") as f:
        source = f.read()
    vocabulary = Vocabulary(source)
    words = [w for w in frequent_words(docs, lexicon_words) if not (vocabulary.split and vocabulary.split.search(w))]
    lexicon = compile_lexicon(packed_words(vocabulary, words))
    name = hashlib.sha256(source.encode("utf-8") + lexicon).hexdigest()
    shared = spark.sparkContext.broadcast((source, lexicon))

    def make() -> Encoder:
        return _encoder(name, shared)

    return make


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, shared) -> Encoder:
    """The encoder of a worker process; the last one is kept for its next task."""
    if name not in _encoders:
        source, data = shared.value
        _encoders.clear()
        _encoders[name] = Encoder(Vocabulary(source), Lexicon(map_into_memory(data, name)))
    return _encoders[name]


def bpe_round_trip(docs: DataFrame, vocabulary_file: str, lexicon_words: int = 1 << 17, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs; ``with_ids`` adds the ids.

    The ids are those of the tokenizers library without added special tokens; strings of
    special tokens in a text become these tokens.  A null text is empty: no ids.  A null
    doc_id and repeated rows are kept as they are; other columns are not read; an empty
    table gives an empty result.  vocabulary_file is read on the driver.
    """
    short_batches(docs.sparkSession)
    make = build_encoder(docs.sparkSession, docs, vocabulary_file, lexicon_words)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        encoder = make()
        for batch in (part for big in batches for part in slices(big, "text", SLICE)):
            found = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            rows = [
                (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest(), *[np.frombuffer(ids, "<i4").tolist()] * with_ids)
                for doc_id, ids, back in zip(batch.column(0).to_pylist(), found, encoder.decode(found), strict=True)
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (4 + with_ids)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 4 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
