"""Slow, direct versions of the operators, from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, distance=3):
    """doc_id -> (fingerprint, smallest id reachable) of (doc_id, text) rows, in order."""
    fp = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, f"{fp[i]:016x}", min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def byte_repeats(rows, width):
    """(doc_id, n_bytes, n_removed, n_spans, sha) rows."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def later_bytes(rows, width):
    """(doc_id, text without the bytes of strings of width bytes that also start earlier); ids are unique where it counts."""
    texts = [(d, t, (t or "").encode()) for d, t in rows]
    order = lambda d, i: (d is None, d or 0, i)
    first = {}
    for d, _, t in texts:
        for i in range(len(t) - width + 1):
            key = t[i : i + width]
            first[key] = min(first.get(key, order(d, i)), order(d, i))
    out = []
    for d, text, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] < order(d, i):
                gone[i : i + width] = b"\1" * width
        out.append((d, None if text is None else bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")))
    return sorted(out, key=repr)


def word_repeats(rows, width):
    first = {}
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    order = lambda d, i: (d is None, d or 0, i)
    for d, w in docs:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, order(d, i)), order(d, i))
    out = []
    for d, w in docs:
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < order(d, i) for j in range(i, i + width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def level_targets(sizes):
    """Targets by the contract's own words: share, stop at the cap, reshare the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), dict.fromkeys(names, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def top_k(rows, k=5, every=50):
    import math

    sound = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in sound:
        if qi % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in sound if i != qi)[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def flat_article(html):
    """Text of the one article of a page whose article holds only paragraphs, headings, bold text and breaks."""
    import html as entities

    inner = re.search(r"<article>(.*?)</article>", html or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    texts = [" ".join(entities.unescape(re.sub(r"<br>|</?b>", lambda m: " " * (m[0] == "<br>"), x)).split()) for x in blocks]
    return "\n\n".join(x for x in texts if x)


def template_texts(pages, min_pages=5, single_pages=20, share=0.5):
    """page_id -> text of pages (page_id, host, article as nested (tag, text or list of nodes)), counting whole subtrees."""
    groups, content = {"ul", "table"}, {"p", "h2", "li", "ul", "blockquote"}
    kind = lambda tag: "free" if tag not in content else "group" if tag in groups else "single"

    def inside(node):
        yield node
        if not isinstance(node[1], str):
            for child in node[1]:
                yield from inside(child)

    def blocks(node, gone):
        if any(node is g for g in gone):
            return []
        return [node[1]] if isinstance(node[1], str) else [b for child in node[1] for b in blocks(child, gone)]

    seen, mains = defaultdict(set), defaultdict(set)
    for _, host, article in pages:
        nodes = [n for x in article for n in inside(x)]
        free = [n for n in nodes if kind(n[0]) == "free"]
        main = "\n".join(b for x in article for b in blocks(x, free)) or "\n\n".join(b for x in article for b in blocks(x, []))
        mains[host].add(main)
        for n in nodes:
            seen[host, repr(n)].add(main)
    out = {}
    for page_id, host, article in pages:
        nodes = [n for x in article for n in inside(x)]
        often = {"free": min_pages, "group": min_pages, "single": single_pages}
        doomed = [n for n in nodes if len(seen[host, repr(n)]) >= often[kind(n[0])] and (kind(n[0]) == "free" or len(seen[host, repr(n)]) >= share * len(mains[host]))]
        free = [n for n in doomed if kind(n[0]) == "free"]
        left = [b for x in article for b in blocks(x, free)]
        both = [b for x in article for b in blocks(x, doomed)]
        kept = both if 2 * (sum(map(len, left)) - sum(map(len, both))) <= sum(map(len, left)) else left
        out[page_id] = "\n\n".join(kept)
    return out
