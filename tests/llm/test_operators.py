import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grafloom.llm import bpe, common, html_extract, mixing, quality, sharding, simhash, substring_dedup, suffix_dedup, topk, warc
from grafloom.llm.queries import vocabulary_path

from . import brute
from .fixtures import SCHEMA, documents


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns that clash with names used inside
    from pyspark.sql import functions as F

    extra = {c: F.lit(1) for c in ("uid", "h", "size", "key", "spans", "fp", "root", "bucket", "shard", "doc", "s", "kept")}
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(extra).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# 1

LABELS = "doc_id long, quality int, toxic int"


def test_quality_base_counts(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(20, 0, 0), (21, None, None), (None, 1, 0)], LABELS)
    found = plain(quality.quality_rules(docs, labels), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == sorted(((d, *brute.base(t)) for d, t in pairs(rows)), key=repr)


def test_quality_scores_match_direct_sums(spark, docs, rows):
    params = quality.QualityParams(buckets=64, threshold=0.0, ballast=4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)] + [(3, 0, 0), (6, 1, 1)], LABELS)
    trusted = set(range(0, 60, 3)) - {3, 6}

    def grams(t):
        h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in brute.WORD.findall(t or "")]
        return [x % 64 for x in h] + [(a * 31 + b) % 64 for a, b in zip(h, h[1:])]

    raw, good = np.zeros(64), np.zeros(64)
    for d, t in pairs(rows):
        for g in grams(t):
            raw[g] += 1
            good[g] += d in trusted
    weight = np.floor(np.log((good * raw.sum() + params.prior * good.sum()) / (good.sum() * (raw + params.prior))) * quality.SCALE + 0.5)
    want = sorted(((d, not brute.base(t)[-1] and sum(weight[g] for g in grams(t)) >= 0) for d, t in pairs(rows)), key=repr)
    assert plain(quality.quality_rules(docs, labels, params), "doc_id", "kept") == want
    assert len({k for _, k in want}) == 2


def test_quality_without_labels_and_rows(spark, docs, empty):
    labels = spark.createDataFrame([], LABELS)
    assert all(r["kept"] != r["base_failed"] for r in quality.quality_rules(docs, labels).collect())
    assert quality.quality_rules(empty, labels).count() == 0


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab é#\n\t\x0b\x1c—"), max_size=60)), max_size=6), st.booleans())
def test_slice_counts(texts, weak):
    with pytest.MonkeyPatch.context() as patch:
        if weak:  # windows that share a hash are told apart all the same
            patch.setattr(quality, "mix64", lambda x: x % np.uint64(3))
        found = quality.Slice(pa.array(texts, pa.string())).base_counts()
    assert list(zip(*(x.tolist() for x in found))) == [brute.base(t)[:5] for t in texts]


def test_word_hashes():
    r = random.Random(6)
    words = [r.randbytes(n) for n in [*range(70), 200] for _ in range(3)]
    found = quality.word_hashes(*common.utf8(pa.array(words)))
    assert found.tolist() == [int(hashlib.md5(w).hexdigest()[:8], 16) for w in words]


# 2


def test_near_duplicates(docs, rows, empty):
    assert plain(simhash.near_duplicates(docs)) == brute.components(pairs(rows))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("chunk", "blocks"), [(4, None), (512, 9)])
def test_links_in_hot_cells(spark, chunk, blocks):
    r = random.Random(1)
    start = r.getrandbits(64)
    values = {start}
    for _ in range(150):  # a cloud of near fingerprints, and some far ones
        values.add(r.choice(sorted(values)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
        values.add(r.getrandbits(64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in sorted(values)], "fp long")
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.near_links(df, 3, chunk, blocks).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)

    def classes(edges):
        parent = {v: v for v in values}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in edges:
            parent[root(a)] = root(b)
        out = defaultdict(set)
        for v in values:
            out[root(v)].add(v)
        return sorted(map(sorted, out.values()))

    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    assert classes(links) == classes(near)


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=5))
def test_bound_is_below_distance(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    a, b = simhash.embed(np.array([x, y], np.uint64))
    assert int(a ^ b).bit_count() <= (x ^ y).bit_count()
    if (x ^ y).bit_count() <= 3:
        for blocks in (6, 7, 10, 16):
            assert any((int(a) ^ int(b)) & m == 0 for m in simhash.grid_masks(3, blocks))


def test_candidate_pairs_stay_bounded():
    r = np.random.default_rng(2)
    for n in (10_000, 100_000, 1_000_000):
        e = simhash.embed(r.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | r.integers(0, 2, n, dtype=np.uint64))
        pairs = 0
        for m in simhash.grid_masks(3, simhash.block_count(n, 3))[:4]:
            c = np.unique(e & np.uint64(m), return_counts=True)[1]
            pairs += int((c * (c - 1) // 2).sum())
        assert pairs / n < 1
    for n in (10**7, 10**9, 10**11):
        blocks = simhash.block_count(n, 3)
        grids = math.comb(blocks, 3)
        assert grids <= 560 and grids * n * 2 ** (-simhash.SEGMENT_BITS * 32 * (blocks - 3) / blocks) < 5000


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(3, 3), (60, 59)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(tuple(r) for r in common.connected_components(df).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(20, 61)]}}


# 3


def test_mixing(docs, rows, empty):
    got = [r.asDict() for r in mixing.mix_sources(docs).collect()]
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((d, len(brute.WORD.findall(t or ""))) for d, t in pairs(rows) if d is not None)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(brute.WORD.findall(r[1] or ""))
    want = sorted((sizes[s], round(t, 6)) for s, t in brute.level_targets(sizes).items())
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in got}) == sorted(set(want))
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r["source_size"], r["target"]] += r["taken"]
        most[r["source_size"], r["target"]] = max(most[r["source_size"], r["target"]], r["size"])
    assert all(abs(taken[k] - k[1]) <= most[k] for k in taken if k[0])
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(empty).count() == 0


# 4


def test_warc(spark):
    big, small = "é<p>" * 400, "x" * 999
    rows = [(1, "http://a/é?q=1 2", big), (5, None, big), (3, "u", big), (5, "again", big), (7, "http://b", small), (8, "http://c", small), (9, "n", None), (10, "e", ""), (None, "null", big), (None, "n1", "y" * 2000), (None, "n2", "y" * 2000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, offset string").repartition(3)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = 5 if h == big and i != 5 else None
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    assert plain(warc.warc_round_trip(df)) == sorted(want, key=repr)
    folder = common.shared_dir(spark)
    index = warc.write_warc(warc.with_roles(df), folder, file_bytes=300)
    got = warc.read_warc(index.where("page_id in (5, 7)"), folder, stretch=200, gap=0)
    assert plain(got, "page_id", "payload", "url") == sorted([(5, bytearray(big.encode()), None), (5, bytearray(big.encode()), "again"), (7, bytearray(small.encode()), "http://b")], key=repr)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


# 5


def test_jump_hash(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), *(random.Random(k).randrange(-(2**63), 2**63) for k in range(300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 40):
        assert [r[0] for r in df.select(sharding.jump_hash(df.k, n)).collect()] == [brute.jump(k, n) for k in keys]


def test_sharding(docs, rows, empty):
    import zlib

    got = plain(sharding.shard_documents(docs), "doc_id", "size", "text_crc32", "law", "shard", "grown_shard")
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", brute.jump(d or 0, 8), brute.jump(d or 0, 9)) for d, t in pairs(rows)]
    assert got == sorted(want, key=repr)
    slots = defaultdict(list)
    for r in sharding.shard_documents(docs).collect():
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard_documents(empty).count() == 0


# 6

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/x>menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class=ad>Buy</div><article><h1>Head&nbsp;line &amp; more</h1><p>One <b>bold</b>
 text<br>next<p>Two &lt;x&gt; &#233;</p><div class="promo-box">%s</div><div class=note>%s</div>
<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><!-- no <p>c</p> --><form><p>q</p></form>
<aside>side</aside><section id="comments"><p>reader</p></section></article><footer>&copy; x</footer></body></html>"""


def test_html_rules():
    text = html_extract.Page(PAGE % ("p", "")).main_text()
    assert text == "Head line & more\n\nOne bold text next\n\nTwo <x> é\n\na\n\nb\n\n1 2\n\n3"


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post category-social">%s</article>',
        '<article class="post comments-open">%s</article>',
        '<article class="sidebar" id="search">%s</article>',
        '<body class="search"><div class="has-sidebar"><article>%s</article></div></body>',
        '<div class="sidebar"><article>%s</article></div>',
        '<div class="widget"><div id="sidebar"><main class="login">%s</main></div></div>',
        '<div class="sidebar"><main><div class="modal"><article>%s</article></div></main></div>',
        '<article><div class="search-results-explained">%s</div><div class="note-alert">end</div></article>',
        '<article><div class="header">%s</div></article>',
        '<div class="related-posts"><article>teaser</article></div><article>%s</article><div id="comments"><article>me too</article></div>',
        '<main>%s</main><div class="sidebar"><article>teaser</article></div>',
        '<article>%s<div id="comments"><article class="comment">me too</article></div></article>',
        '<article>%s<div>a <span class="ad">buy<div>now</div></span></div></article>',
        '<article>%s<div class="cookie_notice">x</div><div class="social-share-buttons">y</div><div class="share">z</div><ul class="site-nav"><li>n</ul></article>',
    ],
)
def test_html_names_never_drop_the_article(page):
    text = html_extract.Page(page % "<h1>Title</h1><p>text</p>").main_text()
    assert text.startswith("Title\n\ntext") and text[11:] in ("", "\n\nend" * ("note-alert" in page), "\n\na" * ("class=\"ad\"" in page))


def test_html_copies_in_a_wrapper(spark):
    rows = [(i, "http://w.x/", f'<body><p>{i}</p><div class="sidebar"><article><p>copied text</p></article></div></body>') for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.extract_main_text(df).collect()] == ["copied text"] * 9


def test_html_templates(spark):
    rows = [(i, f"http://h{i % 2}.x/{i}", f"<article><p>body {i // 2}</p><div><span>Subscribe now</span></div><p>shared</p></article>") for i in range(20)]
    rows += [(100, "http://h2.x/", "<article><p>only</p><div>Subscribe now</div></article>"), (101, None, None), (102, "u", ""), (103, "u", "bare <i>te</i>xt"), (None, None, "<p>a<p>b")]
    rows += [(200 + i, "http://copy.x", "<article><p>c</p><div>kept</div></article>") for i in range(9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    assert all(got[i] == f"body {i // 2}\n\nshared" for i in range(20))
    assert (got[100], got[101], got[102], got[103], got[None]) == ("only\n\nSubscribe now", "", "", "bare text", "a\n\nb")
    assert all(got[200 + i] == "c\n\nkept" for i in range(9))
    assert all(r["n_chars"] == len(r["text"]) for r in html_extract.extract_main_text(df).collect())
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_html_templates_of_content_tags(spark):
    body = lambda i: f"<h2>Title {i}</h2><p>{f'word{i} ' * 12}</p>"
    notes = "<h3>About us</h3><p>Read our other pages</p><ul><li>one</li><li>two</li></ul>"
    rows = [(i, "http://big.x/", f"<article>{body(i)}{notes}{'<p>quoted</p>' if i % 3 == 0 else ''}</article>") for i in range(30)]
    rows += [(100 + i, "http://small.x/", f"<main>{body(i)}{notes}</main>") for i in range(6)]
    rows += [(200 + i, "http://few.x/", f"<article>{body(i)}{notes if i < 6 else ''}</article>") for i in range(15)]
    copy = "".join(f"<p>paragraph {k} of the copied page</p>" for k in range(5))
    rows += [(300 + i, "http://copies.x/", f"<article>{copy}<p>{i} views</p></article>") for i in range(25)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_extract.extract_main_text(df).collect()}
    own = lambda i: [f"Title {i}", " ".join([f"word{i}"] * 12)]
    about = ["About us", "Read our other pages"]
    assert all(got[i] == own(i) + ["quoted"] * (i % 3 == 0) for i in range(30))
    assert all(got[100 + i] == own(i) + about for i in range(6))
    assert all(got[200 + i] == own(i) + (about + ["one", "two"]) * (i < 6) for i in range(15))
    assert all(got[300 + i] == [f"paragraph {k} of the copied page" for k in range(5)] + [f"{i} views"] for i in range(25))


def test_html_equals_direct_versions(spark):
    """The flat articles of the test pages, and counted subtrees of made ones."""
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: brute.flat_article(r["html"]) for r in given.collect()}
    assert {r["page_id"]: r["text"] for r in html_extract.extract_main_text(given).collect()} == want

    r = random.Random(8)
    shared = {h: [("div", f"{h} sign up"), ("ul", [("li", f"{h} one"), ("li", f"{h} two")]), ("p", f"about {h}"), ("section", [("h2", f"more {h}"), ("p", "read on")])] for h in "abc"}
    pages = []
    for i in range(120):
        h = "aaaaabbbc"[i % 9]
        own = [("h2", f"title {i // 2}"), *(("p", " ".join(r.choices(["to", "be", "or", "not"], k=r.randint(1, 30)))) for _ in range(r.randint(0, 4)))]
        pages.append((i, h, own + [x for x in shared[h] if r.random() < {"a": 0.9, "b": 0.6, "c": 0.3}[h]]))
    render = lambda n: f"<{n[0]}>{n[1] if isinstance(n[1], str) else ''.join(map(render, n[1]))}</{n[0]}>"
    rows = [(i, f"https://u@{h}:80/x", f"<article>{''.join(map(render, x))}</article>") for i, h, x in pages]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    want = brute.template_texts(pages)
    assert got == want and sum("sign up" in t for t in want.values()) < 20 < sum("sign up" in str(x) for _, _, x in pages)


def test_html_frames_by_form(spark):
    """Menus whose words vary are counted by their form; on pages without article they go by it, and text does not."""
    menu = lambda i, k: "".join(f'<li><a href="/{i}">entry {i} {j}</a></li>' for j in range(k))
    rows = []
    for i in range(12):
        text = f"<div class=text><p>{f'page{i} ' * 30}</p><p>see <a href=x>more {i}</a></p></div>"
        rows.append((i, "http://soup.x/", f'<body><div class="top"><ul>{menu(i, 3 + i % 3)}</ul></div>{text}<div class="low"><a>next {i}</a> <a>back {i}</a></div></body>'))
        rows.append((100 + i, "http://site.x/", f"<body><nav><ul>{menu(i, 4)}</ul></nav><div class=ad>buy {i}</div><article><p>story {i}</p></article><footer>year {i}</footer></body>"))
    rows.append((200, "http://lone.x/", rows[0][2]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    words = lambda i: " ".join([f"page{i}"] * 30)
    assert all(got[i] == f"{words(i)}\n\nsee more {i}" and got[100 + i] == f"story {i}" for i in range(12))
    assert got[200] == f"entry 0 0\n\nentry 0 1\n\nentry 0 2\n\n{words(0)}\n\nsee more 0\n\nnext 0 back 0"
    found = html_extract.page_templates(html_extract.parse_pages(df), 5, 20, 0.5).collect()
    assert sorted((r["host"], r["n"]) for r in found if r["kind"] == html_extract.FRAME and r["host"] == "site.x") == [("site.x", 12)] * 3


@settings(deadline=None)
@given(st.text(alphabet="<>/pbdiv \"'=&;!-a", max_size=80))
def test_html_never_fails(source):
    html_extract.Page(source).main_text()


# 7


@settings(deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_two_stage_order(segments):
    text = np.frombuffer(b"".join(segments), np.uint8)
    want = np.random.default_rng(len(text)).random(len(text)) < 0.7
    order = suffix_dedup.two_stage_order(text, want, 1 << 20)
    raw = text.tobytes()
    assert order.tolist() == sorted(np.flatnonzero(want).tolist(), key=lambda i: raw[i:])
    seen = [s[i : i + 6] for s in segments for i in range(len(s) - 5)]
    starts = suffix_dedup.repeated_windows(segments, 6)
    for s, hits in zip(segments, starts):
        assert hits.tolist() == [i for i in range(len(s) - 5) if seen.count(s[i : i + 6]) > 1]
    places = np.arange(len(text))[::-1].copy()  # the last copy is the first
    later = suffix_dedup.repeated_windows(segments, 6, places)
    for k, (s, hits) in enumerate(zip(segments, later)):
        after = [x[i : i + 6] for x in segments[k + 1 :] for i in range(len(x) - 5)]
        assert hits.tolist() == [i for i in range(len(s) - 5) if s[i : i + 6] in after + [s[j : j + 6] for j in range(i + 1, len(s) - 5)]]


@pytest.mark.parametrize("hot", [1, 1024])
def test_suffix_dedup(docs, rows, empty, hot):
    assert plain(suffix_dedup.suffix_dedup(docs, 400, hot)) == brute.byte_repeats(pairs(rows), 400)
    assert plain(suffix_dedup.suffix_dedup(docs, 60, hot)) == brute.byte_repeats(pairs(rows), 60)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def near_copies(n):
    """One text of 1,500 letters n times, each time with about six other letters."""
    rng = random.Random(5)
    base = [rng.choice("abcdefgh ") for _ in range(1500)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(len(text)), 6):
            text[at] = rng.choice("xyz")
        out.append((i, "".join(text)))
    return out


def test_suffix_classes_of_a_large_group(spark, monkeypatch):
    made, segments, cut = [], [], suffix_dedup._classes

    def counted(parts, width, size):
        if size == max(suffix_dedup.CLASSES):
            segments.append(parts.count())
        made.append(cut(parts, width, size).count())
        return cut(parts, width, size)

    monkeypatch.setattr(suffix_dedup, "_classes", counted)
    rows_made = []
    for n in (100, 200):
        rows = near_copies(n)
        made.clear(), segments.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = plain(suffix_dedup.suffix_dedup(df, 400, 8))
        assert got == brute.byte_repeats(rows, 400)
        assert 0 < sum(r[2] for r in got) < sum(r[1] for r in got)
        assert sum(made) <= 6 * segments[0]
        assert len(made) > 1  # some cores are cut finer
        rows_made.append((sum(made), segments[0]))
    (few, of_few), (many, of_many) = rows_made
    assert of_many > 1.5 * of_few and many / of_many <= 1.5 * few / of_few  # in proportion to the segments


@pytest.mark.parametrize("hot", [1, 1024])
@pytest.mark.parametrize("first_stays", [False, True])
def test_cut_repeats(spark, rows, hot, first_stays):
    from pyspark.sql import functions as F

    clash = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("uid", "UID_", "spans", "doc", "s", "h", "data", "first", "c")})
    out = suffix_dedup.cut_repeats(clash, 60, hot, first_stays)
    assert out.schema == clash.schema
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    if first_stays:
        order = {i: k for k, i in enumerate(sorted({r[0] for r in rows if r[0] is not None}))}
        alone = {d for d in order if sum(r[0] == d for r in rows) == 1}
        want = brute.later_bytes(pairs(rows), 60)
        assert [x for x in got if x[0] in alone] == [x for x in want if x[0] in alone]
        assert any(t and len(t) < len(u) for (_, t), (_, u) in zip(want, sorted(pairs(rows), key=repr)))
    else:
        lost = {d: n - k for d, n, k, *_ in brute.byte_repeats(pairs(rows), 60) if d is not None and d not in (4, 9)}
        assert all(0 <= lost[d] - len((t or "").encode()) <= 8 for d, t in got if d in lost)
    assert sum(t is None for _, t in got) == sum(r[1] is None for r in rows)


def test_cut_repeats_classes_as_in_the_pipeline(spark, monkeypatch):
    made, segments, cut = [], [], suffix_dedup._classes

    def counted(parts, width, size):
        if not made:
            segments.append(parts.count())
        made.append(cut(parts, width, size).count())
        return cut(parts, width, size)

    monkeypatch.setattr(suffix_dedup, "_classes", counted)
    rows = near_copies(100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = plain(suffix_dedup.cut_repeats(df, 200, 16, first_stays=True))
    assert got == sorted(brute.later_bytes(rows, 200), key=repr)
    assert sum(made) <= 4 * segments[0], (made, segments)


# 8


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe(docs, rows, empty, reference_tokenizer):
    want = []
    for d, t in pairs(rows):
        ids = reference_tokenizer.encode(t or "", add_special_tokens=False).ids
        back = reference_tokenizer.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    for size in (1, 300):
        assert plain(bpe.bpe_round_trip(docs, vocabulary_path(), size)) == sorted(want, key=repr)
    assert bpe.bpe_round_trip(empty, vocabulary_path()).count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(vocabulary_path()) as f:
        vocabulary = bpe.Vocabulary(f.read())
    words = ["the", " the", " of", " often", "often", "e", " e's"]
    data = bpe.compile_lexicon(bpe.packed_words(vocabulary, words))
    return bpe.Encoder(vocabulary, bpe.Lexicon(data))


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0xFFFF), st.sampled_from(" \n\t\x1c\x85 'sdé1the")), max_size=60), st.booleans())
def test_encoder_equals_library(encoder, reference_tokenizer, text, special):
    text += "<|endoftext|> x" * special
    [packed] = encoder.encode([text])
    assert np.frombuffer(packed, "<u4").tolist() == reference_tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.decode([packed]) == [text]


def test_slices_merge_in_step(encoder, reference_tokenizer, monkeypatch):
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("theandoiéж1'", k=r.randint(1, 60))) for _ in range(r.randint(0, 40))) for _ in range(60)]
    want = [reference_tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for size, segment in ((8_000_000, 4_000_000), (300, 50), (1, 1)):  # one slice, several, and cut texts
        monkeypatch.setattr(bpe, "SLICE", size)
        monkeypatch.setattr(bpe, "SEGMENT", segment)
        got = encoder.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want and encoder.decode(got) == texts


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000ab,é\u2014"), max_size=12), max_size=4))
def test_words_are_cut_like_the_pattern(texts):
    raw, ends = common.utf8(pa.array(texts, pa.large_string()))
    starts = [*bpe.word_starts(raw, ends).tolist(), len(raw)]
    assert [raw[a:b].tobytes().decode() for a, b in zip(starts, starts[1:])] == [w for t in texts for w in bpe.CHUNK.findall(t)]


def test_frequent_words_are_bounded(spark):
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(" ".join(words),), (" ".join(words),), (None,)], "text string")
    found = bpe.frequent_words(docs, 150)
    assert 100 < len(found) <= 150 and found != [] and bpe.frequent_words(docs, 10_000) and not bpe.frequent_words(docs, 0)


def test_long_words_merge_exactly(encoder, reference_tokenizer):
    r = random.Random(3)
    for word in ("a" * 1000, "ab" * 700, "".join(r.choices("theandoi", k=3000))):
        assert encoder.vocabulary.encode_words(pa.array([word.encode()]))[0].tolist() == reference_tokenizer.encode(word, add_special_tokens=False).ids


@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_lexicon(words):
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: np.array([len(w), i], "<u4").tobytes() for i, w in enumerate(sorted(words))}))
    assert lexicon.numbers(pa.array(sorted(words), pa.binary())).tolist() == list(range(len(words)))
    assert [lexicon.ids[a:b].tolist() for a, b in zip(lexicon.start, lexicon.start[1:])] == [[len(w), i] for i, w in enumerate(sorted(words))]
    assert lexicon.numbers(pa.array([b"\7", b"\0" * 6, b"\1\3", b""])).tolist() == [-1] * 4


# 9


def test_substring_dedup(docs, rows, empty):
    assert plain(substring_dedup.substring_dedup(docs)) == brute.word_repeats(pairs(rows), 20)
    assert plain(substring_dedup.substring_dedup(docs, 8)) == brute.word_repeats(pairs(rows), 8)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_full_sketch_loses_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "sketch_cells", lambda chars, most: 64)
    assert plain(substring_dedup.substring_dedup(docs)) == brute.word_repeats(pairs(rows), 20)


@given(st.lists(st.integers(0, 40), max_size=60))
def test_sketch_never_underestimates(keys):
    sketch = substring_dedup.Sketch(64)
    for k in range(0, len(keys), 7):
        sketch.add(np.array(keys[k : k + 7], np.uint64))
    for key in set(keys):
        if keys.count(key) > 1:
            for r in range(substring_dedup.ROWS):
                at = int(substring_dedup.Sketch.places(np.array([key], np.uint64), 64, r)[0])
                assert sketch.again[r][at >> 3] >> (at & 7) & 1


# 10


def test_top_k(spark):
    r = random.Random(4)
    vec = lambda: [r.choice([-1.0, -0.5, 0.0, 0.25, 0.503]) for _ in range(6)]
    rows = [(i, vec()) for i in range(0, 600)]
    rows += [(50 * k + 1000, v) for k, v in enumerate([None, [float("nan")] * 6, [1.0, None], [float("inf")] * 6, [], [1.0], [0.1] * 9])] + [(None, vec())]
    df = spark.createDataFrame([(*x, 3, 1) for x in rows], "vec_id long, embedding array<double>, label int, v int").repartition(4)
    assert plain(topk.top_k_search(df)) == sorted(brute.top_k(rows), key=repr)
    assert plain(topk.top_k_search(df.unionByName(df), pivots=7, group_rows=40, together=3)) == sorted(brute.top_k(rows), key=repr)
    assert plain(topk.top_k_search(df, pivots=1, group_rows=100)) == sorted(brute.top_k(rows), key=repr)
    few = df.where("vec_id in (0, 1, 2)")
    assert plain(topk.top_k_search(few)) == sorted(brute.top_k([x for x in rows if x[0] in (0, 1, 2)]), key=repr)
    assert topk.top_k_search(df.limit(0)).count() == 0


def test_top_k_prunes_where_rows_have_structure():
    r = np.random.default_rng(1)
    centre = r.normal(size=(40, 64)) * 200
    rows = np.floor(np.repeat(centre, 50, axis=0) + r.normal(size=(2000, 64)) * 10).astype(np.int64)
    ids = np.arange(2000)
    index = topk.Blocks(ids, rows)
    at = np.arange(0, 2000, 20)
    name, score = index.best(ids[at], rows[at], 5, np.full(len(at), topk.NONE))
    want = [sorted((-int(s), i) for i, s in enumerate(rows @ rows[q]) if i != q)[:5] for q in at]
    assert [[(-s, i) for s, i in zip(x, y)] for x, y in zip(score.tolist(), name.tolist())] == want
    assert index.scored < 0.2 * len(at) * len(rows)
    # a k-th score known beforehand loses none that reaches it
    name, _ = index.best(ids[at], rows[at], 5, score[:, 2])
    assert [x[:3] for x in name.tolist()] == [[i for _, i in x[:3]] for x in want]


def test_utf8_view_of_sliced_batches():
    col = pa.array(["ab", None, "é", ""]).slice(1)
    raw, offsets = common.utf8(col)
    assert raw.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 2, 2]
