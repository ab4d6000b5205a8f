"""The whole pipeline against a direct version of its stages."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from grafloom.llm import quality
from grafloom.llm.queries import vocabulary_path

from . import brute
from .fixtures import SCHEMA, documents

PARAMS = quality.QualityParams()


def kept_by_quality(rows, trusted):
    def grams(text):
        h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in brute.WORD.findall(text or "")]
        return [x % PARAMS.buckets for x in h] + [(a * 31 + b) % PARAMS.buckets for a, b in zip(h, h[1:])]

    raw, good = np.zeros(PARAMS.buckets), np.zeros(PARAMS.buckets)
    for r in rows:
        np.add.at(raw, grams(r[1]), 1)
        if r[0] in trusted:
            np.add.at(good, grams(r[1]), 1)
    ratio = np.log((good * raw.sum() + PARAMS.prior * good.sum()) / (good.sum() * (raw + PARAMS.prior)))
    value = np.floor(ratio * quality.SCALE + 0.5)
    least = round(PARAMS.threshold * quality.SCALE)
    return [r for r in rows if not brute.base(r[1])[-1] and sum(value[g] for g in grams(r[1])) >= least * (len(grams(r[1])) + PARAMS.ballast)]


def one_of_group(rows):
    component = {d: c for d, _, c in brute.components([(r[0], r[1]) for r in rows])}
    return [r for r in rows if component[r[0]] == r[0]]


def cut(rows):
    texts = dict(brute.later_bytes([(r[0], r[1]) for r in rows], corpus_pipeline.REPEAT_BYTES))
    return [(r[0], texts[r[0]], *r[2:]) for r in rows]


def mixed(rows):
    size = {r[0]: len(brute.WORD.findall(r[1] or "")) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    target = brute.level_targets(sizes)
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    items = []
    for s in names:
        total = 0
        for h, d in sorted((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]) for r in rows if r[3] == s):
            total += size[d]
            items += [((total + e * sizes[s]) / target[s], names.index(s), e, h, d) for e in range(3) if size[d] and total + e * sizes[s] - size[d] < target[s]]
    used, taken = 0, []
    for item in sorted(items):
        used += size[item[-1]]
        if used > sum(sizes.values()):
            break
        taken.append(item[-1])
    text = {r[0]: r[1] for r in rows}
    return [(d, text[d]) for d in taken]


def test_pipeline_equals_direct_version(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rows = list({r[0]: r for r in documents(seed=2, n=90) if r[0] is not None}.values())
    trusted = {r[0] for r in rows if r[0] % 3 == 0}
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in trusted] + [(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = [kept_by_quality(rows, trusted)]
    for stage in (one_of_group, cut, mixed):
        stages.append(stage(stages[-1]))
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary_path())
    want = []
    for d, t in stages[-1]:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(rows) > len(stages[0]) > len(stages[1]) and any(a[1] != b[1] for a, b in zip(stages[1], stages[2]))


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        if name != "bpe":
            assert out.columns == empty.columns


def test_every_stage_alone_with_odd_rows(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows and columns with clashing names."""
    from pyspark.sql import functions as F

    clash = ("kept", "tag", "times", "uid", "spans", "fp", "h", "doc", "size", "key")
    rows = documents(seed=3, n=40)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in clash})
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:9]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counted = lambda df: sorted(repr((r["doc_id"], r["text"])) for r in df.collect())
    given = counted(docs)
    out = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    for name in ("quality", "near_dedup", "suffix_dedup", "mix"):
        assert out[name].columns == docs.columns and all(r[c] == c for r in out[name].limit(5).collect() for c in clash)
    kept = counted(out["quality"])
    assert set(kept) <= set(given) and not any(r["text"] is None or not r["text"].strip() for r in out["quality"].collect())
    assert all(kept.count(x) == given.count(x) for x in set(kept))
    one = counted(out["near_dedup"])
    assert set(one) <= set(given) and len(set(one)) == len(one) and len(one) == len({c for _, _, c in brute.components([(r[0], r[1]) for r in rows])})
    assert out["suffix_dedup"].count() == len(rows)
    mix = counted(out["mix"])
    assert set(mix) <= set(given) and all(mix.count(x) <= 3 * given.count(x) for x in set(mix)) and mix
    assert out["bpe"].count() == len(rows)


def test_run_sweeps_up(spark, tmp_path):
    import os

    rows = documents(seed=5, n=30)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:9]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from grafloom.llm import common

    before = common.folders_made()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = [p for p in common._made[before:] if os.path.exists(p.removeprefix("file://"))]
    assert len(left) <= 2
