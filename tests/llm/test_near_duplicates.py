"""SimHash, vantage-point shards, components and the pipeline."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, odd_rows, prose
from wakeline.llm import common, near_sets, simhash
from wakeline.llm.components import components, local_forest


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_near_duplicates_equal_brute_force(spark, docs, nothing):
    rng = random.Random(2)
    long = prose(rng, 600).split()
    near = []
    for k in range(12):
        w = list(long)
        w[rng.randrange(len(w))] = f"new{k}"
        near.append((100 + k, " ".join(w), "en", "a", 0))
    rows = odd_rows() + near
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(near, SCHEMA))
    ids = [-1 if r[0] is None else r[0] for r in rows]
    fps = [slow_fingerprint(r[1]) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: ids[i])
    at = roots(len(rows), [(x, y) for x in range(len(rows)) for y in range(x) if (fps[order[x]] ^ fps[order[y]]).bit_count() <= 4 or ids[order[x]] == ids[order[y]] and fps[order[x]] == fps[order[y]]])
    want = sorted((ids[order[x]], f"{fps[order[x]]:016x}", ids[order[at[x]]]) for x in range(len(rows)))
    got = simhash.near_duplicates(df).select(F.coalesce("doc_id", F.lit(-1)), simhash.hex_fingerprint(), F.coalesce("component_id", F.lit(-1)))
    assert sorted(map(tuple, got.collect())) == want
    assert len({w[2] for w in want if w[0] >= 100}) < 6  # near copies do fall together
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_shards_find_every_link(depth):
    rng = np.random.default_rng(depth)
    fp = rng.integers(0, 2**64 - 1, 1500, dtype=np.uint64)
    close = fp[rng.integers(0, 60, 900)].copy()
    for i in range(len(close)):
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            close[i] ^= np.uint64(1 << int(b))
    ball = np.full(900, fp[0])  # dense: no vantage point parts it
    for i in range(len(ball)):
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            ball[i] ^= np.uint64(1 << int(b))
    fp = np.unique(np.concatenate([fp, close, ball]))
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4)

    def labels(a, b):
        out = np.arange(len(fp))
        node, low = local_forest(a, b)
        out[node] = low
        return out

    a, b = [], []
    for block in range(3):  # of four parts two are good, so three trees do
        part = simhash._part(fp, block, simhash.BLOCKS)
        lived = np.zeros(len(fp), int)
        for _, at, lives in simhash.route(simhash.build_tree(np.unique(part[:500]), depth, block + 1), part, 1):
            lived[at[lives]] += 1
            u, v = simhash.shard_links(fp[at], lives, block)
            a.append(at[u])
            b.append(at[v])
        assert (lived == 1).all()
    assert (simhash._good_parts(4, 4), simhash._good_parts(7, 4)) == (2, 1)
    assert (labels(np.concatenate(a), np.concatenate(b)) == labels(x[x < y], y[x < y])).all()


def test_a_crowded_part_is_split_by_later_ones():
    """Thousands of fingerprints share their first part: the shard goes on with the others and finds every link."""
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64) & ~np.uint64(0xFFFF)
    near = fp[:1500].copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            near[i] ^= np.uint64(1 << int(b))
    fp = np.unique(np.concatenate([fp, near]))
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4)
    want = {(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if a < b}
    found = set()
    for block in range(3):
        u, v = simhash.shard_links(fp, np.ones(len(fp), bool), block)
        found |= {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist(), strict=True)}
    at = lambda pairs: np.array(sorted(pairs)).T
    nodes, low = local_forest(*at(want))
    nodes2, low2 = local_forest(*at(found))
    assert len(want) > 1000 and nodes.tolist() == nodes2.tolist() and low.tolist() == low2.tolist()


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    want = {}
    at = roots(400, pairs)
    for x, y in pairs:
        if x != y:
            want |= {x: at[x], y: at[y]}
    links = spark.createDataFrame(pairs + [(None, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == want
    assert components(links.limit(0)).count() == 0


def slow_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, text, n):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicate_stage_equals_brute_force(spark):
    """Copies on both sides of Jaccard 0.8, far beyond 6 bits and within them, and short texts."""
    rng = random.Random(5)
    bases = [prose(rng, n) for n in (60, 150, 150, 400, 800)]
    texts = [*bases, *(edited(rng, b, k) for b in bases for k in range(1, len(b.split()) // 20) for _ in range(2))][:200]
    texts += [f"a b c d {w}" for w in "efghij"] + [f"one two three four five {w}" for w in "efghij"] + [prose(rng, 5) for _ in range(40)]
    sets = [slow_set(t) for t in texts]
    linked = [(x, y) for x in range(len(texts)) for y in range(x) if alike(sets[x], sets[y])]
    at = roots(len(texts), linked)
    far = [p for p in linked if (slow_fingerprint(texts[p[0]]) ^ slow_fingerprint(texts[p[1]])).bit_count() > 6]
    assert len(far) > 50
    order = rng.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame([(i, texts[i], "en", "a", 0) for i in order], SCHEMA).repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(at))


def test_documents_of_one_fingerprint_stay_without_common_shingles(spark, monkeypatch):
    """Links of the trees are checked by the sets before a document goes."""
    monkeypatch.setattr(simhash, "links", lambda marks, *a: marks.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy(F.lit(1))).alias("b")))
    docs = spark.createDataFrame([(i, prose(random.Random(i), 5), "en", "a", 0) for i in range(20)], SCHEMA)
    assert corpus_pipeline.near_duplicate_stage(spark, docs, "").count() == 20


def test_buckets_are_compared_until_connected(spark):
    """A chain in one bucket, where each is alike its neighbours only, and a bucket of unlike sets."""
    sets = [(i, list(range(i, i + 10))) for i in range(100, 140)] + [(i, [i]) for i in range(60)]
    df = spark.createDataFrame(sets, "node long, hashes array<long>")
    members = spark.createDataFrame([(1, i, len(h)) for i, h in sets] + [(2, i, 1) for i in range(60)], "bucket long, node long, n int")
    got = near_sets.set_components(members, df, spark.createDataFrame([], "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 100) for i in range(100, 140)}


@pytest.mark.parametrize("block", [512, 7])
def test_crowds_are_compared_by_blocks(spark, monkeypatch, block):
    """Many sets of one bucket, most of them just below 0.8, in small blocks: the components are those of all pairs."""
    monkeypatch.setattr(near_sets, "CROWD", block)
    rng = random.Random(11)
    base = list(range(1000, 1060))
    sets = [(i, sorted(rng.sample(base, rng.choice([44, 48, 51, 54])) + [10_000 + i * 10 + k for k in range(rng.randint(0, 2))])) for i in range(1, 90)]
    sets += [(200 + i, list(range(5000, 5000 + 4 * i))) for i in range(1, 25)]
    linked = [(x, y) for x in range(len(sets)) for y in range(x) if 5 * len({*sets[x][1]} & {*sets[y][1]}) >= 4 * len({*sets[x][1]} | {*sets[y][1]})]
    at = roots(len(sets), linked)
    want = {(sets[i][0], sets[at[i]][0]) for p in linked for i in p}
    assert 20 < len(linked) < 3000
    df = spark.createDataFrame(sets, "node long, hashes array<long>")
    members = spark.createDataFrame([(1, i, len(h)) for i, h in sets] + [(2, i, len(h)) for i, h in sets[::3]], "bucket long, node long, n int")
    got = near_sets.set_components(members, df, spark.createDataFrame([], "a long, b long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == want


def test_a_crowd_of_unlike_sets_makes_few_pairs(spark, monkeypatch):
    """Sets that share a bucket and most of their elements, all below 0.8 but one pair: hardly any pair is made and checked, and the pair is found."""
    seen = []
    monkeypatch.setattr(near_sets, "checked", lambda pairs, sets, alike, own=near_sets.checked: seen.append(pairs.count()) or own(pairs, sets, alike))
    rng = random.Random(12)
    base = [rng.getrandbits(62) for _ in range(60)]
    sets = [(i, sorted(rng.sample(base, 40) + [rng.getrandbits(62) for _ in range(15)])) for i in range(1, 300)]
    sets.append((300, sets[150][1][1:]))
    df = spark.createDataFrame(sets, "node long, hashes array<long>")
    members = spark.createDataFrame([(b, i, len(h)) for i, h in sets for b in (1, 2)], "bucket long, node long, n int")
    got = near_sets.set_components(members, df, spark.createDataFrame([], "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(151, 151), (300, 151)}
    assert sum(seen) < 60


@pytest.mark.parametrize("n", [0, 1, 4, 9, 45, 300, 3000])
def test_signatures_reject_no_alike_pair(spark, n):
    """Sets at and just above 0.8, whatever elements they have, pass; so do sets beyond what the signature tells apart."""
    rng = random.Random(n)
    rows = []
    for k in range(30):
        own = [rng.getrandbits(63) if k % 2 else rng.randrange(10**5) * 512 + rng.randrange(3) for _ in range(n)]
        own = sorted(set(own))
        fresh = [rng.getrandbits(63) for _ in range(len(own) // 9)]
        rows.append((2 * k, own, 2 * k + 1, sorted({*own[len(own) // 9 :], *fresh})))
    both = [(a, b) for _, a, _, b in rows]
    assert all(alike({*a}, {*b}) for a, b in both)
    sig = near_sets.signatures(spark.createDataFrame([(i, h) for r in rows for i, h in (r[:2], r[2:])], "node long, hashes array<long>"))
    pairs = spark.createDataFrame([(r[0], len(r[1]), r[2], len(r[3])) for r in rows], "node long, n int, _node long, _n int")
    pairs = pairs.join(sig, "node").join(sig.toDF("_node", "_sig"), "_node")
    assert pairs.filter(near_sets.may_be_alike()).count() == len(rows)


def test_near_duplicate_stage_with_columns_that_spark_does_not_compare(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", {"k": 1}), (1, "a b c d e f", {"k": 2}), (2, "a b c d e f", None)], "doc_id long, text string, tags map<string,int>")
    docs = docs.withColumn("many", F.array("tags"))
    got = near_sets.deduplicated(docs).collect()
    assert [(r["doc_id"], r["tags"], r["many"]) for r in got] == [(1, {"k": 1}, [{"k": 1}])]


def test_near_duplicate_stage_with_null_and_repeated_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (None, a), (None, edited(rng, a, 1)), (2, a), (3, b), (3, b), (3, c), (4, c), (5, b), (None, d), (None, d), (6, None), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(got, key=repr) in [sorted([(None, k), (3, b), (3, c), (None, d), (6, None)], key=repr) for k in (a, rows[2][1])]
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_a_written_stage_frees_the_shuffle_files_of_what_is_done(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    for _ in range(5):
        spark.range(1000).repartition(64, "id").collect()
    before = files()
    for _ in range(5):  # the last query's plan may still be held when the driver collects
        assert common.written(spark.range(3), "small").count() == 3
        time.sleep(1)  # Spark deletes in the background
    assert files() <= before // 2


def test_pipeline_stages(spark, tmp_path):
    """Each stage on all its predecessor kept; columns stay; the result holds every kept word's tokens."""
    rng = random.Random(9)
    good = [(i, "\n".join(prose(rng, 12) for _ in range(6)) + ".", "en", f"s{i % 3}", 0) for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! ### $$$ " * rng.randint(10, 30), "en", "s0", 0) for i in range(30)]
    words = good[0][1].split(" ")
    copies = [(200 + i, good[0][1], "en", "s1", 0) for i in range(5)] + [(300, " ".join(words[:10] + ["other"] + words[11:]), "en", "s1", 0)]
    odd = [(400, None, "en", None, 0), (401, "", None, "s2", 0)]
    rows = good + bad + copies + odd
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100)) for i in [*range(0, 60), *range(100, 130)]], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        if k < 4:
            assert docs.columns == columns, name
            kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not kept[0] & set(range(100, 130)) and kept[0] >= set(range(60))
    assert kept[2] >= set(range(60)) and not kept[2] & set(range(200, 205))
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    once = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr)


def test_stages_on_odd_rows(spark, docs, nothing, tmp_path):
    """Nulls, repeated rows, empty and very long texts and clashing columns pass every stage; an empty table stays empty."""
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    whole = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r["a"] == 1 and r["a.b"] == 1 and r["_row"] == 1 for r in rows), name
        if name in ("quality_classifier", "simhash_near_dedup"):
            assert {(r["doc_id"], r["text"]) for r in rows} <= whole, name
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
    packed = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).select("doc_id", "piece").collect()
    assert sum(r["piece"] == 0 for r in packed) == docs.count()
    assert corpus_pipeline.packing_stage(spark, nothing, str(tmp_path)).count() == 0
