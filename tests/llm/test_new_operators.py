"""SentencePiece coding, centroid clustering and lexical search against the library, plain loops and SQL."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows, prose
from wakeline.llm import clustering, lexical_search, pieces
from wakeline.llm.oracles import ORACLE_SQL

P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(P.path("piece_bpe_32k.model"))


def hostile(library):
    """Texts that are hard on merge order: pieces side by side, runs, few letters, several scripts, controls, long words."""
    rng = random.Random(4)
    own = [library.id_to_piece(i) for i in range(259, 32000)]
    out = ["", " ", "  ", "▁", "x ", " x", "\n", "\x00", "😀é́", "a" * 5000, " " * 3000 + "a", "ab" * 2000, "esh" * 900, "o" * 147, "-" * 999, "漢字" * 700]
    for k in range(400):
        some = rng.sample(own, rng.randint(1, 6))
        out.append("".join(rng.choice(some).replace("▁", " " if k % 3 else "") for _ in range(rng.randint(1, 300))))
    for alphabet in ("abc ", "  \t\n", "é€漢한😀a", "▁ ab", "-=*/#0 12", "etaoin"):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    return out + [" " * n + t for n in range(40) for t in ("", "a", "the", "\n", "é")]


def test_encoding_equals_the_library(library, vocabulary, monkeypatch):
    texts = hostile(library)
    assert [x.tolist() for x in vocabulary.encode(texts)] == library.encode(texts)
    monkeypatch.setattr(pieces, "PART", 97)  # cut between words
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    assert [x.tolist() for x in vocabulary.encode(texts)] == library.encode(texts)


def test_decoding_equals_the_library(library, vocabulary):
    rng = random.Random(5)
    lists = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    lists += [[], [0], [1, 2], [1, 300], [259], [259, 259], [31, 259], [195, 172], [235, 171]]
    for ids in lists:
        assert vocabulary.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_coded_documents(spark, docs, nothing, library):
    want = collections.Counter()
    for r in odd_rows():
        ids = library.encode(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, pieces.coded(docs, columns=pieces.DIGESTS).collect())) == want
    whole = pieces.coded(docs)
    assert all(r["ids"] == library.encode(r["decoded"]) for r in whole.collect() if r["decoded"])
    assert collections.Counter(map(tuple, pieces.decoded(whole).collect())) == collections.Counter((r["doc_id"], r["decoded"]) for r in whole.collect())
    assert pieces.coded(nothing).count() == 0


def plain_rounds(vectors, k=8, rounds=10):
    usable = [(i, [math.floor(1024 * x) for x in e]) for i, e in vectors if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in usable)[:k]
    centroids = [list(x) for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _i, x in usable:
            groups[nearest(x)[1]].append(x)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *nearest(x)[::-1]) for i, x in usable]
    inertia = collections.Counter()
    for _i, j, d in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, j, d, inertia[j], inertia.total(), digest[j]) for i, j, d in found)


def test_clustering(spark):
    rng = random.Random(6)
    vectors = [(i, [rng.gauss(i % 5, 0.2) for _ in range(64)]) for i in range(150)]
    vectors += [(200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [float("nan")]), (203, [float("inf")] * 64), (204, [None] * 64), (None, [0.5] * 64), vectors[3], vectors[3], (205, [])]
    shape = "vec_id long, embedding array<double>"
    table = spark.createDataFrame(vectors, shape).withColumns({c: F.lit(1) for c in ("x", "n", "grp", "m", "cluster")}).repartition(3)
    assert collections.Counter(map(tuple, clustering.clustered(table, group=16).collect())) == plain_rounds(vectors)
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (3, [1.0] * 64)]  # fewer than k, and a cluster that stays empty
    assert collections.Counter(map(tuple, clustering.clustered(spark.createDataFrame(few, shape), width=24).collect())) == plain_rounds(few)
    assert clustering.clustered(spark.createDataFrame([], shape)).count() == 0


def plain_search(docs, items, most=20):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [x.translate(low) for x in re.findall(lexical_search.TERM, t or "")]
    held = [(i, collections.Counter(split(t))) for i, t in docs if split(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            scores.append((-s, -(2**63) if i is None else i, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:most]) if s < 0]
    return collections.Counter(out)


def test_search(spark, docs, nothing):
    rng = random.Random(7)
    texts = [(r[0], r[1]) for r in odd_rows()]
    items = [(k, prose(rng, 12)) for k in range(8)] + [(90, texts[1][1]), (91, "é " * 3 + "ÜNÏ Ünï nothing-Here"), (92, None), (93, "?!"), (94, "x x X"), (95, texts[-4][1]), (95, "ba be")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0))
    for shard_bytes in (lexical_search.SHARD, 400):
        of = lexical_search.statistics(docs)
        found = lexical_search.search(lexical_search.written(lexical_search.index(docs, of, shard_bytes), "test"), of, asked)
        assert collections.Counter(map(tuple, found.collect())) == plain_search(texts, items)
    assert lexical_search.ranked(nothing, asked).count() == 0
    assert lexical_search.ranked(docs, asked.limit(0)).count() == 0


def test_search_prunes(spark):
    """Lists that are not essential are not decompressed as a whole, and the result is the same."""
    rng = random.Random(8)
    of = lexical_search.Statistics(4000, 40_000)
    shard = lexical_search._Shard()
    raws = [("common " * rng.randint(1, 3) + ("usual " if k % 2 else "") + " ".join(f"w{rng.randrange(900)}" for _ in range(7))).encode() for k in range(4000)]
    for k, raw in enumerate(raws):
        shard.add(k, raw)
    rows = {r["term"]: r for r in shard.batch(0, of).to_pylist()}
    m, ids = (np.frombuffer(rows[""][c], "<i8") for c in ("m", "ids"))
    lists = {t: lexical_search._Postings(*(np.array(rows[t][c]) for c in ("last", "best", "at")), rows[t]["postings"], m) for t in ("common", "usual", "w5", "w6")}
    item = [(lexical_search.weight(4000, rows[t]["df"]), lists[t]) for t in lists]
    heap = lexical_search._Heap(20)
    lexical_search.ask(item, ids, heap)
    again = lexical_search._Heap(20)
    again.add(heap.scores, ids=heap.ids + 10_000)  # a goal from another shard
    for p in lists.values():
        p._whole, p._blocks = None, {}
    lexical_search.ask(item, ids, again)
    assert lists["common"]._whole is None and len(lists["common"]._blocks) < len(lists["common"].last)
    assert sorted(zip((-again.scores).tolist(), again.ids.tolist())) == sorted(sorted([*zip((-heap.scores).tolist(), heap.ids.tolist()), *zip((-heap.scores).tolist(), (heap.ids + 10_000).tolist())])[:20])


def test_search_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = con.sql(ORACLE_SQL["op13_lexical_search"]).fetchall()
    found = lexical_search.ranked(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
