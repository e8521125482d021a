"""Suffix-array, substring and line deduplication against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import odd_rows
from wakeline.llm import anchored, line_dedup, substring_dedup, suffix_dedup
from wakeline.llm.linear_grouping import suffix_arrays
from wakeline.llm.sorting import grouped_order, packed_order


def least_ids(rows):
    return [(-(2**63) if r[0] is None else r[0], r[1] or "") for r in rows]


def brute_bytes(rows):
    least = {}
    for i, t in least_ids(rows):
        raw = t.encode()
        for k in range(len(raw) - 49):
            least[raw[k : k + 50]] = min(i, least.get(raw[k : k + 50], i))
    out = []
    for i, t in least_ids(rows):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows):
    split = [(i, t.encode().split()) for i, t in least_ids(rows)]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-(2**63) if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_suffix_dedup(docs, nothing):
    assert result(suffix_dedup.deduplicated(docs)) == brute_bytes(odd_rows())
    assert suffix_dedup.deduplicated(nothing).count() == 0
    assert b"".join(r["kept"] or b"" for r in suffix_dedup.deduplicated(docs, with_text=True).filter("doc_id = 5").collect()).decode() == odd_rows()[5][1]


def test_substring_dedup(docs, nothing):
    assert result(substring_dedup.deduplicated(docs)) == brute_words(odd_rows())
    assert substring_dedup.deduplicated(nothing).count() == 0
    assert substring_dedup.lengths() == [1, 2, 4, 8, 16, 32, 35]


def test_long_texts_are_cut_into_overlapping_slices(docs, monkeypatch):
    """With small slices, pieces of one text meet again; here in-process, as workers would see it."""
    monkeypatch.setattr(anchored, "SLICE", 300)
    raws = [(r[1] or "").encode() for r in odd_rows()[:30]]
    for kind in (suffix_dedup.KIND, substring_dedup.KIND):
        whole, pieces = collections.Counter(), collections.Counter()
        for i, raw in enumerate(raws):
            symbols = kind.symbols(raw)
            f = anchored.cut(kind.values([symbols]), np.array([0, len(symbols)]), kind)
            whole.update((i, w) for a, b in zip(f.first.tolist(), f.last.tolist(), strict=True) for w in range(a, b + 1))
        for ids, parts, bounds, starts in anchored.slices(raws, kind):
            f = anchored.cut(kind.values(parts), bounds, kind)
            pieces.update((int(ids[t]), w - int(bounds[t]) + int(starts[t])) for a, b, t in zip(f.first.tolist(), f.last.tolist(), f.text.tolist(), strict=True) for w in range(a, b + 1))
        assert whole == pieces and set(whole.values()) <= {1}


@pytest.mark.parametrize("seed", range(3))
def test_suffix_arrays_equal_sorting(seed):
    rng = np.random.default_rng(seed)
    strings = [rng.integers(1, rng.integers(2, 6), rng.integers(0, 50)) for _ in range(60)] + [np.ones(80, int), np.tile([1, 2], 40), np.arange(1, 60), np.arange(60, 0, -1)]
    flat, lengths = np.concatenate([np.append(s, 0) for s in strings]), np.array([len(s) + 1 for s in strings])
    found, at = suffix_arrays(flat, lengths), 0
    for s, n in zip(strings, lengths.tolist(), strict=True):
        text = [*s.tolist(), 0]
        assert (found[at : at + n] - at).tolist() == sorted(range(n), key=lambda i: text[i:])  # noqa: B023
        at += n
    assert len(suffix_arrays(np.zeros(0), np.zeros(0, int))) == 0


def passages(bodies, docs, places, windows, times=None):
    n = len(bodies)
    return anchored.Passages(np.array(places, np.uint64), np.array(docs), np.ones(n, np.int64) if times is None else np.array(times), np.array(windows), bodies)


@pytest.mark.parametrize("large", [1 << 16, 200])
def test_suffix_arrays_decide_as_comparing_all(monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)  # beyond it passages are cut by anchors again
    rng = random.Random(3)
    shared = [bytes(rng.choices(b"abcd", k=60)) for _ in range(3)]
    bodies = [bytes(rng.choices(b"ab", k=rng.randint(0, 30))) + rng.choice(shared) + bytes(rng.choices(b"ab", k=rng.randint(0, 30))) for _ in range(120)]
    bodies[60:75] = [bodies[3]] * 15  # equal pieces of many documents, of one twice
    some = passages(bodies, [i % 50 for i in range(120)], [i % 7 for i in range(120)], [len(b) - 49 for b in bodies])
    some.place[60:75], some.doc[70] = some.place[3], some.doc[3]
    want = {
        (i, k) for i in range(120) for k in range(len(bodies[i]) - 49)
        if any(some.doc[j] < some.doc[i] and some.place[i] == some.place[j] and bodies[i][k : k + 50] in bodies[j] for j in range(120))
    }
    got = {(int(i), int(w)) for at, first, last in suffix_dedup.decide(some) for i, a, b in zip(at, first, last, strict=True) for w in range(a, b + 1)}
    assert want and got == want
    assert not list(suffix_dedup.decide(passages([], [], [], [])))


def test_parts_of_a_large_place_meet(monkeypatch):
    """Passages of one place are compared although they are cut in different parts."""
    monkeypatch.setattr(suffix_dedup, "LARGE", 500)
    for name in ("BATCH", "PART"):  # bytes sorted and cut together
        monkeypatch.setattr(suffix_dedup, name, 400, raising=False)
    rng = random.Random(5)
    shared = bytes(rng.choices(b"abcd", k=60))
    bodies = [bytes(rng.choices(b"ab", k=200)) + shared + bytes(rng.choices(b"cd", k=200)) for _ in range(12)]
    some = passages(bodies, list(range(12)), [3] * 12, [len(b) - 49 for b in bodies])
    got = {(int(i), int(w)) for at, first, last in suffix_dedup.decide(some) for i, a, b in zip(at, first, last, strict=True) for w in range(a, b + 1)}
    assert {(i, k) for i in range(1, 12) for k in range(200, 211)} <= got


@pytest.mark.parametrize("wide", [1, 1 << 40, 1 << 62])
def test_packed_orders_equal_lexsort(wide):
    """Also where keys don't fit one number, or agree in their upper bits."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 3000), rng.integers(0, 7, 3000) * wide // 7
    for keys in ((a, b), (b, a), (b - 3, a), (a[:0], b[:0])):
        assert packed_order(*keys).tolist() == np.lexsort(keys[::-1]).tolist()
    close = (b + a).astype(np.uint64)
    for key in (close, close[:0], close + np.uint64(1 << 63)):
        assert grouped_order(key).tolist() == np.argsort(key, kind="stable").tolist()


def test_places_are_found_by_document_and_anchor():
    """Whether documents and anchors fit one number or not, and for anchors that only other documents have."""
    rng = np.random.default_rng(2)
    for n in (50, 70_000):
        doc, key = rng.permutation(np.arange(-n, n, 2)), rng.integers(0, 9, n).astype(np.uint64)
        places = anchored.Asked(doc, key, np.arange(n, dtype=np.uint64))
        assert places.exact == (n < 1 << 16)
        assert places.those(np.arange(-n - 3, n + 3)).tolist() == list(range(3, 2 * n + 3, 2))
        asked = np.repeat(doc, 2)
        found, at = places.find(asked, np.column_stack([key, key + np.uint64(9)]).ravel())
        assert found.tolist() == list(range(0, 2 * n, 2)) and at.tolist() == list(range(n))


def test_slices_fit_a_core_s_cache():
    """The time of hashing doubles where a slice's arrays of 64-bit hashes don't fit; what is sent together stays large."""
    assert 8 * anchored.SLICE <= 1 << 20 < anchored.CHUNK


def test_levels_decide_as_comparing_all():
    rng = random.Random(4)
    shared = [[rng.choice([b"a", b"b", b"c"]) for _ in range(40)] for _ in range(3)]
    lists = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 9))] + rng.choice(shared) + [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 9))] for _ in range(60)]
    times = [2 if i == 5 else 1 for i in range(60)]
    some = passages([b" ".join(x) for x in lists], list(range(60)), [i % 9 for i in range(60)], [len(x) - 34 for x in lists], times)
    seen = collections.Counter()
    for i, x in enumerate(lists):
        for k in range(len(x) - 34):
            seen[i % 9, tuple(x[k : k + 35])] += times[i]
    want = {(i, k) for i, x in enumerate(lists) for k in range(len(x) - 34) if seen[i % 9, tuple(x[k : k + 35])] > 1}
    got = {(int(i), int(w)) for at, first, last in substring_dedup.decide(some) for i, a, b in zip(at, first, last, strict=True) for w in range(a, b + 1)}
    assert want and got == want
    assert not list(substring_dedup.decide(passages([], [], [], [])))


@pytest.fixture
def hot_rows():
    """A line between different texts in very many documents, a passage in many, and copies: more than ``FEW`` of each."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, passage, copy = some(70), some(400), " ".join(some(5).replace(" ", "x") for _ in range(90))
    rows = [(i, some(90) + line + some(90)) for i in range(150)] + [(200 + i, some(9) + passage + some(9)) for i in range(100)] + [(400 + i, copy) for i in range(90)]
    words = " ".join(f"w{i}" for i in range(40))
    rows += [(600 + i, f"{i} {i + 1} {words} {i + 2} {' '.join(f'v{i}-{k}' for k in range(40))}") for i in range(90)]
    rng.shuffle(rows)
    return [*rows, rows[0], (rows[1][0], rows[2][1])]


def test_hot_anchors_lose_nothing(spark, hot_rows):
    df = spark.createDataFrame(hot_rows, "doc_id long, text string").repartition(5)
    assert result(suffix_dedup.deduplicated(df)) == brute_bytes(hot_rows)
    assert result(substring_dedup.deduplicated(df)) == brute_words(hot_rows)


def brute_chunks(text):
    lines, out, now = (text or "").split("\n"), [], []
    hashes = [0, 0] + [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    even = [(hashes[i + 2] + 69_069 * hashes[i + 1] + 69_069**2 % (2**31 - 1) * hashes[i]) % (2**31 - 1) % 3 == 0 for i in range(len(lines))]
    for i, line in enumerate(lines):
        now.append(line)
        if i == len(lines) - 1 or 0 < i < len(lines) - 2 and even[i] and not even[i - 1]:
            out.append(now)
            now = []
    assert len(lines) < 2 or min(map(len, out)) > 1
    return out


def test_line_dedup(docs, nothing):
    rows = [r for r in odd_rows()]
    firsts, want = {}, collections.Counter()
    for i, t in sorted(set(least_ids(rows))):
        for k, c in enumerate(brute_chunks(t)):
            firsts.setdefault("\n".join(c), (i, k))
    for i, t in least_ids(rows):
        chunks = brute_chunks(t)
        gone = [len(c) > 1 and bool("".join(c).strip(" \t\r\x0b\x0c")) and firsts["\n".join(c)] != (i, k) for k, c in enumerate(chunks)]
        kept = "\n".join("\n".join(c) for c, g in zip(chunks, gone, strict=True) if not g)
        want[(i, sum(map(len, chunks)), len(chunks), sum(gone), sum(len(c) for c, g in zip(chunks, gone, strict=True) if g), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert collections.Counter(result(line_dedup.report(docs))) == want
    assert line_dedup.report(nothing).count() == 0
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert out.filter("a <> 1 or _gone <> 1").count() == 0
    assert out.filter("n_chars <> length(text)").count() == docs.filter("n_chars <> length(text)").count()


def test_line_dedup_survives_insertions(spark):
    rng = random.Random(5)
    lines = [f"line {rng.random()}" for _ in range(60)]
    shifted = ["new first line", *lines[:30], "another", *lines[30:]]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(shifted))], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_lines_removed"] for r in line_dedup.report(df).collect()}
    assert removed[1] == 0 and removed[2] >= 40


def test_a_text_of_very_many_chunks(spark):
    """Chunks that go are looked up in one step each: a log of 10^5 lines, twice, takes seconds."""
    log = "\n".join(f"line {k * 7919 % 100_003} of the log" for k in range(100_000))
    docs = spark.createDataFrame([(1, log), (2, log + "\nand one more"), (3, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.report(docs).collect()}
    assert got[1]["n_chunks_removed"] == 0 and got[1]["n_chunks"] > 10_000
    assert got[2]["n_chunks_removed"] >= got[1]["n_chunks"] - 1 and got[2]["n_lines"] == 100_001
