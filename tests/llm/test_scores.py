"""Rules, classifier, URL filter, fingerprints, mixing and packing."""

from __future__ import annotations

import collections
import fnmatch
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from wakeline.llm import classifier, fingerprints, mixing, packing, quality_rules, url_filter
from wakeline.llm.queries import SITE_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_measurements(docs, nothing):
    want = collections.Counter()
    for r in odd_rows():
        text = r[1] or ""
        w, at = WORD.findall(text), {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[(r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))] += 1
    assert collections.Counter(tuple(r[:6]) for r in quality_rules.measure(docs).collect()) == want
    assert quality_rules.ledger(nothing).count() == 0


def test_policies_and_ablations(docs):
    book = quality_rules.ledger(docs).select("failed", quality_rules.passes("v1").alias("v1"), quality_rules.passes("v2").alias("v2")).collect()
    assert all(r["v1"] or not r["v2"] for r in book)  # v2 rejects all that v1 does
    found = {r["rule"]: r for r in quality_rules.ablations(quality_rules.ledger(docs), "v2").collect()}
    whole = quality_rules.mask("v2")
    for rule, bit in quality_rules.BIT.items():
        assert found[rule]["n_failed"] == sum(bool(r["failed"] & bit) for r in book)
        assert found[rule]["n_kept_without"] == sum(not r["failed"] & whole & ~bit for r in book)


def test_classifier_fits_one_row_an_id(spark, monkeypatch):
    """A labelled id that comes back very often sends no more rows to the driver than any other."""
    seen = []
    monkeypatch.setattr(classifier, "isotonic", lambda score, label, own=classifier.isotonic: seen.append(len(score)) or own(score, label))
    rows = [(i, f"text number {i} and more.") for i in range(40)] + [(7, f"again {k}") for k in range(500)]
    classifier.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"), F.lit(True), max_rows=100)
    assert seen == [40]


def test_classifier_learns_and_is_calibrated(spark, nothing):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "sea", "was", "calm", "and", "grey"], rng.integers(20, 60))) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "###", "NOW!!", "$$$"], rng.integers(20, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(5000, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r["score"] for r in classifier.score(docs, model).collect()}
    held = [i for i in range(300) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i in held]) > 0.95
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    blank = classifier.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in classifier.score(docs, blank).collect()} == {0.5}
    assert classifier.score(nothing, model).count() == 0


def test_fit_equals_a_direct_solution(spark):
    """Means, scales, Fourier features, ridge and calibration against numpy on the whole matrix; rows score alike by any path."""
    rng = np.random.default_rng(5)
    words = ["the", "sea", "was", "calm", "BUY!!", "###", "grey", "12", "Ünï"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 80))) + "\n" * int(rng.integers(0, 3)) for _ in range(240)]
    label = np.array([int(t.count("BUY") * 9 < len(t.split())) for t in texts])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(label)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, F.lit(True), features=32)
    x = np.array([classifier.text_statistics(t.encode()) for t in texts])
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, scale)
    z = np.column_stack([np.sqrt(2 / 32) * np.cos((x - x.mean(axis=0)) / scale @ model.weights + model.phases), np.ones(len(x))])
    ridge = classifier.RIDGE * len(x) / 33 * np.eye(33)
    solve = lambda some: np.linalg.solve(z[some].T @ z[some] + ridge, z[some].T @ label[some])
    assert np.allclose(model.beta, solve(np.full(len(x), True)), atol=1e-6)
    fold = np.array([r["f"] for r in docs.orderBy("doc_id").select(F.pmod(F.xxhash64("doc_id", F.lit(classifier.SEED + 1)), F.lit(2)).alias("f")).collect()])
    cross = np.where(fold == 0, z @ solve(fold == 1), z @ solve(fold == 0))
    steps, levels = classifier.isotonic(cross, label)
    want = np.clip(np.interp(z @ model.beta, steps, levels), 0, 1)
    got = {r["doc_id"]: r["score"] for r in classifier.score(docs, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-4)
    again = {r["_row"]["doc_id"]: r["score"] for r in classifier.scored_rows(docs, model).collect()}
    assert again == got


def test_scores_of_odd_rows(docs, nothing, spark):
    """Every row gets a score: repeated ones, nulls, empty and long texts, with clashing columns beside."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, F.lit(True))
    got = collections.defaultdict(set)
    rows = classifier.scored_rows(docs, model).collect()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["_row"]["a"] == 1
        got[r["_row"]["text"] or ""].add(r["score"])
    assert len(rows) == docs.count() == classifier.score(docs, model).count() and all(len(s) == 1 for s in got.values())
    assert classifier.scored_rows(nothing, model).count() == 0


def test_a_score_does_not_depend_on_the_rows_beside():
    """Each row alone, in any slice and at any place scores to the last bit what it scores among all."""
    rng = np.random.default_rng(3)
    k, wide = len(classifier.STATISTICS), 256
    model = classifier.Model(rng.normal(size=k), rng.uniform(0.5, 2, k), rng.normal(size=(k, wide)), rng.uniform(0, 6, wide), rng.normal(size=wide + 1), np.array([-40.0, 40.0]), np.array([0.0, 1.0]))
    x = rng.normal(size=(97, k))
    whole = model.score(x)
    assert len(set(whole.tolist())) == 97
    for size in (1, 2, 3, 5, 8, 31, 64):
        for first in (0, 1, 2):
            assert np.concatenate([model.score(x[i : i + size]) for i in range(first, len(x), size)]).tolist() == whole[first:].tolist(), (size, first)


def test_isotonic_is_the_best_monotone_fit():
    steps, levels = classifier.isotonic(np.array([1.0, 2, 3, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(levels) > 0).all() and (np.diff(steps) > 0).all()
    assert levels.tolist() == pytest.approx([0, 1 / 3, 1])


def test_automaton_equals_glob_matching():
    globs = ["a*c", "*b?d*", "abc", "*", "??", "*x*y*z", "a" * 70 + "*", "*" + "b" * 66, "a**c"]
    rules = tuple(url_filter.Rule(g, g, "block") for g in globs if g.strip("*"))
    texts = ["abc", "ac", "xaybzd", "bxd", "", "ab", "a" * 70, "a" * 71 + "q", "z" + "b" * 66, "xyz", "x1y2z", "zyx", "b" * 200]
    got = url_filter.GlobAutomaton(rules).matches([t.encode() for t in texts], most_cells=64)
    want = [[fnmatch.fnmatchcase(t, r.glob) for r in rules] for t in texts]
    assert got.tolist() == want
    with pytest.raises(ValueError):
        url_filter.GlobAutomaton((url_filter.Rule("all", "*", "block"),))


def test_site_rules(spark):
    cases = {
        "https://www.example.com/en/1": ("www.example.com/en/", "allow"), "http://m.EXAMPLE.com/en/1?x=/es/": ("example.com/en/", "block"), "http://example.com/de": ("com/", "allow"), "http://com/": ("com/", "allow"),
        "http://a.net/fr/": ("net/fr/", "block"), "http://a.net/x.net/es/": (None, "allow"), "http://badexample.com/en/": ("com/", "allow"), "http://example.com": (None, "allow"), "no scheme": (None, "allow"), "": (None, "allow"),
        "http://casino.org/": (None, "block"), "http://a.org/f.zip#top": (None, "block"), "http://a.org/" + "q/" * 40_000 + "cart/x": (None, "block"), "http://é.com/ü": ("com/", "allow"), "x://y://com/": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(cases)] + [(99, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, SITE_RULES).collect()}
    assert got == dict(enumerate(cases.values())) | {99: (None, "allow")}
    assert url_filter.judge(pages.limit(0), SITE_RULES).count() == 0


def test_edited_texts(docs, nothing):
    rows = sorted(((-(2**63) if r[0] is None else r[0], r[1] or "") for r in odd_rows()), key=lambda r: (-r[0], r[1]))
    want = collections.Counter()
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want[(i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    for ranges in (2, 7, 40):
        got = fingerprints.edited(docs, ranges).collect()
        assert collections.Counter((-(2**63) if r[0] is None else r[0], r["n_chars"], r["edited_sha256"]) for r in got) == want
    marks = collections.defaultdict(set)
    texts = dict(rows)
    for r in got:
        marks[texts[-(2**63) if r[0] is None else r[0]]].add(r["fingerprint"])
    assert all(len(m) == 1 for m in marks.values()) and len({*map(frozenset, marks.values())}) == len(marks)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert np.mean([r["near_edited"] for r in got if r["n_chars"] > 200]) > 0.4
    assert fingerprints.edited(nothing).count() == 0


def slow_fingerprint(text):
    """From the definition, by Python's integers."""
    points = [ord(c) + 1 for c in text]

    def spans(n):
        for i in range(len(points) - n + 1):
            parts = [sum(c * pow(b, j, p) for j, c in enumerate(points[i : i + n])) % p for b, p in zip(fingerprints.BASES, fingerprints.MODULI, strict=True)]
            yield parts[0] << 31 | parts[1]

    def mixed(h):
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
        return h ^ h >> 31

    whole = next(spans(len(points)))
    sketch = sorted({mixed(h) for h in spans(min(8, len(points)))})[:64] if points else []
    return f"{whole:016x}{len(points):08x}" + "".join(f"{h:016x}" for h in sketch)


def span_set(text):
    return {text[i : i + 8] for i in range(max(len(text) - 7, 1))} if text else set()


def test_fingerprints_and_likeness_equal_brute_force(docs):
    """Fingerprints by definition; likeness by whole span sets, exact while they fit the sketch; common prefixes by comparing texts."""
    rows = sorted(((-(2**63) if r[0] is None else r[0], r[1] or "") for r in odd_rows()), key=lambda r: (-r[0], r[1]))
    got = {(-(2**63) if r[0] is None else r[0], r["edited_sha256"]): r for r in fingerprints.edited(docs, 5).collect()}
    exact = off = 0
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        new = t[: len(t) - half] + after[:half]
        r = got[i, hashlib.sha256(new.encode()).hexdigest()]
        if len(t) < 5000:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (slow_fingerprint(t), slow_fingerprint(new))
        for near, other in ((r["near_edited"], new), (r["near_next"], after)):
            a, b = span_set(t), span_set(other)
            dice = 1.0 if t == other else 2 * len(a & b) / max(len(a) + len(b), 1)
            if len(a | b) <= fingerprints.SKETCH:
                assert near == pytest.approx(dice)
                exact += 1
            else:
                assert abs(near - dice) < 0.25
                off += abs(near - dice)
        if len({x for x in rows if x[0] == i}) == 1:
            assert r["common_prefix_next"] == next((n for n, (x, y) in enumerate(zip(t, after, strict=False)) if x != y), min(len(t), len(after)))
    assert exact > 10 and off / (2 * len(rows) - exact) < 0.06


def test_prefix_hashes_answer_spans():
    text = "abracadabra abracadabra é"
    h = fingerprints.PrefixHash(fingerprints.code_points(text))
    for n in (1, 3, 7):
        for i in range(len(text) - n):
            for j in range(len(text) - n):
                assert (h.span(i, n) == h.span(j, n)) == (text[i : i + n] == text[j : j + n])
    assert h.extension(0, h, 12) == 12 and h.extension(0, h, 7) == 4 and h.extension(0, h, len(text)) == 0


def test_mixing_meets_targets(docs, nothing):
    rows = odd_rows()
    size = lambda t: len(WORD.findall(t or ""))
    totals = collections.Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(totals.values()))
    while True:  # share, cap, share the excess again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * totals[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == totals[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in order)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan(docs.repartition(7)).collect()), key=repr)
    assert mixing.plan(nothing).count() == 0


def words_given(mixed):
    words = collections.Counter()
    for r in mixed.select("doc_id", "text").collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    return words


def words_planned(plan):
    words = collections.Counter()
    for r in plan.collect():
        words[r["doc_id"]] += r["taken"]
    return words


def test_mixing_gives_what_it_plans_row_by_row(spark, docs, nothing):
    """Also for repeated rows, other texts under a known doc_id and null ids."""
    for some in (docs, docs.unionByName(docs).unionByName(docs), docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 4)))):
        mixed = mixing.mix(some)
        assert mixed.columns == docs.columns
        given, planned = words_given(mixed), words_planned(mixing.plan(some))
        assert {k: n for k, n in given.items() if n} == {k: n for k, n in planned.items() if n}
        assert mixed.filter("_n <> 1 or size <> 1").count() == 0
    assert mixing.mix(nothing).count() == 0
    whole = spark.createDataFrame([(i, "w " * (5 + i % 9), "en", "ab"[i % 2], 0) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = mixing.mix(whole).filter("n_chars <> 0")
    assert 1 <= cut.count() <= 2 and cut.filter("n_chars <> length(text)").count() == 0


def test_ranges_stay_even_for_low_weights(spark):
    """A tenth of the rows of one source is full of symbols."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a # $ % b").otherwise("a b c d e").alias("text"), F.lit("s").alias("source"))
    small = mixing._keyed(docs, 17)
    goal = mixing._goals(small, (1, 2, 3), 3)
    held = [r["count"] for r in mixing._ranged(small, goal).groupBy("span").count().collect()]
    assert len(held) == 20 and max(held) < 1.6 * mixing.ROWS_PER_RANGE


def test_packing_round_trip(docs, nothing):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    copies = collections.Counter(r[0] for r in odd_rows())
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) <= 1024 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda p: p[0])
        assert len(own) == copies[i] * -(-len(ids) // 1024)
        assert [t for p in own[:: copies[i]] for t in p[2]] == ids
        assert all(len(p[2]) == 1024 for p in own if p[0] > 0)
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= 1024
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> x", "a  b\n\n  c\t", "naïve — “quotes” 東京 🙂🙂", " " * 50, "don't we'll I'd", "1234567890" * 30, "\u00a0\u2003\u200b", "a" * 3000])
def test_ids_equal_the_json_vocabulary(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode(text, allowed_special="all") == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_token_in_a_text(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|> x", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\n<|endoftext|", "x  <|endoftext|>  y", "<|ENDOFTEXT|>"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


@pytest.mark.parametrize("parts", [1, 32, 211])
def test_few_sequences_however_many_partitions(spark, parts):
    """At most three hundredths more than the tokens need."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 1500, 3000))], "doc_id long, text string").repartition(parts)
    got = packing.pack(docs, with_ids=False).agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("n")).first()
    assert got["n"] <= 1.03 * np.ceil(got["tokens"] / 1024)


def test_best_fit_takes_the_fullest_bin():
    bins = packing.BestFit(10, open_bins=2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [bins.place(n) for n in (5, 6, 8)] == [(2, 0), (3, 0), (4, 0)]
    assert bins.place(5) == (2, 5)  # bin 3 was fuller and closed
    assert bins.place(10)[1] == 0 and bins.n_open <= 2
