"""The same work as some headline queries in one plain Python process, to compare ``bench.py`` with: one JSON line with seconds per query.

Naive on purpose: loops over rows, dictionaries instead of joins. Environment: BENCH_SF_DIR.
"""

from __future__ import annotations

import collections
import json
import math
import os
import time

import pyarrow.parquet as pq

EARTH = 6_371_000.0


def metres(a, b) -> float:
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH * math.asin(math.sqrt(min(h, 1.0)))


def tracks(folder: str, walking: bool) -> dict[int, list[tuple]]:
    """Fixes (lon, lat, t, id, speed, course) by vessel, as ``plans.tables`` derives them."""
    columns = ["user_id", "ts", "event_id", "value"]
    rows = sorted(zip(*(pq.read_table(f"{folder}/events.parquet", columns=columns)[c].to_pylist() for c in columns), strict=True))
    out: dict[int, list[tuple]] = collections.defaultdict(list)
    at: dict[int, tuple[int, int]] = {}
    for user, _, event, value in rows:
        seq = len(out[user]) + 1
        if walking:
            x, y = at.get(user, (113_500_000 + user % 10 * 3000, 22_000_000 + user % 7 * 3000))
            x, y = x + event * 7919 % 801 - 400, y + event * 104_729 % 801 - 400
            at[user] = x, y
        else:
            x, y = 113_500_000 + user % 100 * 10_000 + event * 7919 % 1000, 22_000_000 + event * 104_729 % 1000
        out[user].append((x / 1e6, y / 1e6, seq * 60 + seq // 9 * 120, event, round(value * 100) / 4000, event * 37 % 360))
    return out


def tail_segment_low_speed(folder: str) -> int:
    n = 0
    for track in tracks(folder, False).values():
        last, after = track[-1], None
        for fix in reversed(track):
            if fix[4] > 1 or metres(fix, last) > 250 or (after is not None and after[2] - fix[2] > 90):
                break
            n, after = n + 1, fix
    return n


def trajectory_downsample(folder: str) -> int:
    n = 0
    for track in tracks(folder, True).values():
        last = None
        for fix in track:
            if last is None or metres(last, fix) >= 70 or fix[2] - last[2] >= 180:
                n, last = n + 1, fix
    return n


def broadcast_interpolate(folder: str) -> int:
    out = []
    for vessel, track in tracks(folder, True).items():
        for a, b in zip(track, [*track[1:], None], strict=True):
            out.append((vessel, a[2], a[0], a[1], a[5]))
            for step in range(1, (b[2] - a[2] - 1) // 20 + 1 if b and b[2] - a[2] <= 600 else 0):
                k = step * 20 / (b[2] - a[2])
                out.append((vessel, a[2] + step * 20, a[0] + (b[0] - a[0]) * k, a[1] + (b[1] - a[1]) * k, (a[5] + ((b[5] - a[5] + 540) % 360 - 180) * k) % 360))
    return len(out)


def route_grid(folder: str) -> int:
    cells: dict[tuple[int, int], list[float]] = {}
    for track in tracks(folder, False).values():
        for x, y, _, _, _, course in track:
            cell = cells.setdefault((math.floor(x / 0.0002), math.floor(y / 0.0002)), [0, 0.0, 0.0, 0.0, 0.0])
            for i, v in enumerate((1, x, y, math.cos(math.radians(2 * course)), math.sin(math.radians(2 * course)))):
                cell[i] += v
    return sum(c[0] >= 3 for c in cells.values())


def transfer_pairs(folder: str) -> int:
    """Neighbours by a dictionary of cells per frame."""
    frames: dict[int, list[tuple]] = collections.defaultdict(list)
    for vessel, track in tracks(folder, True).items():
        for fix in track:
            frames[fix[2]].append((*fix[:2], vessel, fix[4], fix[5], 20 + vessel % 180))
    n = 0
    for ships in frames.values():
        cells = collections.defaultdict(list)
        for s in ships:
            cells[math.floor(s[0] / 0.003), math.floor(s[1] / 0.003)].append(s)
        for s in ships:
            cx, cy = math.floor(s[0] / 0.003), math.floor(s[1] / 0.003)
            for o in (o for dx in (-1, 0, 1) for dy in (-1, 0, 1) for o in cells.get((cx + dx, cy + dy), ()) if s[2] < o[2]):
                turn = abs(s[4] - o[4]) % 360
                slow = abs(s[3] - o[3]) <= 1 and (max(s[3], o[3]) < 1 or min(turn, 360 - turn) <= 30)
                n += slow and metres(s, o) <= min(max(100, max(s[5], o[5]) / 2 + 25), 300)
    return n


def op5_simhash_near_dedup(folder: str) -> int:
    """The fingerprints alone, without the search for pairs."""
    import xxhash

    marks = set()
    for text in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist():
        words = (text or "").encode().lower().split()
        counts = [0] * 64
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                counts[b] += h >> b & 1
        marks.add(sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)))
    return len(marks)


def op10_best_fit_packing(folder: str) -> int:
    """Token ids and pieces by the JSON file's library, without placing them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()
    return sum(-(-(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) // 1024) for t in texts)


def op11_sentencepiece(folder: str) -> int:
    """Ids and texts by the library."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()
    return sum(len(model.decode(model.encode(t or "", num_threads=1))) > 0 for t in texts)


def op12_centroid_clustering(folder: str) -> int:
    """Ten rounds in loops over lists."""
    table = pq.read_table(f"{folder}/embeddings.parquet", columns=["embedding"])
    points = [[math.floor(1024 * x) for x in v] for v in table["embedding"].to_pylist()]
    centroids = points[:8]
    nearest = lambda p: min(range(len(centroids)), key=lambda j: sum((a - b) ** 2 for a, b in zip(p, centroids[j], strict=True)))
    for _ in range(10):
        groups = collections.defaultdict(list)
        for p in points:
            groups[nearest(p)].append(p)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if groups[j] else old for j, old in enumerate(centroids)]
    return len([nearest(p) for p in points])


def op13_lexical_search(folder: str) -> int:
    """An inverted index in dictionaries, and every posting of every item's terms."""
    import re

    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    read = lambda name: [t or "" for t in pq.read_table(f"{folder}/{name}.parquet", columns=["text"])["text"].to_pylist()]
    docs, items = ([[w.lower() for w in split(t)] for t in read(name)] for name in ("documents", "benchmark"))
    n, total = sum(map(bool, docs)), sum(map(len, docs))
    postings = collections.defaultdict(dict)
    for k, words in enumerate(docs):
        for w, tf in collections.Counter(words).items():
            postings[w][k] = 10**9 * tf // (1000 * tf + 12 * (75 + 25 * len(words) * n // total))
    found = 0
    for words in items:
        scores = collections.Counter()
        for w in words:
            weight = math.floor(1000 * math.log((2 * n + 2) / (2 * len(postings[w]) + 1))) if w in postings else 0
            for k, worth in postings.get(w, {}).items():
                scores[k] += weight * worth
        found += len([s for _, s in scores.most_common(20) if s > 0])
    return found


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    took = {}
    for f in (tail_segment_low_speed, trajectory_downsample, broadcast_interpolate, route_grid, transfer_pairs, op5_simhash_near_dedup, op10_best_fit_packing, op11_sentencepiece, op12_centroid_clustering, op13_lexical_search):
        began = time.perf_counter()
        n = f(folder)
        took[f.__name__] = {"seconds": round(time.perf_counter() - began, 2), "rows": n}
    print(json.dumps({"metric": "seconds in one plain Python process", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
