"""Importance resampling against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = [
    None, "", " \n\t.,;", "one", "two words", "THREE Words here", "Ünï ÇÖDE İ 日本 é  x", "x" * 400 + " " + "y" * 64 + " z", "a\x00b\x7fc", "tie tie tie",
    " ".join(f"w{k % 97}" for k in range(5000)), " ".join(f"Word{k}" for k in range(20)), " ".join(f"word{k}" for k in range(19)),
]
SCHEMA = "doc_id long, text string, score double, rank int, weight string, stream binary, late int, place int"


def docs(spark, texts, ids):
    return spark.createDataFrame([(i, t, 1.0, 2, "clash", None, 3, 4) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def grams(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(lowered)
    return len(found), [zlib.crc32(" ".join(found[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(found) - k + 1)]


def brute(texts, ids, target, percent, least):
    raw, wanted = Counter(b for t in texts for b in grams(t)[1]), Counter(b for t in target for b in grams(t)[1])
    everything, all_wanted = raw.total(), wanted.total()
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (everything + 10000) / ((raw[b] + 1) * (all_wanted + 10000)))) for b in raw}
    rows = []
    for i, t in zip(ids, texts, strict=True):
        n, buckets = grams(t)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        rows.append([i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in rows)


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (50, 1), (100, 0), (0, 20)])
def test_sample_equals_brute_force(spark, percent, least):
    from scriptorium.llm.importance import importance_sample

    chance = random.Random(percent)
    texts = [*TEXTS, *(" ".join(chance.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(chance.randint(0, 40))) for _ in range(300)), *["the same text of several words"] * 60]
    ids = list(range(len(texts)))
    ids[5], ids[6], ids[20], ids[21] = None, None, 33, 33
    target = ["alpha beta alpha beta gamma", None, "", "one two three"]
    got = importance_sample(docs(spark, texts, ids), docs(spark, target, [1, 2, 3, 4]), percent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(texts, ids, target, percent, least)


def test_sample_of_nothing_and_towards_nothing(spark):
    from scriptorium.llm.importance import importance_sample

    empty = docs(spark, [], [])
    assert importance_sample(empty, docs(spark, ["a"], [1])).count() == 0
    texts = [f"word {k} of it" for k in range(10)]
    got = importance_sample(docs(spark, texts, range(10)), empty, 50, 1)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(texts, list(range(10)), [], 50, 1)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    from scriptorium.llm import importance

    monkeypatch.setattr(importance, "BLOCK_WORDS", 7)
    texts = [*TEXTS, *TEXTS]
    got = importance.importance_sample(docs(spark, texts, range(len(texts))), docs(spark, ["three words here"], [0]), 50, 1)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(texts, list(range(len(texts))), ["three words here"], 50, 1)


def test_checksums_of_joined_words():
    from scriptorium.llm.importance import appended

    words = [b"", b"a", b"hello", b"x" * 63, b"y" * 64, b"z" * 65, b"q" * 300, "日本".encode() * 50]
    pairs = [(a, b) for a in words for b in words]
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    assert appended(left, right, np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_runs_and_sums_between_offsets():
    from scriptorium.llm.importance import added_up, run_lengths

    stream = np.array([5, 3, 5, 5, 0, 9999], np.uint16)
    runs, counts = run_lengths(stream)
    assert runs.tolist() == [0, 3, 5, 9999] and counts.tolist() == [1, 1, 3, 1]
    assert run_lengths(stream[:0])[0].tolist() == []
    assert added_up(np.array([1, 2, 3, 4]), np.array([0, 2, 0, 0, 2, 0])).tolist() == [0, 3, 0, 0, 7, 0]
    assert added_up(np.array([], np.int64), np.array([0, 0])).tolist() == [0, 0]
