"""Vector codes and nearest vectors against brute force, on small tables with awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<double>, label int, rid long, curve int, code string, place long, part int"


def table(spark, vectors, ids=None, labels=None):
    n = len(vectors)
    ids, labels = list(range(n)) if ids is None else ids, [k % 3 for k in range(n)] if labels is None else labels
    return spark.createDataFrame([(i, v, lab, 1, 2, "clash", 3, 4) for i, v, lab in zip(ids, vectors, labels, strict=True)], SCHEMA)


def drawn(n, dimension, seed, scale=0.2):
    chance = random.Random(seed)
    return [[chance.gauss(0, scale) for _ in range(dimension)] for _ in range(n)]


def sound(vector, dimension):
    return vector is not None and len(vector) == dimension and all(x is not None and math.isfinite(x) for x in vector)


# --- vector codes -----------------------------------------------------------------------------


def brute_codes(kept, parts, entries, rounds):
    """kept: (vec_id, vector, label) by vec_id. Plain Lloyd rounds in Python's whole numbers."""
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    width = len(whole[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(v, p) for v in whole[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(book[p])), key=lambda j: (far(cut(v, p), book[p][j]), j)) for p in range(parts)] for v in whole]  # noqa: B023, E731
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for j in range(len(book[p])):
                if members := [cut(v, p) for v, c in zip(whole, codes, strict=True) if c[p] == j]:
                    book[p][j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    codes = assign()
    errors = [sum(far(cut(v, p), book[p][c[p]]) for p in range(parts)) for v, c in zip(whole, codes, strict=True)]
    said = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return sorted(
        (str(i), "".join(f"{j:02x}" for j in c), e, sum(f for (_, _, other), f in zip(kept, errors, strict=True) if other == lab), said)
        for (i, _, lab), c, e in zip(kept, codes, errors, strict=True)
    )


def got_codes(frame):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in frame.collect())


@pytest.mark.parametrize(("rounds", "entries"), [(0, 8), (2, 8), (5, 8), (2, 1), (3, 256)])
def test_codes_equal_plain_lloyd_rounds(spark, rounds, entries):
    from scriptorium.llm.vector_codes import vector_codes

    vectors = [*drawn(150, 8, 1), *[[0.25] * 8] * 40, [1e-9] * 8, [-1e-9] * 8, [3000.5, -70000.25] * 4]
    vectors += [None, [], [0.1, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [0.5] * 4]
    ids = list(range(len(vectors)))
    random.Random(2).shuffle(ids)
    labels = [None if k % 7 == 0 else k % 3 for k in range(len(vectors))]
    rows = sorted((r for r in zip(ids, vectors, labels, strict=True)), key=lambda r: r[0])
    assert sound(next(v for _, v, _ in rows if v), 8)
    kept = [r for r in rows if sound(r[1], 8)]
    assert got_codes(vector_codes(table(spark, vectors, ids, labels), 4, entries, rounds)) == brute_codes(kept, 4, entries, rounds)


def test_codes_of_repeated_and_missing_identifiers_and_of_nothing(spark):
    from scriptorium.llm.vector_codes import vector_codes

    vectors = drawn(30, 4, 3)
    ids = [5, 5, None, None, *range(6, 32)]
    rows = sorted(zip(ids, vectors, [0] * 30, strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got_codes(vector_codes(table(spark, vectors, ids, [0] * 30), 2, 4, 2)) == brute_codes(rows, 2, 4, 2)
    assert vector_codes(table(spark, []), 2).count() == 0
    assert vector_codes(table(spark, [None, [], [float("nan")]]), 2).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="divide"):
        vector_codes(table(spark, vectors, ids), 3)


def test_codes_of_enormous_components_are_exact(spark):
    from scriptorium.llm.vector_codes import vector_codes

    vectors = [[2.0**k, -(2.0**k), 1.5, 0.0] for k in range(0, 34, 2)]
    rows = [(k, v, k % 3) for k, v in enumerate(vectors)]
    expected = [(i, c, min(e, 2**63 - 1), min(t, 2**63 - 1), s) for i, c, e, t, s in brute_codes(rows, 2, 4, 2)]
    got = got_codes(vector_codes(table(spark, vectors), 2, 4, 2))
    assert [g[:3] + g[4:] for g in got] == [e[:3] + e[4:] for e in expected]
    assert len(vector_codes(table(spark, [[1e300, -1e300, 0.0, 1.0], [1.0] * 4]), 2, 4, 2).collect()) == 2


def test_heaps_skip_parts_and_never_one_that_moves():
    from scriptorium.llm.vector_codes import Block, _drift, nearest

    chance = np.random.default_rng(4)
    components = chance.integers(-200, 200, (4000, 2, 4))
    book = np.ascontiguousarray(components[:32].transpose(1, 0, 2))
    block, limits, scanned = Block.scanned(components, book), np.zeros((2, 32)), 0
    for step in range(6):
        new = book + chance.integers(-2, 3, book.shape) * (chance.random((2, 32, 1)) < 0.2)
        limits, book = limits + _drift(book, new), new
        scanned += block.moved(book, limits)
        for p in range(2):
            assert (block.codes[p] == nearest(components[:, p], book[p])[0]).all(), step
            assert all((np.diff(block.keys[p, b:e]) >= 0).all() and (block.codes[p, block.order[p, b:e]] == j).all() for j, (b, e) in enumerate(zip(block.bounds[p], block.bounds[p, 1:], strict=False)))
            assert (block.sums[p, :, 0, 1] == np.bincount(block.codes[p], minlength=32)).all()
    assert scanned < 6 * 8000 * 0.6


# --- nearest vectors --------------------------------------------------------------------------


def brute_nearest(rows, top, every):
    """rows: (vec_id, vector); the query's own row is no candidate."""
    out = []
    for k, (i, q) in enumerate(rows):
        if i is None or i % every:
            continue
        scores = []
        for j, (other, v) in enumerate(rows):
            if j != k:
                total = 0.0
                for a, b in zip(q, v, strict=True):
                    total += a * b
                scores.append((-total, other is None, other or 0))
        out += [(i, rank + 1, None if nameless else other, -s) for rank, (s, nameless, other) in enumerate(sorted(scores)[:top])]
    return sorted(map(str, out))


def got_nearest(frame):
    return sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in frame.collect())


@pytest.mark.parametrize("case", ["scattered", "copies", "lengths", "few"])
def test_nearest_equal_brute_force(spark, monkeypatch, case):
    from scriptorium.llm import nearest

    monkeypatch.setattr(nearest, "WINDOW", 8)
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "CHUNK", 200)
    monkeypatch.setattr(nearest, "TILE", 3)
    vectors = {
        "scattered": drawn(700, 12, 5), "copies": [[0.5, 0.25, -0.125]] * 300 + drawn(200, 3, 6),
        "lengths": [[x * 10 ** random.Random(k).randint(-3, 3) for x in v] for k, v in enumerate(drawn(400, 6, 7))], "few": drawn(9, 2, 8),
    }[case]
    ids = [k - 40 for k in range(len(vectors))]
    ids[7], ids[8], ids[3] = None, 20, 20
    bad = [None, [], [0.0] * len(vectors[0]), [float("nan")] * len(vectors[0]), [None] + [1.0] * (len(vectors[0]) - 1), [1.0]]
    frame = table(spark, vectors + bad, ids + [400, 420, 440, 460, 480, 500])
    assert got_nearest(nearest.nearest_vectors(frame, 5, 20)) == brute_nearest(list(zip(ids, vectors, strict=True)), 5, 20)


def test_windows_find_near_vectors_without_the_check(spark):
    from scriptorium.llm.nearest import nearest_vectors

    chance = np.random.default_rng(9)
    centres = chance.normal(size=(40, 32))
    vectors = (centres[np.arange(2000) % 40] + 0.05 * chance.normal(size=(2000, 32))).tolist()
    exact = brute_nearest(list(enumerate(vectors)), 20, 20)
    found = nearest_vectors(table(spark, vectors), check=False)
    assert found.where("NOT on_curve").count() == 0
    pairs = lambda rows: {(q, v) for q, _, v, _ in map(eval, rows)}  # noqa: E731, S307
    assert len(pairs(got_nearest(found)) & pairs(exact)) >= 0.9 * len(exact)


def test_nearest_of_nothing(spark):
    from scriptorium.llm.nearest import nearest_vectors

    assert nearest_vectors(table(spark, [])).count() == 0
    assert nearest_vectors(table(spark, [None, [0.0, 0.0]])).count() == 0
    assert nearest_vectors(table(spark, [[1.0, 2.0]])).count() == 0
    assert nearest_vectors(table(spark, [[1.0, 2.0]] * 3, [1, 2, 3])).columns == ["query_id", "rank", "vec_id", "score", "on_curve"]


def test_the_curve_goes_from_cell_to_neighbouring_cell():
    from scriptorium.llm.nearest import hilbert_keys

    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
