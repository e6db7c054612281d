"""Operators of the llm subpackage against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(6000))
TEXTS = [
    "the cat sat on the mat and looked at the moon for a while", "the cat sat on the mat and looked at the moon for a while",
    "The Cat sat on the mat and looked at the moon for a while", None, "", "   \n\t ", "one", "one", "two words", LONG, LONG + " tail",
    "αβγ ▁x  doubled  spaces\n\nlines\x1f\x85é", "<|im_start|>user <|esc|>im_end|> <|endoftext|>", "日本語のテキスト🎉",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, `key` int, size int, score double, row int"


def docs(spark, texts=TEXTS, ids=None):
    ids = list(range(10, 10 + len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None, "clash", 1, 2, 3.0, 4) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- sharding ---------------------------------------------------------------------------------


def test_shards_are_gapless_near_equal_and_keep_equal_texts(spark):
    from scriptorium.llm.sharding import shard_by_bytes

    random.seed(3)
    texts = ["a b " * random.randint(1, 50) for _ in range(900)] + ["hot text"] * 300 + TEXTS
    got = rows(shard_by_bytes(docs(spark, texts), 8))
    assert len(got) == len(texts)
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        text = texts[r["doc_id"] - 10] or ""
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[text].add(r["shard"])
    assert set(sizes) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for t, h in homes.items() if (len(t) + 8) * texts.count(t) * 8 < sum(sizes.values()))
    assert all(abs(s - sum(sizes.values()) / 8) <= max(r["size"] for r in got) for s in sizes.values())


@pytest.mark.parametrize("copies", [20, 130, 255, 260, 275, 300])
def test_groups_of_any_size_under_a_share_keep_the_law(spark, copies):
    from scriptorium.llm.sharding import shard_by_bytes

    random.seed(copies)
    texts = ["a third of a line"] * copies + ["another of them!!"] * 200 + [f"{k} " + "z" * random.randint(0, 40) for k in range(2000)]
    sizes, homes = Counter(), defaultdict(set)
    for r in rows(shard_by_bytes(docs(spark, texts), 8)):
        sizes[r["shard"]] += r["size"]
        homes[texts[r["doc_id"] - 10]].add(r["shard"])
    mean = sum(sizes.values()) / 8
    assert all(len(h) == 1 for h in homes.values())
    assert all(abs(s - mean) <= 60 for s in sizes.values())


def test_a_group_beyond_a_share_is_split(spark):
    from scriptorium.llm.sharding import shard_by_bytes

    got = rows(shard_by_bytes(docs(spark, ["same"] * 400 + [f"t{k}" for k in range(200)]), 6))
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 24
    assert shard_by_bytes(docs(spark, []), 4).count() == 0


# --- exact copies -----------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    from scriptorium.llm.exact_dedup import exact_groups

    ids = [*range(len(TEXTS)), 0]
    texts = [*TEXTS, TEXTS[0]]  # the first row twice
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[t or ""].append(i)
    got = rows(exact_groups(docs(spark, texts, ids), keep))
    assert len(got) == len(texts)
    for r in got:
        members = groups[texts[r["doc_id"]] or ""]
        assert r["keep_id"] == (min if keep == "smallest" else max)(members) and r["group_size"] == len(members)
        assert r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(groups)


def test_drop_exact_copies_keeps_columns_and_one_row_a_text(spark):
    from scriptorium.llm.exact_dedup import drop_exact_copies

    table = docs(spark, [*TEXTS, TEXTS[0]], [*range(len(TEXTS)), 0])
    kept = drop_exact_copies(table)
    assert kept.columns == table.columns
    assert sorted((r["text"] or "") for r in rows(kept)) == sorted({t or "" for t in TEXTS})
    assert drop_exact_copies(docs(spark, [])).count() == 0


def test_byte_verification_separates_texts_with_one_digest(spark, monkeypatch):
    from scriptorium.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.unhex(F.sha2(F.substring(text, 1, 1), 256)))
    got = {r["doc_id"]: r for r in rows(exact_dedup.exact_groups(docs(spark, ["ab", "ac", "ab", "x"], [1, 2, 3, 4])))}
    assert [(got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) for i in (1, 2, 3, 4)] == [(1, 2, True), (2, 1, True), (1, 2, False), (4, 1, True)]
    assert sorted(r["doc_id"] for r in rows(exact_dedup.drop_exact_copies(docs(spark, ["ab", "ac", "ab", "x"], [1, 2, 3, 4])))) == [1, 2, 4]


def test_point_lookup(spark):
    from scriptorium.llm.exact_dedup import build_index

    index = build_index(docs(spark))
    found = rows(index.lookup([hashlib.sha256(b"one").digest(), b"\0" * 32]))
    assert [(r["keep_id"], r["group_size"]) for r in found] == [(16, 2)]


# --- quality ----------------------------------------------------------------------------------


def test_quality_learns_and_takes_any_text(spark):
    from scriptorium.llm.quality import FlatTrees, document_statistics, drop_rejected, fit, held_out, score, train

    random.seed(1)
    good = ["Some plain words follow here, and then a few more of them. " * random.randint(1, 4) for _ in range(150)]
    bad = ["BUY!! NOW$$$ " * random.randint(2, 20) for _ in range(150)]
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(10 + k, int(k < 150), None) for k in range(300)] + [(None, 1, 0), (11, None, 0)], "doc_id long, quality int, toxic int")
    model = train(table, labels)
    got = rows(score(table, model))
    out = {r["doc_id"] for r in rows(table.where(held_out(F.col("doc_id"))))}
    assert out == {i for i in range(10, 310) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all((r["score"] >= 0.5) == (r["doc_id"] < 160) for r in got if r["doc_id"] in out)
    assert drop_rejected(table, model).count() == 150 and drop_rejected(table, model).columns == table.columns
    odd = rows(score(docs(spark), model))
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    assert score(docs(spark, []), model).count() == 0
    nothing = train(docs(spark, []), labels)
    assert isinstance(nothing, FlatTrees) and nothing.score(document_statistics(["a", None])) == pytest.approx([0.5, 0.5])
    assert fit(document_statistics(["a", "b"]), np.array([1.0, 1.0])).score(document_statistics(["c"]))[0] > 0.5


def test_flat_trees_equal_plain_ones_and_tell_held_out_documents_apart(spark):
    """The registered query on a whole small table, against trees that are walked node by node."""
    from scriptorium.llm import queries
    from scriptorium.llm.quality import document_statistics, train

    folder = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = train(table, labels)

    def leaf(tree: int, node: int, x: np.ndarray) -> float:
        if node >= model.feature.shape[1]:
            return model.leaf[tree][node - model.feature.shape[1]]
        return leaf(tree, 2 * node + (2 if x[model.feature[tree][node]] > model.threshold[tree][node] else 1), x)

    def plain(text: str | None) -> float:
        x = document_statistics([text])[0]
        return 1 / (1 + np.exp(-model.base - sum(leaf(t, 0, x) for t in range(len(model.leaf)))))

    got = {r["doc_id"]: r for r in rows(queries.op8_quality_classifier(spark, folder))}
    texts = {r["doc_id"]: r["text"] for r in rows(table)}
    assert got.keys() == texts.keys()
    for doc_id in sorted(texts)[:: len(texts) // 100]:
        assert got[doc_id]["score"] == pytest.approx(plain(texts[doc_id]), abs=1e-12)
    known = [(got[r["doc_id"]], r["quality"]) for r in rows(labels.where("quality IS NOT NULL")) if got[r["doc_id"]]["held_out"]]
    yes, no = ([r["score"] for r, label in known if label == wanted] for wanted in (1, 0))
    assert len(yes) > 50 and len(no) > 10
    assert np.mean([(a > b) + (a == b) / 2 for a in yes for b in no]) > 0.98
    assert np.mean([r["predicted"] == label for r, label in known]) > 0.97


def test_trees_split_on_thresholds():
    from scriptorium.llm.quality import fit

    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((fit(x, y).score(x) >= 0.5) == y).mean() > 0.97


# --- packing ----------------------------------------------------------------------------------


def test_ids_are_the_tokenizer_s_and_pieces_are_packed_whole(spark):
    from tokenizers import Tokenizer

    from scriptorium.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = rows(pack_documents(docs(spark), path))
    by_doc = defaultdict(dict)
    for r in got:
        by_doc[r["doc_id"] - 10][r["piece"]] = r
    for k, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert len(pieces) == len(by_doc[k])
        for n, piece in enumerate(pieces):
            r = by_doc[k][n]
            assert (r["start"], r["length"]) == (4096 * n, len(piece))
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack_documents(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    from scriptorium.llm.packing import best_fit

    rng = np.random.default_rng(5)
    length = np.sort(rng.integers(1, 100, 700))[::-1].astype(float)
    sizes, capacity = np.column_stack([length, np.ones(700), length**2]), np.array([100.0, 4.0, 5000.0])
    sizes = np.minimum(sizes, capacity)
    bins = best_fit(sizes, capacity, np.array([1.0, 0.3, 0.3]), rule)
    for d in range(3):
        assert np.bincount(bins, sizes[:, d]).max() <= capacity[d] + 1e-9
    assert len(set(bins)) < 1.35 * max(np.ceil(sizes.sum(0) / capacity))


# --- near copies ------------------------------------------------------------------------------


def brute_components(texts, ids, words, percent):
    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets, home = [grams(t) for t in texts], list(ids)
    for a in range(len(ids)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) and home[a] != home[b]:
                low, high = sorted((home[a], home[b]))
                home = [low if h == high else h for h in home]
    return {i: (len(s), h) for i, s, h in zip(ids, sets, home, strict=True)}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_near_groups_equal_brute_force(spark, words, percent, monkeypatch):
    from scriptorium.llm import jaccard

    monkeypatch.setattr(jaccard, "FREQUENT_COUNT", 3)  # so that small tables have frequent tokens
    monkeypatch.setattr(jaccard, "PAIRED_OFF", 2)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 500)
    random.seed(words)
    vocabulary = [f"v{k}" for k in range(400)]
    passage = random.choices(vocabulary, k=60)
    texts = list(TEXTS)
    for _ in range(12):
        base = random.choices(vocabulary, k=random.randint(20, 160))
        for _ in range(random.randint(1, 9)):
            copy = list(base)
            for _ in range(random.randint(0, 6)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + random.choices(vocabulary, k=random.randint(0, 40))) for _ in range(40)]
    ids = random.sample(range(10_000), len(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard.near_groups(docs(spark, texts, ids), words, percent))}
    assert got == brute_components(texts, ids, words, percent)


def test_near_groups_of_odd_tables(spark):
    from scriptorium.llm.jaccard import drop_near_copies, near_groups

    assert near_groups(docs(spark, [])).count() == 0
    table = docs(spark, ["a b c d e f", "a b c d e f", None, "x"], [7, 7, None, 3])
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows(near_groups(table)))
    assert got == [("3", "3"), ("7", "7"), ("7", "7"), ("None", "None")]
    kept = drop_near_copies(docs(spark, ["a b c d e f", "A B C D E F", "other"], [5, 2, 9]))
    assert sorted(r["doc_id"] for r in rows(kept)) == [2, 9] and kept.columns == table.columns


def test_identifiers_with_several_texts_lose_no_link(spark):
    from scriptorium.llm.jaccard import near_groups

    words = lambda seed: [f"{seed}{k}" for k in range(100)]
    a, b, c = (" ".join(words(s)) for s in "abc")
    nearly = lambda s: " ".join([*words(s)[:99], "other"])
    table = docs(spark, [a, a, b, nearly("b"), c, a, b, nearly("c"), ""], [1, 5, 5, 7, 20, 30, 30, 40, 5])
    got = {(r["doc_id"], r["component_id"]) for r in rows(near_groups(table, 3, 90))}
    assert got == {(1, 1), (5, 1), (7, 1), (20, 20), (30, 1), (40, 20), (5, 1)}
    torn = docs(spark, [a, b, a, b, nearly("b")], [1, 2, 9, 9, 12])
    assert {(r["doc_id"], r["component_id"]) for r in rows(near_groups(torn, 3, 90))} == {(1, 1), (2, 1), (9, 1), (12, 1)}


def test_components_of_chains_and_stars(spark):
    from scriptorium.llm.jaccard import connected_components

    links = [(k, k + 1) for k in range(50, 80)] + [(1000 + k, 900) for k in range(40)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in rows(connected_components(spark.createDataFrame(links, "x long, y long")))}
    assert got == {k: 50 for k in range(50, 81)} | {1000 + k: 900 for k in range(40)} | {900: 900}


# --- fingerprints -----------------------------------------------------------------------------


@pytest.mark.parametrize("range_rows", [3, 256])
def test_fingerprints(spark, range_rows, monkeypatch):
    from scriptorium.llm import fingerprint
    from scriptorium.llm.fingerprint import fingerprints

    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    random.seed(2)
    texts = [*TEXTS, *[" ".join(random.choices("abcdefghijklmnopq", k=random.randint(1, 500))) for _ in range(60)]]
    ids = random.sample(range(0, 300_000, 7), len(texts))
    order = sorted(range(len(ids)), key=lambda k: -ids[k])
    following = {ids[a]: texts[b] or "" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    got = {r["doc_id"]: r for r in rows(fingerprints(docs(spark, texts, ids)))}

    def grams(text):
        w = [x for x in re.split("[ \t\n\x0b\f\r]+", text.lower()) if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    prints = defaultdict(set)
    for i, text in zip(ids, texts, strict=True):
        text, r = text or "", got[i]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[i][:third]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(r["fingerprint"])
        for near, other in ((r["near_edited"], edited), (r["near_next"], following[i])):
            a, b = grams(text), grams(other)
            truth = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - truth) < (1e-9 if max(len(a), len(b)) <= 32 else 0.35)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints(docs(spark, [])).count() == 0


@pytest.mark.parametrize("range_rows", [2, 256])
def test_fingerprints_of_repeated_and_missing_identifiers(spark, range_rows, monkeypatch):
    from xxhash import xxh64_intdigest

    from scriptorium.llm import fingerprint

    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    random.seed(4)
    table = [(random.choice([None, 5, 6, 7, -3, 2**62]), random.choice(["abc def", "ghij klmno", "pqr st uvw", None, f"x{k} yz"])) for k in range(60)]
    place = lambda row: (-(2**63) if row[0] is None else row[0], xxh64_intdigest((row[1] or "").encode(), 42) & (2**63 - 1))
    order = sorted(table, key=place, reverse=True)
    expected = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, third = text or "", len(text or "") // 3
        expected.append((str(i), hashlib.sha256((text[: len(text) - third] + (after or "")[:third]).encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["edited_sha256"]) for r in rows(fingerprint.fingerprints(docs(spark, [t for _, t in table], [i for i, _ in table])))]
    assert sorted(got) == sorted(expected)


def test_sketches_merge_and_compare_unequal_documents(spark):
    from scriptorium.llm.fingerprint import containment, merged, with_sketch

    words = [f"x{k}" for k in range(4000)]
    table = spark.createDataFrame([(" ".join(words), " ".join(words[:60]), " ".join(words[60:]))], "big string, small string, rest string")
    for name in ("big", "small", "rest"):
        table = with_sketch(table, name, f"s_{name}")
    limit, hashes = merged("s_small", "s_rest")
    r = table.select(containment("s_small", "s_big").alias("inside"), F.size(F.array_except("s_big_hashes", hashes)).alias("lost"), limit.alias("limit")).first()
    assert r["inside"] == 1.0 and r["lost"] <= 4


# --- chat -------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    from scriptorium.llm.chat import chat_template, digests, escape, format_conversations, parse_turn, render, unescape

    for text in TEXTS[6:] + ["<|esc|>esc|>", "<|esc|><|esc|>im_start|>", "<|im_<|im_end|>end|>", "<|nl|>", "\n<|esc|>nl|>"]:
        assert unescape(escape(text)) == text and "<|im_" not in escape(text).replace("<|im_<", "")
    turns = [("user\nx", "a<|im_end|>\n"), ("assistant", ""), ("", "<|esc|>nl|>\n")]
    made = render(turns)
    assert [parse_turn(made.text[a:b]) for a, b in made.spans] == turns and made.rewritten_at is None
    shouting = render(turns, lambda t: f"[{len(t)}]" + chat_template(t))
    assert shouting.rewritten_at == 0 and shouting.agreed == 1 and shouting.spans == []
    table = [(1, k, ["user", "assistant"][k % 2], f"turn {k} <|im_end|>") for k in range(100)] + [(2, None, None, None), (None, 0, "assistant", "x"), (3, 0, "user", "y"), (3, 0, "user", "y")]
    conversations = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in rows(digests(format_conversations(conversations)))}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 100, 2: 1, None: 1, 3: 2} and not any(r["rewritten"] for r in got.values())
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in table[:100])
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    loss = "".join(t for _, _, r, t in table[:100] if r == "assistant")
    assert got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[1]["loss_chars"] == len(loss)
    changing = rows(digests(format_conversations(conversations, lambda t: f"{len(t)}" + chat_template(t))))
    assert all(r["rewritten"] for r in changing)
    assert digests(format_conversations(conversations.limit(0))).count() == 0


def test_masks_are_found_without_knowing_the_template():
    from scriptorium.llm.chat import render, text_place

    def numbered(turns):
        return "".join(f"#{k} <{role}> «{text}»;\n" for k, (role, text) in enumerate(turns))

    def shouting(turns):
        return "".join(f"{role}{len(text)}:{text}." for role, text in turns)

    turns = [("user", "a"), ("assistant", "«»;\n#1 <x>"), ("assistant", ""), ("assistant", "»»")]
    made = render(turns, numbered)
    found = [text_place(turns, k, *span, made.text, numbered) for k, span in enumerate(made.spans)]
    assert [made.text[b:e] for b, e in found] == [t for _, t in turns]
    made = render(turns[:2], shouting)
    assert text_place(turns, 1, *made.spans[1], made.text, shouting) is None


def test_templates_see_whole_conversations(spark):
    from scriptorium.llm.chat import chat_template, concatenative, digests, format_conversations, render

    table = [(1, k, "user", f"turn {k}") for k in range(100)] + [(2, k, "user", f"turn {k}") for k in range(30)]
    conversations = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    forgets = lambda turns: chat_template(turns[-40:])
    made = {r["conv_id"]: r for r in rows(format_conversations(conversations, forgets))}
    said = [("user", f"turn {k}") for k in range(100)]
    assert made["1"]["formatted"] == forgets(said) and made["1"]["rewritten_at"] == render(said, forgets).rewritten_at == 40 and made["1"]["spans"] == []
    assert {r["conv_id"]: r["rewritten"] for r in rows(digests(format_conversations(conversations, forgets)))} == {1: True, 2: False}
    opened = {r["conv_id"]: r for r in rows(digests(format_conversations(conversations, lambda t: "<s>" + chat_template(t))))}
    assert {c: (r["n_turns"], r["rewritten"]) for c, r in opened.items()} == {1: (100, False), 2: (30, False)}
    untrue = concatenative(lambda t: f"{len(t)}" + chat_template(t))
    assert all(r["rewritten"] for r in rows(digests(format_conversations(conversations, untrue))))


# --- sampled pieces ---------------------------------------------------------------------------


def test_sampled_segmentations_are_lossless_and_reproducible(spark):
    from scriptorium.llm.piece_sampling import decode_ids, encode_and_decode, encode_sampled

    model = public_tokenizers.path("piece_bpe_32k.model")
    table = docs(spark, [*TEXTS, TEXTS[0], "x" * 9000, "▁▁ ▁", "  lead", "².."], [*range(len(TEXTS)), 0, 90, 91, 92, 93])
    got = rows(decode_ids(encode_sampled(table, model), model))
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    assert sorted(map(str, rows(encode_and_decode(table, model)))) == sorted(map(str, got))
    again = {r["doc_id"]: r["ids"] for r in rows(encode_sampled(table.repartition(3), model))}
    assert all(again[r["doc_id"]] == r["ids"] for r in got)
    other = {r["doc_id"]: r["ids"] for r in rows(encode_sampled(table, model, seed=2))}
    assert other != again


@pytest.mark.parametrize("text", ["there", "a  (b's", "   __x", "$(d).", " if();\n  e", "ab▁c²"])
def test_sampling_follows_the_lattice(text):
    """Whole texts against every segmentation, over marks, runs of spaces and characters written as bytes."""
    from scriptorium.llm.piece_sampling import lattices, sample

    made = lattices(public_tokenizers.path("piece_bpe_32k.model"), 0.5)
    byte_ids = range(made.bytes_first, made.bytes_first + 256)
    pieces = {made.spelt[i].decode(): i for i in range(len(made.spelt)) if i not in byte_ids and made.spelt[i] and made.spelt[i] != "▁".encode()}
    assert sum(map(bool, made.log_weight)) == 31_741

    def segmentations(rest):
        if not rest:
            yield (), 1.0
            return
        starts = [((pieces[rest[:k]],), k, np.exp(made.log_weight[pieces[rest[:k]]])) for k in range(1, len(rest) + 1) if rest[:k] in pieces]
        if rest[0] not in pieces:
            raw = rest[0].encode()
            starts.append((tuple(made.bytes_first + b for b in raw), 1, np.exp(made.log_byte * len(raw))))
        for ids, k, weight in starts:
            yield from ((ids + more, weight * p) for more, p in segmentations(rest[k:]))

    every = dict(segmentations(text))
    total = sum(every.values())
    drawn = Counter(tuple(ids.tolist()) for ids in sample([text] * 20_000, np.arange(20_000), made))
    assert set(drawn) <= set(every)
    assert all(abs(drawn[s] / 20_000 - p / total) < 0.02 for s, p in every.items())


def test_sampling_is_the_same_in_blocks_of_any_size(monkeypatch):
    from scriptorium.llm import piece_sampling as P

    made = P.lattices(public_tokenizers.path("piece_bpe_32k.model"), 0.5)
    texts = [t or "" for t in TEXTS] + ["x" * 9000 + " yes" * 50]
    whole = [ids.tolist() for ids in P.sample(texts, np.arange(len(texts)), made)]
    for size in (64, 1000):
        monkeypatch.setattr(P, "BATCH_CHARS", size)
        monkeypatch.setattr(P, "MAX_UNITS", 50)
        assert [ids.tolist() for ids in P.sample(texts, np.arange(len(texts)), made)] == whole
    assert [P.decode(np.array(ids), made) for ids in whole] == texts


# --- pages ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain < text & more &amp; &eacute;", "plain < text & more & é"),
        ("<p>one<p>two<br>three</p><div>four</div>", "one\n\ntwo\nthree\n\nfour"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol><li>x<li>y</ol>", "- a\n- b\n  - c\n- d\n\n1. x\n2. y"),
        ("<table><caption>C<tr><th>Name<th>N<tr><td>xx<td>1<tr><td>long name</table>", "C\nName       N\nxx         1\nlong name"),
        ("<head><title>t</title></head><style>p{}</style><script>var a='</p>'</script><p hidden>no<p style='display: none'>no</p><p>yes", "yes"),
        ("a<!-- x --><b>b</b> <i> c</i>", "ab c"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<img alt='pic'><input type=hidden value=v>x", "pic x"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<td>loose</td></div></p>end", "loose\n\nend"),
        ("<p>ok</p><a href=index class=navigationmenu <b>x</b>", "ok\n\nx"),
        ("<p>all there</p><a href='cut off", "all there"),
        ("a <b x='1>2'>b</b> 1<2 & <3 </> x", "a b 1<2 & <3 x"),
        ("<i title=\"open>one</i> <i title='x'>two</i>", "one two"),
        ("<table><tr><th colspan=2>Wide<th>C<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>", "Wide  C\na  b  c\n   d  e"),
        ("<table><tr><td colspan=2>a wide heading<td>z<tr><td>p<td>q<td>r</table>", "a wide heading  z\np  q            r"),
        ("<ol start=5><li>a<li value=9>b<li>c</ol><ol reversed><li>x<li>y</ol>", "5. a\n9. b\n10. c\n\n2. x\n1. y"),
    ],
)
def test_visible_text(page, text):
    from scriptorium.llm.html_text import visible_text

    assert visible_text(page) == text


@pytest.mark.parametrize("deep", ["<font>" * 5000, "<div>" * 5000, "<b><span>" * 50_000])
@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<div hidden>no<p>no</p></div><p style='display:none'>no</p><p>yes", "a\n\nyes"),
        ("<table><tr><th>Name<th>N<tr><td>xx<td>1<tr><td>long name</table>z", "Name       N\nxx         1\nlong name\n\nz"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<i>x</i></b><p>y", "x\n\ny"),
    ],
)
def test_visible_text_of_deep_pages(deep, page, text):
    from scriptorium.llm.html_text import visible_text

    assert visible_text(deep + page) == text


@pytest.mark.parametrize("broken", ["<p>ok<a " + "x" * 100_000, "<p>ok<a " + "x y=" * 25_000, "<p>ok<a" + " " * 100_000, "<p>ok<a href='" + "x" * 100_000, "<p>ok" + "<a href=\"x' " * 20_000])
def test_broken_pages_take_linear_time(broken):
    import time

    from scriptorium.llm.html_text import visible_text

    began = time.process_time()
    assert visible_text(broken) == "ok" and time.process_time() - began < 1


def brute_page(node):
    """Markup of a random tree and, by plain recursion, its lines: (text, gap before) with bullets and hidden parts."""
    lines, state = [], {"text": "", "gap": False, "mark": ""}

    def close(gap):
        if state["text"]:
            lines.append((state["text"], state["gap"]))
            state.update(text="", gap=False)
        state["gap"] |= gap

    def walk(tag, children, depth):
        markup = ""
        for child in children:
            if isinstance(child, str):
                markup += child
                state["text"] += (state["mark"] if not state["text"] else "") + child
                state["mark"] = ""
                continue
            name, inner = child
            if name == "hidden":
                kept, size = dict(state), len(lines)
                markup += f"<div hidden>{walk('div', inner, depth)}</div>"
                state.update(kept)
                del lines[size:]
            elif name == "span":
                markup += f"<span>{walk('span', inner, depth)}</span>"
            elif name == "br":
                markup += "<br>"
                if not state["text"]:
                    lines.append(("", False))
                close(False)
            elif name == "li":
                close(False)
                state["mark"] = "  " * max(0, depth - 1) + "- "
                markup += f"<li>{walk('li', inner, depth)}</li>"
                close(False)
                state["mark"] = ""
            else:
                gap = name == "p" or (name == "ul" and not depth)
                close(gap)
                markup += f"<{name}>{walk(name, inner, depth + (name == 'ul'))}</{name}>"
                close(gap)
        return markup

    markup = walk("div", node, 0)
    close(False)
    text = ""
    for k, (line, gap) in enumerate(lines):
        text += ("\n" if k else "") + ("\n" if gap and k and lines[k - 1][0] else "") + line
    return markup, text.strip("\n")


def test_visible_text_equals_a_plain_renderer():
    from scriptorium.llm.html_text import visible_text

    random.seed(11)
    counter = iter(range(10**9))

    def tree(depth, allowed):
        out = []
        for _ in range(random.randint(0, 4)):
            kind = random.choice(allowed)
            if kind == "text":
                out.append(f"w{next(counter)}")
            elif kind == "ul":
                out.append(("ul", [("li", tree(depth - 1, ["text", "span", "ul", "hidden"] if depth > 1 else ["text"])) for _ in range(random.randint(0, 3))]))
            elif kind == "br":
                out.append(("br", []))
            else:
                inner = ["text", "span", "br"] if kind in ("p", "span") else ["text", "span", "br", "p", "div", "ul", "hidden"]
                out.append((kind, tree(depth - 1, inner) if depth else []))
        return out

    for _ in range(3000):
        page, text = brute_page(tree(4, ["text", "span", "br", "p", "div", "ul", "hidden"]))
        assert visible_text(page) == text, page


def test_extract_keeps_rows(spark):
    from scriptorium.llm.html_text import extract

    table = spark.createDataFrame([(1, "<p>a", "old"), (1, "<p>a", "old"), (2, None, None)], "page_id long, html string, visible string")
    assert sorted((r["page_id"], r["visible"]) for r in rows(extract(table))) == [(1, "a"), (1, "a"), (2, "")]
    assert extract(table.limit(0)).count() == 0


# --- URL lists --------------------------------------------------------------------------------


def test_url_list_is_judged_as_of_the_fetch(spark):
    from scriptorium.llm.url_filter import judge

    entries = spark.createDataFrame(
        [
            ("domain", "Example.com", "add", "block", "spam", "2024-02-01"), ("domain", "example.com", "remove", "block", None, "2024-03-01"),
            ("host", "a.example.com", "add", "allow", "ok", "2024-02-10"), ("prefix", "a.example.com/x/y", "add", "block", "path", "2024-02-15"),
            ("domain", None, "add", "block", "n", "2024-01-01"), ("host", "b.org", "add", "block", "n", None),
            ("prefix", "h.org/a/b/c/d/e/f/g/h/bad", "add", "block", "deep", "2024-01-01"), ("prefix", "h.org/a/b/c/d/e/f/g/h/bad/i", "add", "allow", "deeper", "2024-01-01"),
            ("domain", ".".join("abcdefghijklmnopqrstuvwxyz") + ".net", "add", "block", "long", "2024-01-01"),
        ],
        "kind string, pattern string, action string, verdict string, category string, day string",
    ).withColumn("day", F.col("day").cast("date"))
    captures = [
        ("http://www.example.com/", "2024-01-31", "none"), ("http://www.example.com/", "2024-02-01", "block"), ("http://www.example.com/", "2024-03-01", "none"),
        ("https://u:p@A.example.com:80/x?q", "2024-02-09", "block"), ("https://a.example.com/x", "2024-02-10", "allow"),
        ("https://a.example.com/x/y/z#f", "2024-02-20", "block"), ("https://a.example.com/x/yy", "2024-02-20", "allow"),
        ("notexample.com", "2024-02-20", "none"), ("http://notexample.com", "2024-02-20", "none"), (None, "2024-02-20", "none"), ("http://b.org", None, "none"),
        ("http://h.org/a/b/c/d/e/f/g/h/bad", "2024-02-20", "block"), ("http://h.org/a/b/c/d/e/f/g/h/fine", "2024-02-20", "none"),
        ("http://h.org/a/b/c/d/e/f/g/h/bad/i/j?k", "2024-02-20", "allow"), ("http://x.y." + ".".join("abcdefghijklmnopqrstuvwxyz") + ".net/", "2024-02-20", "block"),
        ("http://" + ".".join("bcdefghijklmnopqrstuvwxyz") + ".net/", "2024-02-20", "none"),
    ]
    table = spark.createDataFrame([(k, u, d) for k, (u, d, _) in enumerate(captures)], "capture_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    got = {r["capture_id"]: r["verdict"] for r in rows(judge(table, entries))}
    assert got == {k: v for k, (_, _, v) in enumerate(captures)}
    assert judge(table, entries.limit(0)).where("verdict <> 'none'").count() == 0 and judge(table.limit(0), entries).count() == 0
    assert judge(table.unionByName(table), entries).count() == 2 * len(captures)


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    from tests.conftest import SF

    docs_table = spark.read.parquet(f"{SF}/documents.parquet")
    kept, outputs = docs_table, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept.count(), stage(spark, kept, SF).cache()
        assert kept.columns == docs_table.columns and kept.count() <= before
        outputs.append({r["doc_id"]: r["text"] for r in rows(kept)})
    good, distinct, alone = outputs
    smallest = {}
    for doc_id in sorted(good):
        smallest.setdefault(good[doc_id], doc_id)
    assert distinct == {doc_id: text for text, doc_id in smallest.items()}
    homes = brute_components(list(distinct.values()), list(distinct), 5, 80)
    assert alone == {doc_id: text for doc_id, text in distinct.items() if homes[doc_id][1] == doc_id}
    packed = rows(corpus_pipeline.run(spark, SF))
    assert {r["doc_id"] for r in packed} == alone.keys()
    filled = {}
    for r in packed:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 4096


@pytest.mark.parametrize("name", ["op3_url_filters", "op5_chat_formatting", "op6_exact_dedup", "op9_ngram_jaccard_join", "op11_vector_codes", "op12_importance_resampling", "op13_nearest_vectors"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from scriptorium.llm import queries
    from tests.conftest import SF

    database = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.queries()[name](spark, SF)
    asked = database.execute(queries.oracle_sql()[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(got.columns)
    in_order = sorted(names)
    expected = sorted(str([str(row[names.index(c)]) for c in in_order]) for row in asked.fetchall())
    assert sorted(str([str(row[c]) for c in in_order]) for row in got.collect()) == expected
