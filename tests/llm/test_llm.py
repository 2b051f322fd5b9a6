import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sheaf.llm import bytetokens, chroma, components, langid, licenses, linechunks, maxscore, packing, piecebpe, repair, simhash, toxicity

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, gone int, __x int"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), "x", "y", 1, None) for i, t, lang in rows], SCHEMA)


LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(60_000))
ROWS = [
    (3, "The cat sat.\nOn the mat, it sat.\nAll day long it sat.\nThen it left.", "en"), (1, None, None), (2, "", "en"), (4, "   \n\t ", None),
    (5, "The cat sat.\nOn the mat, it sat.\nAll day long it sat.\nThen it left.", "en"), (5, "The cat sat.\nOn the mat, it sat.\nAll day long it sat.\nThen it left.", "en"),
    (None, "Der Hund läuft über die Straße.", "de"), (7, LONG, "en"), (8, "12 34 !!", "en"), (9, "Released under the MIT License. Café 日本 👍", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# ---- op1

def library_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids, 0]


def test_byte_tokens_equal_the_library():
    rng = random.Random(1)
    coder = bytetokens.ByteTokens(BYTES, cache_words=50)
    parts = ["a", " ", "  ", "\n", " \n", "é", " ", "\x1c", "'s", "1", "#", "<|endoftext|>", "b ", " the", "日本", "👍", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(3000)]
    got = coder.encode(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tok.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_plain_words_equal_the_library():
    rng = random.Random(8)
    coder = bytetokens.ByteTokens(BYTES, cache_words=300)
    assert coder.plain
    parts = ["a", "Über", "ñ", "the", "ing", ".", ",", "&&&", "!?", "'", "'s", "_", "-", "\n", "\n\n", " ", " ", " ", "7", "<|endoftext|>"]
    for _ in range(4):  # later rounds meet words, and the words within them, in the caches
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
        want = [np.array(e.ids, "<u4").tobytes() for e in coder.tok.encode_batch(texts, add_special_tokens=False)]
        assert coder.encode(texts) == want


def test_another_tokenizer_goes_to_the_library_whole(tmp_path):
    import json

    data = json.loads(open(BYTES, encoding="utf-8").read())
    assert bytetokens.is_byte_level(BYTES)
    data["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    coder = bytetokens.ByteTokens(str(path))
    texts = ["the cat sat", "", None, " 'twas the night"]
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert not coder.cuts and coder.encode(texts) == want != bytetokens.ByteTokens(BYTES).encode(texts)


def test_damaged_rules_are_an_error():
    blob = bytearray(repair.shard_bytes([1], np.array([64]), np.tile(np.array([3, 4], "<u4"), 8), 10))
    shard = repair.Shard(bytes(blob))
    assert len(shard.rules) and shard.all_ids().tolist() == [3, 4] * 8
    shard = repair.Shard(bytes(blob))
    shard.rules = shard.rules.copy()
    shard.rules[0] = (10, 10)
    with pytest.raises(ValueError):
        shard.all_ids()


def test_compress_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    for size, kinds, first in ((0, 5, 50257), (1, 5, 50257), (5000, 4, 50257), (5000, 60000, 200_000), (20_000, 1, 50257)):
        ids = rng.integers(0, kinds, size).astype("<u4")
        cuts = sorted(rng.integers(0, size + 1, 3).tolist()) + [size]
        shard = repair.Shard(repair.shard_bytes([5, None, 7, 8], np.array(cuts), ids, first))
        assert (shard.all_ids() == ids).all() and len(shard.all_ids()) == size and shard.doc_ids == [5, None, 7, 8]
        for _ in range(20):
            a, n = int(rng.integers(0, size + 1)), int(rng.integers(0, 50))
            assert (shard.read(a, n) == ids[a : a + n]).all()
        assert (shard.document(1) == ids[cuts[0] : cuts[1]]).all()
    assert len(shard.low) < 30


def brute_pairs(seq):
    """Occurrences of each pair that do not overlap, counted from the left."""
    found, last = {}, {}
    for k, pair in enumerate(zip(seq, seq[1:])):
        if last.get(pair) != k - 1:
            found[pair], last[pair] = found.get(pair, 0) + 1, k
    return found


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(22)
    words = [rng.integers(0, 50_000, rng.integers(1, 9)) for _ in range(300)]
    for ids, least in ((np.concatenate([words[k] for k in rng.zipf(1.3, 8000) % 300]), 8), (rng.integers(0, 3, 20_000), 2), (np.tile(rng.integers(0, 50_000, 553), 90), 8), (np.concatenate([words[k] for k in rng.integers(0, 300, 3000)]), 5)):
        seq, rules, lengths = repair.compress(ids.astype("<u4"), 50257, least)
        assert max(brute_pairs(seq.tolist()).values(), default=0) < least
        flat = {k: [k] for k in range(50257)}
        for k, (a, b) in enumerate(rules.tolist()):
            flat[50257 + k] = flat[a] + flat[b]
        assert [x for s in seq.tolist() for x in flat[s]] == ids.tolist() and [len(flat[50257 + k]) for k in range(len(rules))] == lengths.tolist()
    # more rules than 16-bit symbols can name
    ids = np.repeat(np.arange(40_000, dtype="<u4").reshape(-1, 2), 8, axis=0)[rng.permutation(160_000)].ravel()
    shard = repair.Shard(repair.shard_bytes([1], np.array([len(ids)]), ids, 50257))
    assert len(shard.rules) >= 20_000 and len(shard.high) and (shard.all_ids() == ids).all()
    for _ in range(50):
        a, n = int(rng.integers(0, len(ids))), int(rng.integers(0, 300))
        assert (shard.read(a, n) == ids[a : a + n]).all()


def test_many_rows_of_one_id_are_dealt_to_several_tasks(spark, tmp_path):
    rows = [(None if k % 3 else 7, f"text {k % 50}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        repair.write_shards(df, BYTES, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(str(tmp_path / "s")).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()
    assert len(parts) == 4 and max(r["n"] for r in parts) < 2000
    got = repair.encode_documents(df, BYTES).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: i is not None)


def test_repair_query(docs, none, spark):
    got = repair.encode_documents(docs, BYTES, shard_ids=500).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted(((i, t) for i, t, _ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = library_ids(t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert repair.encode_documents(none, BYTES).count() == 0


# ---- op2

def test_chroma(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, 64).tolist()
    rows = [(1, base), (2, base), (3, [x + 1e-4 for x in base]), (4, None), (5, []), (6, [float("nan")] * 64), (None, base), (1, base), (7, rng.normal(0, 1, 64).tolist())]
    df = spark.createDataFrame(rows, "id long, media array<double>").withColumn("items", F.lit(1))
    out = chroma.recordings(df, id_col="id", media_col="media", decode=chroma.render).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["id"], r)
    assert by[2]["class_id"] == by[1]["class_id"] == 1 and by[None]["class_id"] == 1
    assert by[4]["n_items"] == by[5]["n_items"] == by[6]["n_items"] == 0 and by[4]["class_id"] is None
    assert by[7]["n_links"] == 0
    assert chroma.recordings(df.where("false"), id_col="id", media_col="media", decode=chroma.render).count() == 0


def test_shifted_sound_aligns(spark):
    rng = np.random.default_rng(6)
    rate, x = chroma.render(rng.normal(0, 1, 128).tolist())
    from sheaf.operators.sound import encode

    shift = 5 * chroma.HOP
    sounds = [(1, encode(rate, x)), (2, encode(rate, np.concatenate((x[shift:], 0.01 * rng.normal(0, 1, 100))))), (3, b"no wav"), (4, encode(rate, chroma.render(rng.normal(0, 1, 128).tolist())[1]))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in sounds], "id long, media binary")
    f = chroma.fingerprints(df, id_col="id", media_col="media")
    classes = f.where("length(items) > 0").select(F.col("id").alias("class_id"), "items")
    found = chroma.align(classes, most_error=0.15, least_votes=2, least_overlap=20).collect()
    assert [(r["a"], r["b"], r["offset"]) for r in found] == [(1, 2, 5)]
    items = {r["id"]: np.frombuffer(r["items"], "<u4") for r in f.collect()}
    for a, b in ((1, 2), (1, 4), (2, 4)):  # brute force over all offsets
        best = min(chroma.bit_error(items[a], items[b], o)[0] for o in range(-30, 31) if chroma.bit_error(items[a], items[b], o)[1] >= 20)
        assert (best <= 0.15) == ((a, b) == (1, 2))


def test_altered_sound_aligns_like_brute_force(spark):
    assert [chroma.extra_bits(n) for n in (0, 1000, 1 << 19, (1 << 19) + 1, 1 << 20, 1 << 21, 1 << 60)] == [0, 0, 0, 1, 3, 6, 14]
    rng = np.random.default_rng(11)
    cases = ((300, 0.0, 1.0, 0), (600, 0.0, 0.97, 0), (600, 0.1, 0.97, 0), (600, 0.2, 0.9, 0), (600, 0.1, 0.97, 6), (600, 0.2, 0.9, 6), (600, 0.1, 0.9, 14))
    for start, noise, least, extra in cases:  # cuts off the frame grid; keys as in larger tables
        rows, want = [], set()
        for k in range(0, 120, 2):
            rate, x = chroma.render(rng.normal(0, 1, 64).tolist())
            y = x[start:] + noise * rng.normal(0, 1, len(x) - start)
            a, b = (chroma.items(chroma.chroma(z, rate)) for z in (x, y))
            rows += [(k, bytearray(a.astype("<u4").tobytes())), (k + 1, bytearray(b.astype("<u4").tobytes()))]
            tries = [chroma.bit_error(a, b, o) for o in range(-20, 21)]
            if min(e for e, n in tries if n >= 20) <= 0.15:
                want.add((k, k + 1))
        classes = spark.createDataFrame(rows, "class_id long, items binary")
        found = {(r["a"], r["b"]) for r in chroma.align(classes, most_error=0.15, least_votes=2, least_overlap=20, extra=extra).collect()}
        assert len(want) >= 50 and len(want & found) >= least * len(want), (start, noise, len(want & found), len(want))


def test_links_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    rng, rows = np.random.default_rng(14), []
    for k in range(0, 120, 2):
        rate, x = chroma.render(rng.normal(0, 1, 64).tolist())
        y = x[600:] + 0.2 * rng.normal(0, 1, len(x) - 600)
        rows += [(k + j, bytearray(chroma.items(chroma.chroma(z, rate)).astype("<u4").tobytes())) for j, z in enumerate((x, y))]
    classes = spark.createDataFrame(rows, "class_id long, items binary")
    found = {(r["a"], r["b"]) for r in chroma.align(classes, most_error=0.15, least_votes=2, least_overlap=20).collect()}
    assert len(found) >= 54 and all(b == a + 1 for a, b in found)
    monkeypatch.setattr(chroma, "KEY_PLACES", 1)  # as in a table of many more places
    assert {(r["a"], r["b"]) for r in chroma.align(classes, most_error=0.15, least_votes=2, least_overlap=20).collect()} == found


def test_classes_of_many_members_meet_by_a_key_once(spark):
    rng = np.random.default_rng(15)
    rate, x = chroma.render(rng.normal(0, 1, 64).tolist())
    prints = {chroma.items(chroma.chroma(x + 0.02 * k * rng.normal(0, 1, len(x)), rate)).astype("<u4").tobytes() for k in range(60)}
    rows = [(k, bytearray(p), 30 * (k // 30)) for k, p in enumerate(sorted(prints))]  # left apart in two
    grouped = spark.createDataFrame(rows, "class_id long, items binary, group_id long")
    keyed = chroma._link_keys(chroma._grouped_places(grouped, chroma.APART), chroma.key_masks())
    assert keyed.count() == keyed.select("key", "g", "t").distinct().count()
    found = chroma.align(grouped, most_error=0.15, least_votes=2, least_overlap=20).collect()
    assert [(r["a"], r["b"], r["offset"]) for r in found] == [(0, 30, 0)]


def test_classes_that_align_without_an_offset_are_one(spark, monkeypatch):
    rng = np.random.default_rng(16)
    rate, x = chroma.render(rng.normal(0, 1, 64).tolist())
    sounds = [x + 0.03 * k * rng.normal(0, 1, len(x)) for k in range(6)] + [x[5 * chroma.HOP :]]
    df = spark.createDataFrame([(k, y.tolist()) for k, y in enumerate(sounds)], "id long, media array<double>")
    monkeypatch.setattr(chroma, "same_cuts", lambda classes, **_: classes.withColumn("group_id", F.col("class_id")))  # rounds that find nothing
    out = chroma.recordings(df, id_col="id", media_col="media", decode=lambda m: (11025, np.array(m))).collect()
    assert {r["id"]: (r["class_id"], r["n_links"]) for r in out} == {**{k: (0, 1) for k in range(6)}, 6: (6, 1)}


def test_copies_of_a_cut_are_one_class_and_no_link_is_lost(spark):
    rng = np.random.default_rng(12)
    melodies, rows = rng.normal(0, 1, (12, 64)), []
    for k, v in enumerate(melodies):
        rate, x = chroma.render(v.tolist())
        for copy in range(1 if k % 3 else 25):  # groups of near copies
            rows.append((100 * k + copy, chroma.items(chroma.chroma(x + 0.01 * copy**0.5 * rng.normal(0, 1, len(x)), rate))))
        rows.append((100 * k + 90, chroma.items(chroma.chroma(x[600:] + 0.1 * rng.normal(0, 1, len(x) - 600), rate))))  # another cut
    classes = spark.createDataFrame([(i, bytearray(x.astype("<u4").tobytes())) for i, x in rows], "class_id long, items binary")
    grouped = chroma.same_cuts(classes, most_error=0.15, least_votes=2, least_overlap=20)
    group = {r["class_id"]: r["group_id"] for r in grouped.collect()}
    assert set(group) == {i for i, _ in rows} and all(g <= i and g // 100 == i // 100 for i, g in group.items())
    assert sum(group[100 * k + c] == 100 * k for k in range(0, 12, 3) for c in range(25)) >= 0.9 * 100
    links = {(r["a"], r["b"]) for r in chroma.align(grouped, most_error=0.15, least_votes=2, least_overlap=20).collect()}
    want = lost = 0
    for n, (i, x) in enumerate(rows):
        for j, y in rows[:n]:
            tries = [chroma.bit_error(x, y, o) for o in range(-10, 11)]
            if min((e for e, m in tries if m >= 20), default=1) <= 0.15:
                want += 1
                lost += group[i] != group[j] and tuple(sorted((group[i], group[j]))) not in links
    assert want > 1200 and lost <= 0.02 * want, (want, lost)
    assert all(a // 100 == b // 100 for a, b in links)


def test_silence_and_held_sounds_do_not_vote(spark):
    rng = np.random.default_rng(13)
    hush = np.zeros(chroma.RATE * 12, np.float32)
    rate, x = chroma.render(rng.normal(0, 1, 64).tolist())
    held = np.sin(2 * np.pi * 440 * np.arange(chroma.RATE * 12) / chroma.RATE).astype(np.float32)
    sounds = [hush, hush[:-5 * chroma.HOP], np.concatenate((hush, x)), np.concatenate((hush, x, hush)), held, held[: -3 * chroma.HOP]]
    prints = [chroma.items(chroma.chroma(s, rate)) for s in sounds]
    places = [chroma.voting_places(p, chroma.APART)[0] for p in prints]
    assert len(places[0]) == len(places[1]) == 0 and len(prints[0]) > 50 and 10 < len(places[2]) < len(prints[2]) - 20 and len(places[4]) <= 4
    classes = spark.createDataFrame([(k, bytearray(p.astype("<u4").tobytes())) for k, p in enumerate(prints)], "class_id long, items binary")
    found = {(r["a"], r["b"], r["offset"]) for r in chroma.align(classes, most_error=0.15, least_votes=2, least_overlap=20).collect()}
    assert (2, 3, 0) in found and {(a, b) for a, b, _ in found} <= {(2, 3), (4, 5)}


def test_items_by_direct_sums():
    rng = np.random.default_rng(14)
    image = rng.random((40, 12)).astype(np.float32)
    got = chroma.items(image)
    assert len(got) == 40 - chroma.WIDTH + 1
    for t in range(len(got)):
        want = 0
        for kind, p, h, w in chroma.FILTERS:
            box = image[t : t + w, p : p + h].astype(float)
            half, side = np.zeros_like(box, dtype=bool), box.shape
            if kind == 1:
                half[:, h // 2 :] = True
            elif kind == 2:
                half[w // 2 :] = True
            elif kind == 3:
                half[: w // 2, h // 2 :] = half[w // 2 :, : h // 2] = True
            elif kind == 4:
                half[:, h // 3 : h - h // 3] = True
            elif kind == 5:
                half[w // 4 : w - w // 4] = True
            a, b = (side[0] * side[1] / 24, box.sum()) if kind == 0 else (box[half].sum(), box[~half].sum())
            level = sum(np.log1p(a) - np.log1p(b) > x for x in chroma.LEVELS)
            want = want << 2 | (0, 1, 3, 2)[level]
        assert int(got[t]) == want


# ---- op3

def brute_lines(rows):
    """The text of each (id, text) after pairs of lines that came before are taken out."""
    seen, out = {}, []
    for i, t in sorted({(i, t) for i, t, _ in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0)):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 1):
            two = tuple(lines[k : k + 2])
            if all(x.strip(" ") for x in two) and seen.setdefault(two, (i, t, k)) != (i, t, k):
                gone |= {k, k + 1}
        out.append(((i, t), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return dict(out)


def test_line_chunks(spark, docs, none):
    rng = random.Random(8)
    passage = "\n".join(f"shared line {k} {rng.random()}" for k in range(12))
    rows = list(ROWS) + [(100 + k, f"own {k}\n" * rng.randint(0, 3) + passage + f"\nmore {k}", "en") for k in range(8)]
    want = brute_lines(rows)
    df = table(spark, rows)
    for most in (32 << 20, 0):  # with broadcasts and without
        out = linechunks.dedup_lines(df, broadcast_bytes=most)
        assert out.columns == df.columns
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert got == sorted(((i, None if t is None else want[(i, t)]) for i, t, _ in rows), key=str)
    assert linechunks.dedup_lines(none).count() == 0


def test_shared_passages_go_whole_in_any_surroundings(spark):
    rng = random.Random(27)
    line = lambda: " ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(999)}" for _ in range(rng.randint(8, 14)))
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 4, 5, 9)]
    rows, own = [], {}
    for k in range(60):
        before, after = ([line() for _ in range(rng.randint(0, 4))] for _ in range(2))
        rows.append((k, "\n".join(before + passages[k % 6] + after), "en"))
        own[k] = "\n".join(before + after)
    got = {r["doc_id"]: (r["text"], r["n"]) for r in linechunks.dedup_lines(table(spark, rows), count_col="n").collect()}
    for k, text, _ in rows:
        assert got[k] == ((text, 0) if k < 6 else (own[k], len(passages[k % 6])))
    high, low = spark.range(1).select(linechunks.rolling_hash(F.lit(-5).cast("long"), F.lit(7).cast("long")).alias("h")).selectExpr("h >> 31", "h & 2147483647").first()
    bits = lambda x, k: (x % 2**64) >> 33 * (1 - k) & 2147483647
    assert (high, low) == tuple((bits(-5, k) * f + bits(7, k)) % 2147483647 for k, f in enumerate((16807, 48271)))


# ---- op4

def test_licenses(spark, docs, none):
    found = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.scan(docs, keep=["id"]).collect()}
    assert found[9] == (["mit-released"], ["mit"]) and found[1] == ([], []) and found[7] == ([], [])
    text = "You may not use this file except in compliance with the License. You may obtain a copy of the License at\nSee the License for the specific language governing permissions and limitations under the License."
    one = licenses.scan(table(spark, [(1, text, None), (2, "You may obtain a copy of the License at\nYou may not use this file except in compliance with the License.", None)]),
                        rules=[("r", ["apache2-not-use", "apache2-see"])])
    assert {r["doc_id"]: r["licenses"] for r in one.collect()} == {1: ["r"], 2: []}
    assert licenses.scan(none).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, rules=[("r", ["nope"])])
    assert all(licenses.normalized(s) == s for s in licenses.SENTENCES.values())


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "bsd-2-clause,bsd-3-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "gpl-3.0-or-later": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.""",
    "apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "gpl-2.0-or-later": """   This program is free software; you can redistribute it and/or modify
   it under the terms of the GNU General Public License as published by
   the Free Software Foundation; either version 2 of the License, or
   (at your option) any later version.

   This program is distributed in the hope that it will be useful,
   but WITHOUT ANY WARRANTY; without even the implied warranty of
   MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
   GNU General Public License for more details.""",
    "lgpl-2.1-or-later": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.""",
    "lgpl-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Lesser General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "agpl-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU Affero General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    "unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "zlib": """  This software is provided 'as-is', without any express or implied
  warranty. In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:""",
    "epl-2.0": """ * This program and the accompanying materials are made available under the
 * terms of the Eclipse Public License 2.0 which is available at
 * http://www.eclipse.org/legal/epl-2.0.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list
   of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this
   list of conditions and the following disclaimer in the documentation and/or other
   materials provided with the distribution.""",
    "mit,mpl-2.0": """// SPDX-License-Identifier: MIT
/* SPDX-License-Identifier: MPL-2.0 */""",
}


def test_wrapped_licenses(spark):
    texts = [*WRAPPED.values(), *(t.replace("\n", "\r\n") for t in WRAPPED.values())]
    texts += ["Released under the\n\nMIT License", "Not released under the MIT License", "Licensed under the Apache License, Version 2.0\nthe License"]
    found = [(r["sentence_ids"], ",".join(r["licenses"])) for r in licenses.scan(table(spark, [(k, t, None) for k, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert [x for _, x in found] == [*WRAPPED, *WRAPPED, "", "", "apache-2.0"]
    assert found[3][0] == ["apache2-the-license", "apache2-not-use", "apache2-copy-at", "apache2-as-is", "apache2-see"]
    assert found[-1][0] == ["apache2-licensed", "apache2-the-license"]


# ---- op5

def test_tree_is_first_fit():
    rng = random.Random(9)
    for _ in range(60):
        pieces = [(k, 0, rng.randint(1, 60)) for k in range(rng.randint(0, 40))]
        for most in (None, rng.randint(0, 12)):
            bins, left = packing.first_fit_decreasing(pieces, 64, most)
            room, want, none = [], [], []
            for p in sorted(pieces, key=lambda p: (-p[2], p[0])):
                at = next((k for k, r in enumerate(room) if r >= p[2]), len(room))
                if at == len(room) and at == most:
                    none.append(p)
                    continue
                if at == len(room):
                    room.append(64)
                    want.append([])
                room[at] -= p[2]
                want[at].append(p)
            assert ([b for b in bins if b], left) == (want, none)


def test_only_what_found_no_room_is_cut():
    rng = random.Random(10)
    for _ in range(40):
        tokens = [rng.randint(1, 300) for _ in range(rng.randint(1, 60))]
        packed = packing.pack_group(tokens, 64)
        totals = [sum(p[2] for p in s) for s in packed]
        assert packing.padding(packed, 64) == 0 and all(t == 64 or t & (t - 1) == 0 and t < 64 for t in totals)
        rest = [(d, n - n % 64, n % 64) for d, n in enumerate(tokens) if n % 64]
        bins, left = packing.first_fit_decreasing(rest, 64, sum(n for _, _, n in rest) // 64)
        placed = {p for b in bins for p in b}
        assert placed <= {p for s in packed for p in s} and sum(len(s) for s in packed) >= sum(n // 64 for n in tokens) + len(placed)
        whole = packing.pack_group(tokens, 64, cut=False)
        assert sorted(p for s in whole for p in s if p[2] < 64) == sorted(rest) and packing.padding(whole, 64) >= 0


def test_packing(spark, docs, none):
    for how in ({"group_docs": 3}, {"group_docs": 1, "task_groups": 1}):
        check_pieces(packing.pack_documents(docs, BYTES, **how).collect(), [(i, t) for i, t, _ in ROWS])
    assert packing.pack_documents(none, BYTES).count() == 0


def test_equal_rows_are_spread_over_groups(spark):
    out = packing.pack_documents(table(spark, [(1, "one two", "en")] * 600 + [(None, None, None)] * 600).repartition(4), BYTES, group_docs=100).collect()
    per = {}
    for r in out:
        per.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(per) == 12 and max(map(len, per.values())) < 200 and len(out) >= 1200


def check_pieces(out, rows):
    want = sorted((str(i), k, v) for i, t in rows for k, v in enumerate(library_ids(t)))
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(library_ids(t))
    covered = []
    for r in out:
        own = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert own
        covered += [(str(r["doc_id"]), r["start"] + k, own[0][r["start"] + k]) for k in range(r["length"])]
    assert sorted(covered) == want
    by = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 1024 and n & (n - 1) == 0 for n in by.values())


# ---- op6

def test_maxscore_against_brute_force(spark):
    rng = np.random.default_rng(10)
    vectors = rng.normal(0, 0.2, (400, 16))
    vectors[50:120] = vectors[50]
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)] + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 16), (1060, []), (1080, [0.5] * 4), (None, [1.0] * 16), (1100, [1e5] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    good = {i: np.pad(np.floor(64 * np.array(v)).astype(int), (0, 16 - len(v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(good):
        if q % 20 == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    for how in ({}, {"shard_rows": 64}, {"shard_rows": 100, "pass_bytes": 1000}):
        out = maxscore.top_k(df.repartition(3), **how)
        assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert maxscore.top_k(df.where("false")).count() == 0
    few = maxscore.top_k(df.where("vec_id in (0, 20)"))
    assert rows_of(few, "query_id", "rank", "vec_id") == [(0, 1, 20), (20, 1, 0)]


def test_every_row_of_a_repeated_id_is_a_query_of_its_own(spark):
    schema = "vec_id long, embedding array<double>"
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0])], schema)
    assert rows_of(maxscore.top_k(twice), "query_id", "rank", "vec_id", "score") == [(0, 1, 0, 4096), (0, 1, 0, 4096), (0, 2, 1, 4096), (0, 2, 1, 4096)]
    other = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    want = sorted([(0, 1, 1, 4096), (0, 2, 0, 0), (0, 3, 2, 0), (0, 1, 2, 4096), (0, 2, 0, 0), (0, 3, 1, 0)])
    for df in (other, other.orderBy(F.desc("vec_id")), other.repartition(3)):
        assert sorted(tuple(r) for r in maxscore.top_k(df).collect()) == want


def test_lists_are_traversed_probed_and_skipped():
    rng = np.random.default_rng(23)
    n, width, k = 4000, 48, 10
    sparse = np.where(rng.random((n, width)) < 0.05, rng.integers(1, 60, (n, width)), 0)
    dense = np.floor(64 * rng.normal(0, 0.12, (n, width))).astype(int)
    for values, most in ((sparse, 0.9), (dense, 0.9)):
        kind = maxscore.exact_kind(values, values)
        shard, total = maxscore.ShardSearch(np.arange(n), values, kind), 0
        for at in range(40):
            q = values[at].astype(kind)
            want = np.sort(values @ values[at])[::-1][:k]
            rows, scores = shard.search(q, k, -np.inf)
            assert np.sort(scores)[::-1][:k].tolist() == want.tolist() and (values[rows] @ values[at] == scores).all()
            total += sum(len(shard.postings(t, q[t])) for t in np.flatnonzero(q))
        assert shard.traversed < most * total and shard.probed > 0 and shard.skipped > 0.05 * total
        assert all(shard.search(values[at].astype(kind), k, 1e9)[0].size == 0 for at in range(40))  # nothing is essential
    for t in range(4):
        for w in (1.0, -1.0):
            added = w * values[shard.postings(t, w), t]
            assert (np.diff(added) <= 0).all() and len(added) == (w * values[:, t] > (w * values[:, t]).min()).sum()


# ---- op7

def sample(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language(spark, docs, none):
    rng = random.Random(12)
    vocab = {"en": "the of and with this there which ring ought".split(), "de": "der die und nicht schön straße über ich".split(), "fr": "le les des être qui où voilà nous".split()}
    rows = [(k, sample(rng, vocab[lang], 30), lang) for k, lang in enumerate(["en", "de", "fr"] * 40)]
    out = langid.identify(table(spark, rows + [(900, None, "en"), (901, "12 !", "de"), (None, "the of and with this", "en"), (902, LONG, None)])).collect()
    by = {r["doc_id"]: r for r in out}
    truth = {i: lang for i, _, lang in rows}
    held = [i for i in truth if by[i]["held_out"]]
    assert held and all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(by[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[900]["score"] == 0 and by[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(rows) + 4
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(table(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert langid.identify(docs).count() == len(ROWS)


def test_ngram_counts():
    codes, counts = langid.ngrams("Ab, ab")
    plain = " ab ab "
    want = {}
    for n in (1, 2, 3):
        for k in range(len(plain) - n + 1):
            g = plain[k : k + n]
            if g != " ":
                code = 0
                for c in g:
                    code = code << 21 | ord(c)
                want[code] = want.get(code, 0) + 1
    assert dict(zip(codes.tolist(), counts.tolist())) == want


def brute_profile(text, length):
    """The n-grams of a text by frequency, ties by their characters."""
    plain = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
    counts = {}
    for n in (1, 2, 3):
        for k in range(len(plain) - n + 1):
            if plain[k : k + n] != " ":
                counts[plain[k : k + n]] = counts.get(plain[k : k + n], 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))][:length]


def test_distances_against_plain_ranks():
    rng = random.Random(26)
    words = {"aa": "the of and with this there which ring ought".split(), "bb": "der die und nicht schön straße über ich".split(), "cc": "le les des être qui où voilà nous".split()}
    length = 40
    ranked = {lang: brute_profile(sample(rng, own, 80), length) for lang, own in words.items()}
    profiles = langid.Profiles(ranked, length)
    for _ in range(200):
        text = sample(rng, sum(words.values(), []) + ["x1", "Ça", "ŒUF"], rng.randint(1, 40))
        top = brute_profile(text, length)
        distance = {}
        for lang, known in ranked.items():
            distance[lang] = sum(abs(known.index(g) - k) if g in known else length for k, g in enumerate(top))
        best = min(sorted(distance), key=distance.get)
        assert profiles.predict(text) == (best, pytest.approx(1 - distance[best] / (length * len(top))))
    assert profiles.predict("12 ?") == ("und", 0.0)


# ---- op8

def brute_fingerprint(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    import xxhash

    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[top(a)] = top(b)
    return [top(k) for k in range(len(prints))]


def test_simhash(docs, none):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(ROWS)
    rows = [(i, brute_fingerprint(t)) for i, t, _ in ROWS]
    tops = brute_classes([f for _, f in rows])
    least = {}
    for (i, _), t in zip(rows, tops):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    want = sorted(((i, f"{f:016x}", least.get(t)) for (i, f), t in zip(rows, tops)), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_keep_all_components(spark):
    rng = random.Random(13)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            prints.add(base)
            for _ in range(rng.randint(1, 4)):
                base ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    want = {}
    for p, t in zip(prints, brute_classes(prints)):
        want.setdefault(t, set()).add(simhash._signed(p))
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    for block, finish, positions in ((4096, 250_000, None), (30, 0, 2), (4096, 250_000, 3), (30, 250_000, 3), (4096, 250_000, 4)):
        edges = simhash.links(df, block=block, positions=positions, broadcast_bytes=32 << 20 if block > 30 else 0)
        got = {}
        for r in components.components(edges, finish=finish).collect():
            got.setdefault(r["root"], set()).add(r["node"])
        assert {frozenset(v) for v in got.values()} == want and all(min(v) == k for k, v in got.items())


def test_any_four_positions_hold_a_set():
    from itertools import combinations

    for size, count in ((2, 7), (3, 20), (4, 70)):
        sets = [set(c) for c in simhash.position_sets(size)]
        assert len(sets) == count and all(any(s <= set(four) for s in sets) for four in combinations(range(8), 4))
    assert [simhash.set_size(n) for n in (10, 1 << 24, 1 << 30, 1 << 33)] == [2, 2, 3, 4]


def test_tally_counts_the_posting_lists():
    rng = np.random.default_rng(24)
    fps = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    fps[100:300] = fps[7] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    lists = simhash.PostingLists(fps)
    for x in fps[:20].tolist():
        want = [sum((x >> 8 * p & 255) == (y >> 8 * p & 255) for p in range(8)) for y in fps.tolist()]
        assert lists.tally(x).tolist() == want and simhash.matches(np.full(500, x, np.uint64), fps).tolist() == want
    near = [y for y in fps.tolist() if (y ^ int(fps[7])).bit_count() <= 4]
    assert sorted(lists.take(int(fps[7]), 4, 4)) == sorted(near) and lists.left == 500 - len(near)
    assert lists.take(int(fps[7]), 4, 4) == [] and lists.left == 500 - len(near)


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(500, 501), (501, 502), (500, 502), (9, 9)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges, finish=0).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 500: 500, 501: 500, 502: 500}


# ---- op9

def test_toxicity(spark, docs, none):
    rng = random.Random(14)
    clean = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("nd", "rt", "ll", "mp")]
    bad = ["vermin", "scumbag", "moronic"]
    rows, marks = [], []
    for k in range(400):
        words = [rng.choice(clean) for _ in range(60)]
        toxic = int(k % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(words), "en"))
        marks.append((k, toxic))
    extra = [(900, None, None), (901, "", None), (902, " \n", None), (None, "vermin", None), (903, LONG, None), (904, "you mor0nic scumbagg vermin " * 3, None)]
    labels = spark.createDataFrame(marks + [(901, None), (None, 1), (5555, 1)], "doc_id long, toxic int")
    out = toxicity.classify(table(spark, rows + extra), labels).collect()
    by = {r["doc_id"]: r for r in out}
    held = [k for k, _ in marks if by[k]["held_out"]]
    assert all(by[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _ in marks)
    truth = dict(marks)
    assert sum(by[k]["predicted"] == truth[k] for k in held) >= 0.95 * len(held)
    assert len(out) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in out)
    assert by[904]["predicted"] == 1 and by[901]["predicted"] == by[900]["predicted"] == 0
    assert toxicity.classify(none, labels).count() == 0
    unlabelled = toxicity.classify(docs, labels.where("toxic = 0")).collect()
    assert all(r["predicted"] == 0 for r in unlabelled)


def test_margin_equals_a_plain_forward_pass():
    rng = random.Random(25)
    clean = [f"{a}{b}nd" for a in "bdfgklm" for b in "aeiou"]
    sample = toxicity.Sample()
    for k in range(120):
        words = [rng.choice(clean) for _ in range(30)]
        if k % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["vermin", "Scumbag!"])
        sample.add(" ".join(words), int(k % 3 == 0))
    model = toxicity.fit(sample, 1 / 3)
    used, e, w, b = model.layers
    row = dict(zip(used.tolist(), e.astype(float)))

    def vector(word):
        bucket, _ = toxicity.word_buckets([toxicity.clean(word)])
        return np.mean([row.get(x, np.zeros(e.shape[1])) for x in bucket.tolist()], axis=0)

    def forward(text):
        words, best = text.split(), []
        starts = [0] if len(words) <= 8 else sorted({*range(0, len(words) - 7, 4), len(words) - 8})
        for a in starts:
            mean = np.zeros(e.shape[1])
            for k in range(a, min(a + 8, len(words))):
                if toxicity.clean(words[k]) not in [toxicity.clean(x) for x in words[max(0, k - 7) : k]]:
                    mean += vector(words[k]) / 8
            x = w.astype(float) @ mean + b
            best.append(x[1] - x[0])
        return max(best, default=float(b[1] - b[0]))

    texts = ["", "vermin", "verminn scumbags", *(" ".join(rng.choice([*clean, "vermin", "scumbag,", "other"]) for _ in range(n)) for n in (3, 8, 9, 12, 40, 41, 100))]
    scorer = toxicity.Scorer(model, cache_words=20)
    for _ in range(2):
        assert np.allclose(scorer.margins(texts), [forward(t) for t in texts], atol=1e-4)
    scorer.margins(["x" * 5000 + " " + "y" * 70])
    assert max(map(len, [*scorer.number, *scorer.cleaned]), default=0) <= toxicity.CACHED


def test_a_repeated_id_does_not_multiply_the_sample(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, share: held.append(sample))
    rows = [(1, f"text {k}", None) for k in range(500)] + [(2, "same", None)] * 300 + [(3, "x" * 40_000, None), (None, "t", None)]
    marks = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    toxicity.train(table(spark, rows).select("doc_id", "text"), marks)
    assert sorted(held[0].labels) == [0, 0, 0, 0, 1, 1]


# ---- op10

def test_pieces_equal_the_library(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coder = piecebpe.PieceCoder(PIECES, cache_words=40)
    rng = random.Random(15)
    parts = ["a", "th", "e", " ", "  ", "\n", "é", "▁", "\x00", "日本", "👍", "ing", "###", "12", "<s>", "<0x0A>", "ñ", "​", "xx", "o", "r", "_", "ﬁ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [LONG[:5000], "x" * 3000]
    for data, t in zip(coder.encode(texts), texts):
        ids = list(struct.unpack(f"<{len(data) // 4}I", data))
        assert ids == sp.encode(t, add_bos=True, add_eos=True)
        assert coder.decode(data) == sp.decode(ids)
    got = rows_of(piecebpe.encode_documents(docs, PIECES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t, _ in ROWS:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert piecebpe.encode_documents(none, PIECES).count() == 0


def test_decoded_text_comes_from_ids():
    coder = piecebpe.PieceCoder(PIECES)
    coder.ids["▁the"], coder.ids["é"] = coder.ids["▁of"], coder.ids["x"]  # wrong ids must show
    assert [coder.decode(i) for i in coder.encode(["go the way", "日 é\x00é the", ""])] == ["go of way", "日 é\x00x of", ""]


def test_words_without_spaces_leave_the_caches_small():
    coders = [piecebpe.PieceCoder(PIECES, cache_words=5000, cache_tests=20_000), bytetokens.ByteTokens(BYTES, cache_words=5000)]
    rng = random.Random(21)
    texts = ["".join(chr(rng.randrange(97, 123)) for _ in range(rng.randint(100, 400))) for _ in range(10_000)]
    for coder in coders:
        for at in range(0, len(texts), 100):
            coder.encode(texts[at : at + 100])
    one, two = coders
    held = [*one.young, *one.old, *one.runs, *two.heads, *two.tails, *two.old, *two.units]
    assert max(map(len, held), default=0) <= piecebpe.CACHED
    assert sum(map(len, one.tested)) <= 20_000 + 1000


def test_stray_bytes_decode_like_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coder = piecebpe.PieceCoder(PIECES)
    rng = random.Random(16)
    for _ in range(2000):
        ids = [rng.choice([3 + rng.randrange(256), 3 + 0xE6, 3 + 0x97, 3 + 0xA5, 1000 + rng.randrange(5000)]) for _ in range(rng.randint(1, 7))]
        assert coder.decode(struct.pack(f"<{len(ids)}I", *ids)) == sp.decode(ids), ids


# ---- pipeline

def one_of_each_class(rows):
    best = {}
    for row, t in zip(rows, brute_classes([brute_fingerprint(t) for _, t, _ in rows])):
        best.setdefault(t, []).append(row)
    return sorted(((i, t) for i, t, _ in (min(v, key=lambda r: (r[0] is None, r[0] or 0)) for v in best.values())), key=str)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    other = "an entirely different text about boats and rivers and the people who live there"
    rows = [(3, "some words that are here twice in a row", "en"), (5, "some words that are here twice in a row", "en"), (5, other, "en")]
    rows += [(None, "no id at all", "de"), (None, "no id at all", "fr"), (None, "no id, another text that nobody else has written so far", "de"), (3, "some words that are here twice in a row", "de")]
    for order in (rows, rows[::-1]):
        df = table(spark, order)
        for most in (32 << 20, 0):
            got = simhash.one_of_each(df, broadcast_bytes=most)
            assert got.columns == df.columns
            assert rows_of(got, "doc_id", "text") == one_of_each_class(rows)
    assert sorted(r["lang"] for r in got.collect()) == ["de", "de", "de", "en"]
    only = [(k, f"{w} boats and rivers", "en") for k, w in enumerate(["red", "blue", "grey"])]
    assert rows_of(simhash.one_of_each(table(spark, only)), "doc_id", "text") == one_of_each_class(only)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(17)
    clean = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeio" for c in ("nd", "rt", "ll", "mp")]
    rows, marks = list(ROWS), []
    for k in range(200, 400):
        words = [rng.choice(clean) for _ in range(60)]
        if k % 4 == 0:
            for at in (5, 25, 45):
                words[at] = rng.choice(["vermin", "scumbag"])
        rows.append((k, " ".join(words), "en"))
        marks.append((k, int(k % 4 == 0)))
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "line dedup", "near duplicates", "packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    toxic = cp.toxicity_stage(spark, now, str(tmp_path))
    assert toxic.columns == docs.columns
    left = {r["doc_id"] for r in toxic.collect()}
    truth = dict(marks)
    assert sum((k in left) == (truth[k] == 0) for k in truth) >= 0.97 * len(truth) and {3, 5, 7, 9, None} <= left
    lang = cp.language_stage(spark, now, str(tmp_path))
    assert lang.columns == docs.columns
    assert {r["doc_id"] for r in lang.collect()} == {i for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)}
    lines = cp.line_stage(spark, now, str(tmp_path))
    want = brute_lines(rows)
    assert rows_of(lines, "doc_id", "text", "n_chars") == sorted(((i, None if t is None else want[(i, t)], None if t is None else len(want[(i, t)])) for i, t, _ in rows), key=str)
    near = cp.near_duplicate_stage(spark, now, str(tmp_path))
    assert near.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str) == one_of_each_class(rows)
    for name, stage in cp.STAGES:
        assert stage(spark, now.where("false"), str(tmp_path)).count() == 0, name
    out = cp.run(spark, str(tmp_path))
    kept = docs
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
    check_pieces(out.collect(), [(r["doc_id"], r["text"]) for r in kept.collect()])
