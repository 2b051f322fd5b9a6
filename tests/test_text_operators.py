import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import dictionary, features, gather, intervals, readability, speech, vectors
from sheaf.sources import files


# ---- words and speakers

def walked(words, speakers, longest=50):
    """Realignment by walking from each change to both ends of its sentence."""
    out = list(speakers)
    ends = lambda k: words[k][-1] in ".?!"
    k = 0
    while k < len(words):
        if k < len(words) - 1 and out[k] != out[k + 1] and not ends(k):
            a = k
            while a > 0 and k - a < longest and out[a - 1] == out[a] and not ends(a - 1):
                a -= 1
            if a == 0 or ends(a - 1):
                room, b = longest - k + a - 1, k
                while b < len(words) - 1 and b - k < room and not ends(b):
                    b += 1
                if b == len(words) - 1 or ends(b):
                    said = out[a : b + 1]
                    counts = Counter(said)
                    best = max(said, key=lambda s: (counts[s], -said.index(s)))
                    if counts[best] >= len(said) // 2:
                        out[a : b + 1] = [best] * len(said)
                        k = b
        k += 1
    return out


def test_realignment_like_a_walk():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(1, 25)
        words = [rng.choice(["a", "b", "c.", "d?", "e"]) for _ in range(n)]
        speakers, who = [], "A"
        for _ in range(n):
            who = rng.choice("ABC") if rng.random() < 0.4 else who
            speakers.append(who)
        longest = rng.choice([2, 3, 5, 50])
        assert speech.realign(words, speakers, longest) == walked(words, speakers, longest), (words, speakers, longest)
    assert speech.realign(["a", "b", "c", "d."], ["A", "B", "C", "D"]) == ["A", "B", "C", "D"]
    assert speech.realign([], []) == []


def test_utterances(spark):
    got = speech.utterances(["Hi", "Dr", "J.", "Smith.", "Well...", "yes", "So?", "ok"], list("AAAAAAAB"), list(range(8)), list(range(1, 9)))
    assert [(s, a, b, t) for s, a, b, t in got] == [("A", 0, 4, "Hi Dr J. Smith. "), ("A", 4, 7, "Well... yes So? "), ("B", 7, 8, "ok ")]
    assert speech.utterances(["x"], ["B"], [5], [6], ("A", 1, 2)) == [("A", 1, 2, ""), ("B", 5, 6, "x ")]
    assert speech.utterances(["x"], ["A"], [5], [6], ("A", 1, 2)) == [("A", 1, 6, "x ")]
    words = spark.createDataFrame([("f", 0, "hi", "A", 3.0, 4.0), ("g", 0, "no", "B", 1.0, 2.0)], "item string, o int, word string, speaker string, start double, end double")
    turns = spark.createDataFrame([("f", "A", 2.5, 9.0), ("f", "B", 10.0, 11.0)], "item string, speaker string, start double, end double")
    rows = sorted(tuple(r) for r in speech.speaker_utterances(words, "item", "o", turns).collect())
    assert rows == [("f", 1, "A", 2.5, 4.0, "hi "), ("g", 1, "B", 1.0, 2.0, "no ")]


def test_untimed_words_are_merged(spark):
    rng = random.Random(2)
    rows, want = [], []
    for item in range(40):
        words, t = [], 1.0
        for k in range(rng.randint(1, 9)):
            timed = rng.random() < 0.6
            words.append((item, k, f"w{k}", t if timed else None, t + 0.5 if timed else None))
            t += 1
        rows += words
        k, before = 0, None
        while k < len(words):
            if words[k][3] is not None:
                want.append(words[k])
                before, k = words[k][4], k + 1
                continue
            j = k
            while j < len(words) and words[j][3] is None:
                j += 1
            start = 0.0 if before is None else before
            end = words[j][3] if j < len(words) else 99.0 if j - k > 1 else start
            want.append((item, k, " ".join(w[2] for w in words[k:j]), start, end))
            before, k = end, j
    df = spark.createDataFrame(rows, "item int, o int, word string, start double, end double")
    got = intervals.merge_untimed(df, "item", "o", final=F.lit(99.0)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


# ---- dictionaries

def plain_hits(words, terms):
    total = 0
    for w in words:
        total += any(w.startswith(t[:-1]) if t.endswith("*") else w == t for t in terms if " " not in t)
    for t in (t for t in terms if " " in t):
        part, k = t.rstrip("*").split(), 0
        while k + len(part) <= len(words):
            run = words[k : k + len(part)]
            hit = run[:-1] == part[:-1] and (run[-1].startswith(part[-1]) if t.endswith("*") else run[-1] == part[-1])
            total += hit
            k += len(part) if hit else 1
    return total


def test_coding_against_plain_counts(spark):
    rng = random.Random(3)
    vocabulary = ["go", "going", "gone", "stop", "stopped", "a", "an", "the", "end"]
    terms = [*vocabulary, "go*", "st*", "the end", "a a", "the go*", "stop the end"]
    lexicons = [dictionary.Lexicon("x y", {"one": rng.sample(terms, 6), "two": rng.sample(terms, 5), "none": []}), dictionary.Lexicon("z", {"all": terms})]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = dictionary.code(df, lexicons, relative=False, retain_captures=True).orderBy("id")
    assert out.columns == ["id", *dictionary.header(lexicons), "captures"]
    for r, text in zip(out.collect(), texts):
        words = text.split()
        for lex in lexicons:
            every = sorted({t for c in lex.categories.values() for t in c})
            assert r[f"{lex.prefix}__Dic"] == plain_hits(words, every)
            for name, own in lex.categories.items():
                assert r[f"{lex.prefix}__{name}"] == plain_hits(words, own)
                assert sum(r["captures"].get(f"{lex.prefix}__{name}", {}).values()) == plain_hits(words, own)


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.dic").write_text("%\n1\tpos\n%\ngood\t1\n")
    (tmp_path / "a.csv").write_text("term,neg\nbad*,X\n")
    (tmp_path / "c.txt").write_text("no")
    folder, one = str(tmp_path), str(tmp_path / "sub" / "b.dic")
    assert [p.rsplit("/", 1)[1] for p in dictionary.expand_paths([one, folder, one])] == ["b.dic", "a.csv"]
    with pytest.raises(ValueError):
        dictionary.expand_paths([str(tmp_path / "c.txt")])
    with pytest.raises(FileNotFoundError):
        dictionary.expand_paths([str(tmp_path / "none")])
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        dictionary.expand_paths([str(tmp_path / "empty")])
    head, row = dictionary.code_text(spark, "Good, badly!", dictionary.load_lexicons([one, folder]), text_id="t", relative=False)
    assert head == ["text_id", *dictionary.GLOBALS, "b__Dic", "b__pos", "a__Dic", "a__neg"]
    assert dict(zip(head, row)) == {"text_id": "t", "WC": 2, "BigWords": 0, "Numbers": 0, "AllPunct": 2, "Period": 0, "Comma": 1, "QMark": 0, "Exclam": 1, "Apostro": 0,
                                    "b__Dic": 1, "b__pos": 1, "a__Dic": 1, "a__neg": 1}
    with_marks = dictionary.code(spark.createDataFrame([("Good, bad!",)], "text string"), dictionary.load_lexicons([one]), relative=False, drop_punct=False).first()
    assert with_marks["WC"] == 4


# ---- vectors

@pytest.fixture
def by_letters():
    """A stand-in for an encoder: counts of a few letters."""
    return lambda said: __import__("numpy").array([[s.lower().count(c) + 0.5 for c in "aeio"] for s in said])


def test_mean_pool_of_any_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k % 7) if k % 11 else None, "x" if k % 2 else None, [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=rng.integers(0, 5))] if k % 13 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, h string, v array<double>").repartition(5)
    got = {(r["g"], r["h"]): r["v"] for r in vectors.mean_pool(df, ["g", "h"], "v", normalize=False, held=3).collect()}
    want = {}
    for g, h, v in rows:
        for d, x in enumerate(v or []):
            want.setdefault((g, h), {}).setdefault(d, []).append(x)
    assert set(got) == set(want)
    for key, by in want.items():
        for d, xs in by.items():
            xs = [x for x in xs if x is not None]
            assert got[key][d] == (pytest.approx(np.mean(xs)) if xs else None)


def test_sentence_embeddings_and_archetypes(spark, tmp_path, by_letters):
    texts = ["One here. Two over there! And so on", "", None, "Aaa"]
    df = spark.createDataFrame([(str(k), t, f"s{k}") for k, t in enumerate(texts)], "text_id string, text string, who string")
    out = vectors.sentence_embeddings(df, by_letters, pass_through=["who", "nope"], batch=2).orderBy("text_id").collect()
    parts = by_letters(["One here.", "Two over there!", "And so on"]).mean(axis=0)
    assert out[0]["vector"] == pytest.approx((parts / np.linalg.norm(parts)).tolist()) and out[1]["vector"] is None and out[2]["vector"] is None
    assert out[0]["who"] == "s0" and out[0]["nope"] == ""
    each = vectors.sentence_vectors(df, by_letters).where("text_id = '0'").orderBy("sentence").collect()
    assert [(r["sentence"], r["wc"]) for r in each] == [(1, 2), (2, 3), (3, 3)]
    (tmp_path / "my arch.csv").write_text("name,sentence\nwarm,aa ee\nwarm,a\ncold,io io\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("name,sentence\nonly,oo\n")
    paths = vectors.archetype_paths([str(tmp_path), str(tmp_path / "b.csv")])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["b.csv", "my arch.csv"]
    blocks = {vectors.file_prefix(p): vectors.load_archetypes(p) for p in paths}
    assert blocks == {"b": {"only": ["oo"]}, "my_arch": {"warm": ["aa ee", "a"], "cold": ["io io"]}}
    scored = vectors.score_archetypes(df, blocks, by_letters, rounding=None, fisher_z=True).orderBy("text_id").collect()
    assert scored[0].__fields__ == ["text_id", "WC", "b__only", "my_arch__warm", "my_arch__cold"]
    said = by_letters(["One here.", "Two over there!", "And so on"])
    warm, cold = by_letters(["aa ee", "a"]).mean(axis=0), by_letters(["io io"])[0]
    off = (warm + cold) / 2
    cosine = [(v - off) @ (warm - off) / np.linalg.norm(v - off) / np.linalg.norm(warm - off) for v in said]
    assert scored[0]["WC"] == 8 and scored[0]["my_arch__warm"] == pytest.approx(np.average(np.arctanh(cosine), weights=[2, 3, 3]))
    assert scored[1]["WC"] == 0 and scored[1]["b__only"] == 0
    with pytest.raises(FileNotFoundError):
        vectors.archetype_paths([str(tmp_path / "none")])


def test_embedding_windows(spark):
    df = spark.createDataFrame([("a", 100), ("b", 20), ("c", 0)], "path string, n long")
    rows = [tuple(r) for r in intervals.embedding_windows(df, F.col("n"), 10, window_s=3, hop_s=1.5).orderBy("path", "segment").select("path", "segment", "win_start", "win_end").collect()]
    assert rows == [("a", 0, 0, 30), ("a", 1, 15, 45), ("a", 2, 30, 60), ("a", 3, 45, 75), ("a", 4, 60, 90), ("a", 5, 75, 100), ("b", 0, 0, 20), ("c", 0, 0, 0)]
    loud = spark.createDataFrame([("a", 0, 5), ("a", 20, 55), ("b", 3, 9)], "path string, a long, b long")
    rows = [tuple(r) for r in intervals.embedding_windows(df, F.col("n"), 10, intervals=loud, window_s=3, least_s=1).orderBy("path", "segment").select("path", "segment", "win_start", "win_end").collect()]
    assert rows == [("a", 0, 20, 50), ("b", 0, 0, 20), ("c", 0, 0, 0)]


# ---- readability

def test_consensus_and_first_hundred_words(spark):
    text = " ".join(["Easy words here now."] * 25) + " " + " ".join(["incomprehensibilities"] * 300)
    row = readability.readability(spark.createDataFrame([(1, text)], "id int, text string")).first()
    assert row["linsear_write_formula"] == pytest.approx(((100 * 1) / 25 - 2) / 2)
    grades = []
    half = lambda x: int(np.floor(x + 0.5) if x >= 0 else np.floor(x - 0.5))
    for k, name in enumerate(["flesch_kincaid_grade", "smog_index", "coleman_liau_index", "automated_readability_index", "dale_chall_readability_score", "linsear_write_formula", "gunning_fog"]):
        grades += [half(row[name]), int(np.ceil(row[name]))]
        if k == 0:
            ease = row["flesch_reading_ease"]
            grades += next((g for a, b, g in [(90, 100, [5]), (80, 90, [6]), (70, 80, [7]), (60, 70, [8, 9]), (50, 60, [10]), (40, 50, [11]), (30, 40, [12])] if a <= ease < b), [13])
    best = Counter(grades).most_common(1)[0][0]
    assert row["text_standard"].startswith(str(best - 1)) and f"and {best}" in row["text_standard"] and row["readability_consensus"] == row["text_standard"]
    simple = readability.readability(spark.createDataFrame([(1, "The cat sat.")], "id int, text string"), easy_words=["the", "cat"]).first()
    assert simple["difficult_words"] == 1 and readability.syllables("make") == 1 and readability.syllables("table") == 1 and readability.syllables("banana") == 3


# ---- tables

def test_first_and_last_follow_an_order(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, None), ("a", 2, 7.0), ("b", 1, None)], "g string, o int, x double").repartition(3)
    plan = features.AggregationPlan(["g"], stats=["first", "last"], include_regex="^x$", order_by=["o"])
    rows = {r["g"]: (r["x__first"], r["x__last"]) for r in features.aggregate_features(df, plan).collect()}
    assert rows == {"a": (7.0, 1.0), "b": (None, None)}
    plain = features.aggregate_features(spark.createDataFrame([("a", 3.0), ("a", 1.0)], "g string, x double").coalesce(1), features.AggregationPlan(["g"], stats=["first", "last"])).first()
    assert (plain["x__first"], plain["x__last"]) == (3.0, 1.0)


def test_row_ids_over_many_tasks(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("row")).repartition(7)
    got = gather.with_row_ids(df, ["k"])
    assert got.columns == ["k", "row", "row_id"] and {(r["k"], r["row_id"]) for r in got.collect()} == {(k, f"row_{k + 1}") for k in range(5000)}
    assert gather.with_row_ids(df.where("false"), ["k"]).count() == 0


def test_found_files_and_written_files(spark, tmp_path):
    for n in ("a.3gp", "b.m2ts", "c.oga", "d.heic", "e.tgz", "f.WAV"):
        (tmp_path / n).write_bytes(b"")
    names = lambda found: [f.rsplit("/", 1)[-1] for f in found]
    assert names(files.find_files(str(tmp_path))) == ["a.3gp", "b.m2ts"]
    assert names(files.find_files(str(tmp_path), file_type="any")) == ["a.3gp", "b.m2ts", "c.oga", "d.heic", "f.WAV"]
    assert names(files.discover_inputs(str(tmp_path), "video")) == ["a.3gp"] and names(files.discover_inputs(str(tmp_path), "audio")) == ["f.WAV"]
    assert len(files.discover_inputs(str(tmp_path))) == 6
    df = spark.createDataFrame([("1", 'a "b"\nc'), ("2", None)], "k string, t string").repartition(2)
    path = files.write_csv_file(df, str(tmp_path / "out" / "x.csv"))
    data = (tmp_path / "out" / "x.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbfk,t\n") and files.write_csv_file(df, path) == path
    back = {r["k"]: r["t"] for r in files.read_csv(spark, path).collect()}
    assert back == {"1": 'a "b"\nc', "2": None}


def test_missing_columns_are_an_error_at_once(spark, by_letters):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    lexicon = dictionary.Lexicon("d", {"c": ["a"]})
    for run in (lambda: dictionary.code(df, [lexicon], text_col="nope"), lambda: dictionary.code(df, [lexicon], keep=["nope"]), lambda: readability.readability(df, text_col="nope"),
                lambda: vectors.sentence_embeddings(df, by_letters), lambda: vectors.score_archetypes(df, {"a": {"b": ["c"]}}, by_letters), lambda: gather.gather_rows(df, ["nope"], [])):
        with pytest.raises(ValueError, match="not found"):
            run()
