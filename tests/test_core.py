import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.operators import dictionary, features, gather, intervals, lexical, readability, sound, speech, transcripts, vectors
from sheaf.plans import runner
from sheaf.sources import files, subtitles


def test_gather_modes(spark):
    df = spark.createDataFrame([(1, "a", "x", " "), (2, "a", "", None), (3, "b", "y", "z")], "n int, g string, p string, q string")
    rows = {r["text_id"]: r["text"] for r in gather.gather_rows(df, ["p", "q"], ["n"]).collect()}
    assert rows == {"1": "x  ", "3": "y z"}
    each = gather.gather_rows(df, ["p", "q"], ["n"], mode="separate")
    assert sorted((r["text_id"], r["source_col"], r["text"]) for r in each.collect()) == [("1", "p", "x"), ("1", "q", " "), ("3", "p", "y"), ("3", "q", "z")]
    groups = gather.gather_groups(df, ["p"], ["g"], ["n"]).collect()
    assert sorted((r["g"], r["text"], r["group_count"]) for r in groups) == [("a", "x", 1), ("b", "y", 1)]
    with pytest.raises(ValueError):
        gather.gather_rows(df, ["nope"], ["n"])


def test_row_ids_count_before_filters(spark):
    df = spark.createDataFrame([(k, "" if k % 2 else "t") for k in range(10)], "k int, t string").repartition(3)
    rows = gather.with_row_ids(df, ["k"]).where("t <> ''").orderBy("k").collect()
    assert [r["row_id"] for r in rows] == [f"row_{k + 1}" for k in range(0, 10, 2)]


def test_tokens_and_guards(spark):
    df = spark.createDataFrame([(1, "A1b, c! c"), (2, ""), (3, None), (4, "one")], "id int, text string")
    out = {r["id"]: r for r in lexical.lexical_richness(df, vocd=False).collect()}
    assert out[1]["ttr"] == pytest.approx(2 / 3) and out[1]["simpson_d"] == pytest.approx(2 / 6)
    for k in (2, 3):
        assert all(out[k][c] is None for c in ("ttr", "herdan_c", "yule_k", "mtld_0_72", "hdd_42"))
    assert out[4]["ttr"] == 1 and out[4]["herdan_c"] is None and out[4]["mtld_0_72"] == 1.0


def plain_factors(t, threshold):
    """Factors by cutting the text at the shortest prefix whose ratio is low enough."""
    found = 0.0
    while t:
        cut = next((n for n in range(1, len(t) + 1) if len(set(t[:n])) / n <= threshold), None)
        if cut is None:
            found += (1 - len(set(t)) / len(t)) / (1 - threshold)
            break
        found, t = found + 1, t[cut:]
    return found or 1.0


def test_only_the_metrics_asked_for(spark):
    df = spark.createDataFrame([(1, "a b a c", "x")], "id int, text string, n string")
    out = lexical.lexical_richness(df, metrics=["mattr", "ttr"], mattr_window=2)
    assert out.columns == ["id", "n", "ttr", "mattr_2"] and tuple(out.first()) == (1, "x", 0.75, 1.0)
    with pytest.raises(ValueError):
        lexical.lexical_richness(df, metrics=["nope"])


def test_sequence_metrics_against_definitions():
    rng = random.Random(5)
    for _ in range(30):
        t = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))]
        w = rng.randint(1, 20)
        want = None if len(t) < w else np.mean([len(set(t[k : k + w])) / w for k in range(len(t) - w + 1)])
        ids, kinds = lexical.numbered(t)
        got = lexical.window_means(ids, kinds, w)
        assert got == want or got == pytest.approx(want)
        n, draws = len(t), 5
        counts = [t.count(x) for x in set(t)]
        exact = None if draws > n else sum(1 - math.comb(n - k, draws) / math.comb(n, draws) for k in counts) / draws
        got = lexical.hypergeometric_diversity(counts, n, draws)
        assert got == exact or got == pytest.approx(exact)
    assert lexical.segment_means(list("ab" * 5), 10) is None and lexical.window_means([0, 1] * 5, 2, 10) == 0.2
    for _ in range(200):
        t = [rng.choice("abcdefghijkl"[: rng.randint(1, 12)]) for _ in range(rng.randint(1, 80))]
        got = lexical.diversity_length(*lexical.numbered(t), 0.72)
        assert got == pytest.approx((len(t) / plain_factors(t, 0.72) + len(t) / plain_factors(t[::-1], 0.72)) / 2)
    assert lexical.diversity_length([], 0, 0.72) is None and lexical.diversity_length([0, 1, 2], 3, 0.72) == 3
    assert lexical.vocabulary_d(["a"] * 50, 50, 10, 1, 42) is None
    words = [f"w{k % 40}" for k in range(80)]
    assert lexical.vocabulary_d(words, 50, 20, 2, 42) == lexical.vocabulary_d(words, 50, 20, 2, 42)


def test_sampled_diversity_draws_once_for_a_length(monkeypatch):
    rng = random.Random(3)

    def plain(toks, most, within, repeats, seed):
        draws, found = random.Random(seed), []
        for _ in range(repeats):
            ratios = {n: sum(len(set(draws.sample(toks, n))) / n for _ in range(within)) / within for n in range(35, most + 1)}
            errors = [sum((r - d / n * (math.sqrt(1 + 2 * n / d) - 1)) ** 2 for n, r in ratios.items()) for d in range(5, 201)]
            found.append(5 + errors.index(min(errors)))
        return sum(found) / len(found)

    for n in (51, 64, 277, 278, 511, 512, 513, 1300, 70000):  # sample() draws otherwise from 278 tokens on
        texts = [[f"w{int(rng.paretovariate(0.3)) % kinds}" for _ in range(n)] for kinds in (20, 400, 60000)]
        want = [plain(t, 50, 6, 2, 42) for t in texts]
        assert lexical.vocabulary_d(texts[0], 50, 6, 2, 42) == want[0]
        with monkeypatch.context() as m:
            m.setattr(lexical.random, "Random", None)  # texts of this length need no more draws
            assert [lexical.vocabulary_d(t, 50, 6, 2, 42) for t in texts] == want
            m.setattr(lexical, "MOST_MARKS", 0)
            assert [lexical.vocabulary_d(t, 50, 6, 2, 42) for t in texts] == want
    for n in (121, 1045, 1046):
        toks = [rng.randrange(90) for _ in range(n)]
        assert lexical.vocabulary_d(toks, 120, 5, 2, 7) == plain(toks, 120, 5, 2, 7)


def test_timestamps_and_sentences(spark):
    df = spark.createDataFrame([("01:02:03,004",), ("1:02:03.004",), ("x",), ("01:61:00,000",)], "s string")
    assert [r[0] for r in df.select(X.timestamp_ms(F.col("s"))).collect()] == [3723004, 3723004, None, None]
    one = spark.createDataFrame([(3723004,)], "ms long").select(X.format_ms(F.col("ms")), X.format_ms(F.col("ms"), ".")).first()
    assert tuple(one) == ("01:02:03,004", "01:02:03.004")
    got = spark.createDataFrame([("Hi there.  You? ok",)], "t string").select(X.sentences(F.col("t"))).first()[0]
    assert got == ["Hi there.", "You?", "ok"]


def test_features(spark):
    a = features.add_source(spark.createDataFrame([("k", "1", "t"), ("k", "nan", "u")], "source string, x string, text string"), "fa")
    b = features.add_source(spark.createDataFrame([("k", "3")], "source string, y string"), "fb")
    df = features.union_by_name([a, b])
    assert df.columns == ["source", "source.1", "x", "text", "y"]
    plan = features.AggregationPlan(["source.1"], per_file=True, stats=["mean", "count", "std"])
    rows = {r["source"]: r for r in features.aggregate_features(df, plan).collect()}
    assert rows["fa"]["x__mean"] == 1 and rows["fa"]["x__count"] == 1 and rows["fa"]["x__std"] is None and "text__mean" not in rows["fa"].asDict()
    per_key = features.AggregationPlan(["source"], per_file=False, stats=["sum"])
    assert [r["y__sum"] for r in features.aggregate_features(df, per_key).collect()] == [3.0]
    assert features.choose_columns(["a", "b", "ab"], include_regex="a", exclude_regex="^b", must_keep=["b"]) == ["b", "a", "ab"]
    with pytest.raises(ValueError):
        features.resolve_keys(["a"], ["z"])
    values = spark.createDataFrame([(x,) for x in [" 1.5 ", "1d", "nan", "1_0", "-2e3", "", None]], "s string")
    assert [r[0] for r in values.select(features.numeric(F.col("s"), "string")).collect()] == [1.5, None, None, None, -2000.0, None, None]


def test_weighted_mean(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 0.0, 9.0), ("b", 0.0, 5.0)], "g string, wc double, s double")
    assert {r["g"]: (r["wc"], r["s"]) for r in features.weighted_mean(df, ["g"], "wc", ["s"]).collect()} == {"a": (2, 1.0), "b": (0, 0.0)}


def test_word_speakers_match_a_pointer_walk(spark):
    rng = random.Random(3)
    turns, words, want = [], [], {}
    for item in range(30):
        t, own = 0, []
        for _ in range(rng.randint(1, 6)):
            t += rng.randint(0, 5)
            own.append((t, t + rng.randint(0, 8), rng.choice("ABC")))
            t = own[-1][1]
        turns += [(item, float(a), float(b), s) for a, b, s in own]
        times = sorted(rng.randint(0, 40) for _ in range(8))
        k = 0
        for n, a in enumerate(times):
            while k < len(own) - 1 and a > own[k][1]:
                k += 1
            words.append((item, item * 100 + n, float(a), float(a + 1)))
            want[item * 100 + n] = own[k][2]
    t = spark.createDataFrame(turns, "item int, turn_start double, turn_end double, speaker string")
    w = spark.createDataFrame(words, "item int, word_id long, word_start double, word_end double")
    got = {r["word_id"]: r["speaker"] for r in intervals.word_speakers(w, t, "item").collect()}
    turns_of = {}
    for i, a, b, s in turns:
        turns_of.setdefault(i, []).append((a, b, s))
    same = [k for k in want if len({s for a, b, s in turns_of[k // 100]}) == 1 or got[k] == want[k]]
    assert len(same) == len(want)


def test_merge_and_windows(spark):
    rows = [("f", 1, "A", 0, 100), ("f", 2, "A", 90, 200), ("f", 3, "B", 300, 320), ("f", 4, "A", 400, 300), ("f", 5, "A", 500, 900)]
    df = spark.createDataFrame(rows, "item string, pos int, who string, s long, e long")
    out = intervals.merge_turns(df, ["item"], ["pos"], "who", "s", "e", min_dur=50, length=F.lit(800)).orderBy("segment").collect()
    assert [(r["who"], r["s"], r["e"]) for r in out] == [("A", 0, 200), ("A", 500, 800)]
    rng = random.Random(1)
    for _ in range(5):
        n, win, hop = rng.randint(1, 60), rng.randint(1, 20), rng.randint(1, 20)
        want, s = [], 0
        while True:
            want.append((s, min(n, s + win)))
            if s + win >= n or s + hop >= n:
                break
            s += hop
        got = intervals.fixed_windows(spark.createDataFrame([(n,)], "n long"), F.col("n"), win, hop).orderBy("win_start").collect()
        assert [(r["win_start"], r["win_end"]) for r in got] == want


def test_subtitles_round_trip(spark, tmp_path):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n00:00:03,000 --> 00:00:04,000\nok\n"
    vtt = "WEBVTT x\n\nNOTE no\n\nid\n00:00:01.000 --> 00:00:02.500 align:start\nHello\n"
    assert [c[1:] for c in subtitles.parse_srt(srt)] == [(1000, 2500, "Hello\nthere"), (3000, 4000, "ok")]
    assert subtitles.parse_vtt(vtt) == [(None, 1000, 2500, "Hello")]
    with pytest.raises(ValueError):
        subtitles.parse_srt("1\nnonsense\n")
    (tmp_path / "a.srt").write_text(srt)
    (tmp_path / "b.vtt").write_text(vtt)
    cues = subtitles.read_subtitles(spark, str(tmp_path))
    assert cues.count() == 3
    back = {r["path"].rsplit("/", 1)[1]: r["content"] for r in subtitles.to_lines(cues, "srt").collect()}
    assert [c[1:] for c in subtitles.parse_srt(back["a.srt"])] == [c[1:] for c in subtitles.parse_srt(srt)]
    web = {r["path"].rsplit("/", 1)[1]: r["content"] for r in subtitles.to_lines(cues, "vtt").collect()}
    assert [c[1:] for c in subtitles.parse_vtt(web["b.vtt"])] == [(1000, 2500, "Hello")]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,source\n1,"two\nlines ""q"""\n', encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("y;z\n2;NA\n")
    (tmp_path / "t.txt").write_bytes(b"caf\xc3\xa9 \xff!")
    df, bad = files.gather_csvs(spark, str(tmp_path))
    rows = {r["source"]: r for r in df.collect()}
    assert rows["a"]["source.1"] == 'two\nlines "q"' and rows["b"]["y"] == "2" and rows["b"]["z"] is None and not bad
    assert [(r["text_id"], r["text"]) for r in files.read_texts(spark, str(tmp_path)).collect()] == [("t", "café !")]
    (tmp_path / ".h").mkdir()
    for n in ("B.mp4", "a.MKV", ".h/c.mp4", "d.wav"):
        (tmp_path / n).write_bytes(b"")
    assert [p.rsplit("/", 1)[1] for p in files.find_files(str(tmp_path))] == ["a.MKV", "B.mp4"]
    assert files.find_files(str(tmp_path), file_type="audio", absolute=False) == ["d.wav"]
    out = files.write_csv(df, str(tmp_path / "out"), single_file=True)
    assert files.write_csv(df, out) == out


def test_runner(tmp_path):
    runner.register("test.double", lambda x, n=2: x * n)
    runner.register("test.fail", lambda **k: 1 / 0)
    preset = {"vars": {"n": 3}, "steps": [
        {"scope": "item", "call": "test.double", "with": {"x": "{{input}}", "n": "{{var:n}}"}, "save_as": "d", "require": ["x"]},
        {"scope": "global", "call": "test.double", "with": {"x": "{{cwd}}-{{unknown}}", "n": 1}, "save_as": "g"},
        {"scope": "global", "call": "test.fail"}, {"scope": "global", "call": "test.double", "with": {"x": "never"}},
    ]}
    path = tmp_path / "m.json"
    m = runner.run_preset(preset, inputs=["a", ""], manifest_path=str(path))
    assert m["items"][0]["artifacts"] == {"d": "aaa"} and m["items"][1]["status"] == "error"
    assert m["globals"]["g"].endswith("{{unknown}}") and len(m["errors"]) == 1
    assert json.loads(path.read_text())["errors"]
    assert [runner.typed(x) for x in ("true", "null", "1", "1.5", "1e5")] == [True, None, 1, 1.5, "1e5"]
    with pytest.raises(KeyError):
        runner.resolve("os.system")


def test_dictionary_and_readability(spark, tmp_path):
    (tmp_path / "d.dic").write_text("%\n1\tpos\n2\tneg\n%\ngood\t1\nbad*\t2\nvery good\t1\n")
    lex = dictionary.load_lexicon(str(tmp_path / "d.dic"))
    df = spark.createDataFrame([(1, "Very good, badly bad."), (2, None)], "id int, text string")
    out = {r["id"]: r for r in dictionary.code(df, [lex], relative=False).collect()}
    assert (out[1]["d__pos"], out[1]["d__neg"], out[1]["WC"], out[2]["WC"]) == (2.0, 2.0, 4, 0)
    read = {r["id"]: r for r in readability.readability(df).collect()}
    assert read[1]["lexicon_count"] == 4 and read[1]["sentence_count"] == 1 and read[2]["flesch_reading_ease"] is None


def test_sound_and_speech(spark):
    x = np.sin(np.arange(16000) * 0.1).astype(np.float32) * 0.5
    rate, y = sound.decode(sound.encode(16000, x))
    assert rate == 16000 and np.abs(x - y).max() < 1e-3
    assert len(sound.mfcc_stats(y, rate)[0]) == 14
    assert speech.realign(["a", "b", "c.", "d"], ["A", "A", "B", "B"]) == ["A", "A", "A", "B"]
    rows = [("f", k, w, s, float(k), k + 0.5) for k, (w, s) in enumerate([("Hi", "A"), ("you.", "A"), ("Yes", "B")])]
    out = speech.speaker_utterances(spark.createDataFrame(rows, "item string, o int, word string, speaker string, start double, end double"), "item", "o")
    assert sorted((r["speaker"], r["text"]) for r in out.collect()) == [("A", "Hi you. "), ("B", "Yes ")]
    pooled = vectors.mean_pool(spark.createDataFrame([("a", [3.0, 0.0]), ("a", [3.0, 8.0])], "g string, v array<double>"), ["g"], "v").first()
    assert pooled["v"] == pytest.approx([0.6, 0.8])


def test_entry_survives_without_the_subpackage():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_metrics(spark, tmp_path):
    from sheaf.streaming.texts import stream_metrics

    spark.createDataFrame([(1, "a b a"), (2, "")], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    q = stream_metrics(stream, keep=["id"]).writeStream.format("memory").queryName("m1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["id"]: r["ttr"] for r in spark.table("m1").collect()} == {1: pytest.approx(2 / 3), 2: None}


def test_transcript_columns_and_labels(spark):
    assert transcripts.transcript_columns(["t0", "end_time", "spk", "from"]) == ("from", "end_time", "spk")
    with pytest.raises(ValueError):
        transcripts.transcript_columns(["t0", "t1"])
    df = spark.createDataFrame([(1, " Ann  B/é "), (2, ""), (3, None), (4, "  ")], "k int, n string")
    c = F.col("n")
    rows = {r["k"]: tuple(r)[1:] for r in df.select("k", transcripts.speaker_key(c), transcripts.file_label(c), transcripts.plain_label(c)).collect()}
    assert rows == {1: ("Ann__B_", "Ann B_é", "Ann_B"), 2: ("SPEAKER_0", "SPEAKER_0", "x"), 3: ("SPEAKER_0", "SPEAKER_0", "x"), 4: ("", "SPEAKER_0", "x")}


def test_valid_turns(spark):
    df = spark.createDataFrame([(1, "0.0005", "1"), (2, "x", "1"), (3, "2", "1"), (4, None, "1"), (5, "9", "12"), (6, "10.5", "12"), (7, "-1", "0.01")], "k int, a string, b string")
    rows = [tuple(r) for r in transcripts.valid_turns(df, "a", "b", unit="s", length=F.lit(10000)).select("k", "start_ms", "end_ms").orderBy("k").collect()]
    assert rows == [(1, 0, 1000), (5, 9000, 10000), (7, 0, 10)]
    with pytest.raises(ValueError):
        transcripts.valid_turns(df, "a", "b", unit="h")


def test_windows_of_empty_intervals(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 5, None), (3, 0, 7)], "k int, a int, b int")
    assert [tuple(r) for r in intervals.chopped_windows(df, "a", "b", 5, 2).select("k", "win_start", "win_end").collect()] == [(3, 0, 5), (3, 5, 7)]


def test_speaker_sounds_and_turn_acoustics(spark):
    rate, x = 1000, np.linspace(-0.5, 0.5, 3000).astype(np.float32)
    wavs = spark.createDataFrame([("r", bytearray(sound.encode(rate, x))), ("none", None)], "path string, content binary")
    rows = [("r", 0, 400, "A b"), ("r", 400, 900, "A b"), ("r", 900, 930, "C"), ("r", 1000, 9000, "C"), ("r", 5000, 6000, "A b"), ("lost", 0, 9, "Z"), ("none", 0, 9, "Z")]
    turns = spark.createDataFrame(rows, "path string, start_ms long, end_ms long, speaker string")
    found = {r["speaker"]: r for r in transcripts.speaker_sounds(wavs, turns, silence_ms=100).collect()}
    assert set(found) == {"A_b", "C"} and found["A_b"]["segments"] == 1
    for who, a, b in (("A_b", 0, 900), ("C", 900, 3000)):
        got_rate, y = sound.decode(bytes(found[who]["content"]))
        assert got_rate == rate and len(y) == b - a + 200 and not y[:100].any() and not y[-100:].any()
        assert np.abs(y[100:-100] - x[a:b]).max() < 1e-3
    each = transcripts.turn_acoustics(wavs, turns).orderBy("start_ms").collect()
    assert [(r["start_ms"], r["speaker"]) for r in each] == [(0, "A b"), (400, "A b"), (900, "C"), (1000, "C")]
    assert all(math.isfinite(r["loudness_db"]) for r in each)


def test_convert_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\nhi\n", encoding="utf-8")
    rows = subtitles.convert(spark, str(tmp_path / "a.srt"), "csv").collect()
    assert [(r["start_time"], r["end_time"], r["text"]) for r in rows] == [("1500", "2000", "hi")]
    assert subtitles.convert(spark, str(tmp_path / "a.srt"), "vtt").first()["content"].startswith("WEBVTT\n\n00:00:01.500 --> 00:00:02.000\nhi")
    with pytest.raises(ValueError):
        subtitles.convert(spark, str(tmp_path / "a.srt"), "doc")


def test_tables_of_few_row_groups_are_spread(spark, tmp_path):
    from sheaf.runtime import small, spread

    spark.range(2000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    out = spread(one)
    assert out.select(F.spark_partition_id()).distinct().count() == 3 * cores and sorted(r["id"] for r in out.collect()) == list(range(2000))
    spark.range(2000).repartition(2 * cores).write.parquet(str(tmp_path / "many"))
    many = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "many"))
    few = spark.read.parquet(str(tmp_path / "one")).where("id < 0")
    assert spread(few) is few and spread(many).count() == 2000
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().optimizedPlan().toString()
    assert hinted(one.join(small(one, 8, 16_000), "id")) and not hinted(one.join(small(one, 8, 15_999), "id"))
    assert hinted(one.join(small(one, F.lit(4)), "id")) and small(few, 8) is not None
