import json
import wave

import numpy as np
import pytest

from sheaf import cli
from sheaf.operators import media, sound, speech, voice
from sheaf.plans import calls, runner
from sheaf.sources import files

RATE = 8000


def tone(hz, seconds, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    return (0.3 * sum(np.sin(2 * np.pi * hz * k * t) / k for k in (1, 2, 3))).astype(np.float32)


def rows_of(path):
    import csv

    with open(path, encoding="utf-8-sig", newline="") as f:
        return list(csv.DictReader(f))


# ---- media

@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav_of_all_sizes(bits):
    x = np.column_stack((tone(200, 0.1), -tone(300, 0.1)))
    rate, y = sound.decode_channels(sound.encode(RATE, x, bits))
    assert rate == RATE and y.shape == x.shape and np.abs(x - y).max() < 1e-4
    assert np.abs(sound.decode(sound.encode(RATE, x, bits))[1] - x.mean(axis=1)).max() < 1e-4


def test_conversion(spark):
    x = np.column_stack((tone(200, 0.5), tone(200, 0.5)))
    df = spark.createDataFrame([("a", bytearray(sound.encode(RATE, x, 24))), ("b", None), ("c", b"junk")], "path string, content binary")
    out = {r["path"]: r for r in media.convert(df, sample_rate=16000).collect()}
    assert set(out) == {"a", "c"} and out["c"]["content"] is None and out["c"]["error"]
    rate, y = sound.decode_channels(bytes(out["a"]["content"]))
    assert rate == 16000 and y.shape == (8000, 1) and out["a"]["error"] is None
    assert np.median(voice.pitch(y[:, 0], rate)[1]) == pytest.approx(200, rel=0.02)
    streams = media.split_streams(df.where("path = 'a'"), sample_rate=RATE).collect()
    assert [(r["path"], r["stream"]) for r in streams] == [("a", 0)]
    assert media.device("cpu") == "cpu" and media.device() in ("cpu", "cuda")


def test_segment_and_turn_embeddings(spark):
    x = np.concatenate((tone(200, 2), np.zeros(RATE, np.float32), tone(300, 1)))
    df = spark.createDataFrame([("a", bytearray(sound.encode(RATE, x))), ("b", None)], "path string, content binary")
    encode = lambda y, rate: None if len(y) < 100 or not y.any() else [len(y) / rate, 1.0]
    how = {"rate": RATE, "window_s": 1, "hop_s": 1}
    rows = media.segment_embeddings(df, encode, **how).collect()
    assert [(r["start_time"], r["end_time"], r["speaker"]) for r in rows] == [("0.000", "1.000", "SEGMENT_0"), ("1.000", "2.000", "SEGMENT_1"), ("3.000", "4.000", "SEGMENT_3")]
    one = media.segment_embeddings(df, encode, aggregate="mean", normalize=True, **how).collect()
    assert [(r["start_time"], r["end_time"], r["speaker"]) for r in one] == [("0.000", "4.000", "GLOBAL_MEAN")] and one[0]["vector"] == pytest.approx([2**-0.5] * 2)
    loud = media.segments(x, RATE, strategy="nonsilent", window_s=30)
    assert len(loud) == 2 and media.segments(np.zeros(10), RATE, strategy="nonsilent") == [(0, 10)]
    turns = spark.createDataFrame([("a", "500", "1500", "A"), ("a", "1500", "1500", "B"), ("a", "3000", "9000", None), ("a", "x", "9", "C"), ("b", "0", "1", "D")], "path string, start_time string, end_time string, speaker string")
    rows = media.turn_embeddings(df, turns, encode, rate=RATE, unit="ms").collect()
    assert [(r["start_time"], r["end_time"], r["speaker"], r["vector"][0]) for r in rows] == [("500", "1500", "A", 1.0), ("3000", "9000", "SPEAKER_0", 1.0)]
    with pytest.raises(ValueError):
        media.segments(x, RATE, strategy="nope")


# ---- calls

def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("id;t;u\n1;a b a;x\n2;c;\n")
    out = str(tmp_path / "out.csv")
    assert cli.main(["lexical", "--csv-path", str(tmp_path / "a.csv"), "--out-features-csv", out, "--text-cols", "t", "--id-cols", "id", "--metrics", "ttr"]) == 0
    assert [(r["text_id"], round(float(r["ttr"]), 3)) for r in sorted(rows_of(out), key=lambda r: r["id"])] == [("1", 0.667), ("2", 1.0)]
    assert cli.main(["gather", str(tmp_path / "a.csv"), "--out-csv", str(tmp_path / "g.csv"), "--text-cols", "t", "u", "--mode", "separate", "--joiner", "-"]) == 0
    assert sorted((r["text_id"], r["source_col"], r["text"]) for r in rows_of(tmp_path / "g.csv")) == [("row_1", "t", "a b a"), ("row_1", "u", "x"), ("row_2", "t", "c")]
    (tmp_path / "v.mp4").write_bytes(b"")
    capsys.readouterr()
    assert cli.main(["find", str(tmp_path), "--exclude-globs", "x*"]) == 0 and "v.mp4" in capsys.readouterr().out
    assert cli.main(["presets"]) == 0 and "conversation_video" in capsys.readouterr().out
    assert cli.main(["describe", "conversation_video"]) == 0 and "diarization" in capsys.readouterr().out
    assert cli.main(["describe", "nope"]) == 1


def test_tables_and_texts(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("good bad day.")
    (tmp_path / "d.dic").write_text("%\n1\tpos\n%\ngood\t1\n")
    out = calls.analyze_with_dictionaries(str(tmp_path / "o.csv"), dict_paths=[str(tmp_path / "d.dic")], txt_dir=str(tmp_path / "t"), relative_freq=False, retain_captures=True)
    assert [(r["text_id"], r["d__pos"], json.loads(r["captures"])) for r in rows_of(out)] == [("one", "1.0", {"d__Dic": {"good": 1}, "d__pos": {"good": 1}})]
    assert calls.analyze_with_dictionaries(out, dict_paths=[str(tmp_path / "d.dic")], txt_dir="not read") == out
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.csv").write_text("speaker,v\nA,1\nA,3\nB,NA\n")
    out = calls.feature_gather(str(tmp_path / "f"), str(tmp_path / "fa.csv"), aggregate=True, group_by=["speaker"], stats=["mean"])
    assert sorted((r["source"], r["speaker"], r["v__mean"]) for r in rows_of(out)) == [("x", "A", "2.0"), ("x", "B", "")]
    with pytest.raises(ValueError):
        calls.analyze_readability(str(tmp_path / "none.csv"))
    (tmp_path / "s.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\ncafé\n".encode("latin-1"))
    out = calls.convert_subtitles(str(tmp_path / "s.srt"), "csv", str(tmp_path / "s.csv"), encoding="latin-1")
    assert rows_of(out) == [{"start_time": "1000", "end_time": "2000", "text": "café"}]


def test_the_shipped_preset_runs_to_its_end(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "in").mkdir()
    talk = np.concatenate((tone(120, 1.0), np.zeros(RATE // 2, np.float32), tone(220, 1.0)))
    for name in ("one", "two"):
        (tmp_path / "in" / f"{name}.wav").write_bytes(sound.encode(RATE, talk))
    for folder, name, text in (("words", "w.dic", "%\n1\tpos\n%\ngood\t1\n"), ("archetypes", "a.csv", "name,sentence\nwarm,good day\ncold,bad night\n")):
        (tmp_path / "dictionaries" / folder).mkdir(parents=True)
        (tmp_path / "dictionaries" / folder / name).write_text(text)

    def said(frames):
        import pandas as pd

        for f in frames:
            for _ in f["path"]:
                yield pd.DataFrame({"start_time": [0, 1500], "end_time": [1000, 2500], "speaker": ["A", "B"], "text": ["Good day.", "Bad night, friend."]})

    speech.register_backend("diarization", said, "start_time bigint, end_time bigint, speaker string, text string")
    calls.register_encoder("sentences", lambda s: np.array([[x.lower().count(c) + 1.0 for c in "aeiou"] for x in s]))
    calls.register_encoder("sound", lambda y, rate: [float(np.abs(y).max()), 1.0])
    preset = runner.load_preset("conversation_video")
    assert len(preset["steps"]) == 14 and [s["scope"] for s in preset["steps"]].count("item") == 5
    m = runner.run_preset(preset, inputs=files.discover_inputs(str(tmp_path / "in"), "audio"), manifest_path=str(tmp_path / "m.json"), workers=2)
    assert not m["errors"] and all(i["status"] == "ok" for i in m["items"]), (m["errors"], [i["errors"] for i in m["items"]])
    assert len(m["items"][0]["artifacts"]["speaker_wavs"]) == 2
    texts = {(r["source"], r["speaker"]): r for r in rows_of(m["globals"]["dictionary_features"])}
    assert set(texts) == {(n, s) for n in ("one", "two") for s in "AB"} and float(texts["one", "A"]["w__pos"]) == 50
    voices = {(r["source"], r["speaker"]): float(r["f0_mean_mean"]) for r in rows_of(m["globals"]["acoustics_all"])}
    assert voices["one_summary_by_speaker", "A"] == pytest.approx(120, rel=0.05) and voices["two_summary_by_speaker", "B"] == pytest.approx(220, rel=0.05)
    assert len(rows_of(m["globals"]["sentence_gathered"])) == 4 and "e4__mean" in rows_of(m["globals"]["sentence_gathered"])[0]
    assert {r["speaker"] for r in rows_of(m["globals"]["sound_gathered"])} == {"A", "B"}
    assert "A: Good day." in (tmp_path / "transcripts" / "one" / "one.srt").read_text()


def test_sound_files(spark, tmp_path):
    path = tmp_path / "a.wav"
    path.write_bytes(sound.encode(RATE, tone(150, 1.0)))
    out = calls.analyze_vocal_acoustics(str(path), out_dir=str(tmp_path / "f"), include_framewise=True, target_sr=RATE)
    assert float(rows_of(out["summary"])[0]["f0_mean"]) == pytest.approx(150, rel=0.02) and len(rows_of(out["framewise"])) > 80
    assert list(rows_of(out["framewise"])[0]) == ["time_s", *voice.TRACKS]
    made = calls.convert_to_wav(str(path), str(tmp_path / "b.wav"), sample_rate=4000)
    with wave.open(made) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (4000, 1, 2)
    assert [p.rsplit("/", 1)[1] for p in calls.split_streams_to_wav(str(path), str(tmp_path / "s"))] == ["a_stream0.wav"]
    with pytest.raises(KeyError):
        calls.extract_sound_embeddings(str(path), model_name="none", out_dir=str(tmp_path))


def test_variables_and_calls(tmp_path):
    (tmp_path / "v.json").write_text('{"a": 1, "b": 2}')
    assert runner.merged({"a": 0, "c": 3}, runner.read_variables(str(tmp_path / "v.json")), ["b=x"]) == {"a": 1, "b": "x", "c": 3}
    assert runner.resolve("sheaf.text:analyze_readability") is calls.analyze_readability
    with pytest.raises(KeyError):
        runner.load_preset("nope")


def test_one_object_has_it_all(spark):
    from sheaf.session import Sheaf

    s = Sheaf(spark)
    for theme in ("gather", "text", "features", "intervals", "audio", "files", "calls"):
        assert all(callable(f) for f in vars(getattr(s, theme)).values())
    assert s.calls.find_files is calls.find_files
