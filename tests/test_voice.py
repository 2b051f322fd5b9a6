import numpy as np
import pytest

from sheaf.operators import sound, voice

RATE = 16000


def buzz(hz, seconds=1.0, rate=RATE, jitter=0.0, shimmer=0.0, seed=1):
    """A pulse train with a soft decay after each pulse."""
    rng = np.random.default_rng(seed)
    x, at = np.zeros(int(seconds * rate) + 400), 10.0
    decay = np.exp(-np.arange(200) / 20) * np.cos(np.arange(200) * 0.8)
    while at < seconds * rate:
        k = int(round(at))
        x[k : k + 200] += (1 + shimmer * rng.uniform(-1, 1)) * decay
        at += rate / hz * (1 + jitter * rng.uniform(-1, 1))
    return (0.5 * x[: int(seconds * rate)] / np.abs(x).max()).astype(np.float32)


@pytest.mark.parametrize("hz", [90, 140, 220, 400])
def test_pitch_of_a_buzz(hz):
    times, f0, ratio = voice.pitch(buzz(hz), RATE)
    assert (f0 > 0).mean() > 0.9 and np.median(f0[f0 > 0]) == pytest.approx(hz, rel=0.02)
    assert np.median(np.diff(times)) == pytest.approx(0.01) and np.median(ratio) > 10
    noise = np.random.default_rng(2).normal(0, 0.1, RATE).astype(np.float32)
    _, f0, ratio = voice.pitch(noise, RATE)
    assert (f0 > 0).mean() < 0.2 and np.median(ratio) < 5
    assert not voice.pitch(np.zeros(RATE, np.float32), RATE)[1].any()


def test_intensity_follows_the_level():
    x = np.sin(2 * np.pi * 200 * np.arange(RATE) / RATE).astype(np.float32)
    times = np.array([0.3, 0.5, 0.7])
    one, half = voice.intensity(x, RATE, times), voice.intensity(x / 2, RATE, times)
    assert one == pytest.approx([10 * np.log10(0.5 / 4e-10)] * 3, abs=0.05) and one - half == pytest.approx([6.02] * 3, abs=0.01)


def test_formants_of_two_resonances():
    rng = np.random.default_rng(3)
    rate, y = 11000, rng.normal(0, 1, 22000)
    for k in range(1, len(y)):  # a source that falls off as a voice does
        y[k] += np.exp(-2 * np.pi * 50 / rate) * y[k - 1]
    for hz, width in ((700, 80), (1800, 120), (3000, 150), (4200, 200)):
        r = np.exp(-np.pi * width / rate)
        a1, a2 = 2 * r * np.cos(2 * np.pi * hz / rate), -r * r
        out = np.zeros(len(y))
        for k in range(2, len(y)):
            out[k] = y[k] + a1 * out[k - 1] + a2 * out[k - 2]
        y = out
    found = np.nanmedian(voice.formants((y / np.abs(y).max()).astype(np.float32), rate, np.arange(0.2, 1.8, 0.05)), axis=0)
    assert found == pytest.approx([700, 1800, 3000, 4200], rel=0.1)


def test_jitter_and_shimmer_grow():
    steady, shaken = (voice.summary(buzz(120, jitter=j, shimmer=s), RATE) for j, s in ((0, 0), (0.03, 0.2)))
    assert steady["jitter_local"] < 0.01 < shaken["jitter_local"] < 0.06 and steady["shimmer_local"] < 0.03 < shaken["shimmer_local"]
    assert steady["jitter_ddp"] == pytest.approx(3 * steady["jitter_rap"]) and shaken["shimmer_dda"] == pytest.approx(3 * shaken["shimmer_apq3"])
    noise = voice.cepstral_peak(np.random.default_rng(4).normal(0, 0.1, RATE).astype(np.float32), RATE)
    assert steady["cpps"] > noise + 3 and set(steady) == set(voice.SUMMARY)
    assert steady["f0_mean"] == pytest.approx(120, rel=0.02) and steady["silence_ratio"] < 0.1


def test_runs_pauses_and_padding():
    times = np.arange(6) * 0.01
    f0 = np.array([0, 100, 100, 0, 0, 100.0])
    assert np.allclose(voice.voiced_runs(times, f0), [(0.01, 0.025), (0.05, 0.055)])
    assert np.allclose(voice.voiced_runs(times, f0, 0.01), [(0.01, 0.025)])
    x = np.concatenate((np.zeros(8000), buzz(150, 0.5), np.zeros(4000), buzz(150, 0.5), np.zeros(64000)))
    runs = voice.loud_intervals(x, 30, 512, 128)
    assert len(runs) == 2 and abs(runs[0][0] - 8000) < 700 and abs(runs[1][1] - 28000) < 700
    found = voice.pauses(x, RATE, frame=512, hop=128)
    assert found["spir"] == pytest.approx(2, abs=0.3) and found["dur_med"] == pytest.approx(0.37, abs=0.08)
    assert voice.pauses(np.zeros(RATE), RATE)["spir"] == 0
    assert len(voice.padded(np.ones(10), RATE)) == round(6.4 / 75 * RATE) and len(voice.padded(np.ones(RATE), RATE)) == RATE


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(44100) / 44100).astype(np.float32)
    y = voice.resample(x, 44100, 16000)
    assert len(y) == 16000 and np.abs(y[200:-200] - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[200:-200]).max() < 0.01
    assert voice.resample(y, 16000, 16000) is y


def test_recordings_in_a_table(spark):
    rows = [("a", bytearray(sound.encode(RATE, buzz(130, 0.5)))), ("b", None), ("c", b"no sound"), ("d", bytearray(sound.encode(8000, np.zeros(40))))]
    files = spark.createDataFrame(rows, "path string, content binary")
    out = {r["path"]: r for r in voice.analyze(files, target_rate=16000).collect()}
    assert set(out) == {"a", "d"} and out["a"]["f0_mean"] == pytest.approx(130, rel=0.02) and out["d"]["f0_mean"] is None
    frames = voice.framewise(files, target_rate=16000).where("path = 'a'").orderBy("frame").collect()
    assert [r["frame"] for r in frames] == list(range(len(frames))) and len(frames) > 40
    assert np.median([r["f0_hz"] for r in frames if r["f0_hz"]]) == pytest.approx(130, rel=0.02)
