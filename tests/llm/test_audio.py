import hashlib
import io
import wave as std_wave
import zlib

import numpy as np

from querent.llm import audio

SCHEMA = "doc_id long, text string, media string, n_bytes string"


def test_round_trip_and_columns(spark):
    texts = {1: "", 2: None, 3: "a" * 192, 4: "é" * 97, 5: "long text " * 30_000, 6: "a" * 192}
    df = spark.createDataFrame([(d, t, "m", "n") for d, t in texts.items()], SCHEMA)
    media = {r.doc_id: bytes(r.media) for r in audio.stored_media(df).collect()}
    for r in audio.audio_digests(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b" " * (192 if not raw else -len(raw) % 192)
        with std_wave.open(io.BytesIO(media[r.doc_id])) as f:
            assert (f.getnchannels(), f.getsampwidth(), f.getframerate()) == (1, 1, audio.RATE) and f.readframes(f.getnframes()) == want
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(want), len(want) + 44)
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
        assert r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest()
    got = {r.doc_id: r.feature for r in audio.audio_digests(df).collect()}
    assert got[3] == got[6] and got[1] == got[2] != got[3]
    assert audio.audio_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def tone(hertz, seconds, loud=100):
    t = np.arange(int(audio.RATE * seconds)) / audio.RATE
    return np.round(128 + loud * np.sin(2 * np.pi * hertz * t)).astype(np.uint8)


def test_resampling_keeps_low_tones_and_drops_high_ones():
    for hertz, kept in ((1000, True), (7000, False)):
        x = tone(hertz, 0.5)
        y = audio.resampled(x, 0, len(x) * audio.UP // audio.DOWN)
        rate = audio.RATE * audio.UP / audio.DOWN
        want = np.sin(2 * np.pi * hertz * np.arange(len(y)) / rate) * 100 / 128 if kept else np.zeros(len(y))
        assert len(y) == 6000 and np.abs(y - want)[200:-200].max() < 0.03


def slow_filter(held):
    """Zero-stuffing, one long filter, decimation: what the phases must add up to."""
    width = audio.TAPS * max(audio.UP, audio.DOWN) // 2
    t = np.arange(-width, width + 1)
    taps = np.sinc(t / max(audio.UP, audio.DOWN)) / max(audio.UP, audio.DOWN) * np.hanning(len(t) + 2)[1:-1] * audio.UP
    stuffed = np.zeros(len(held) * audio.UP)
    stuffed[:: audio.UP] = [(int(x) - 128) / 128 for x in held]
    return np.convolve(stuffed, taps)[width : width + len(stuffed)][:: audio.DOWN]


def slow_mels(sound, frames):
    """Log-mel energies by a discrete Fourier sum and triangles, frame by frame."""
    size, rate = 512, audio.RATE * audio.UP / audio.DOWN
    turn = np.exp(-2j * np.pi * np.outer(np.arange(size // 2 + 1), np.arange(audio.FRAME)) / size)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (k * mel(rate / 2) / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    out = np.zeros((frames, audio.MELS))
    for k in range(frames):
        part = sound[k * audio.HOP : k * audio.HOP + audio.FRAME]
        part = np.append(part, np.zeros(audio.FRAME - len(part)))
        power = np.abs(turn @ (part * np.hanning(audio.FRAME))) ** 2
        for m in range(audio.MELS):
            low, mid, high = edges[m : m + 3]
            for j, p in enumerate(power):
                f = j * rate / size
                if low < f < high:
                    out[k, m] += p * ((f - low) / (mid - low) if f <= mid else (high - f) / (high - mid))
    return 10 * np.log10(out + audio.FLOOR)


def test_features_match_brute_force():
    for text in (b"some text of a document, " * 40, b"x" * 192, bytes(range(32, 127)) * 9):
        held = text + b" " * (-len(text) % 192)
        sound = slow_filter(held)
        got = audio.resampled(np.frombuffer(held, np.uint8), 0, len(sound))
        assert np.abs(got - sound).max() < 1e-9
        mels, energy = audio.features(held)
        assert len(mels) == 1 + max(0, -(-(len(sound) - audio.FRAME) // audio.HOP)) and np.abs(mels / 100 - slow_mels(sound, len(mels))).max() < 0.02
        for k, e in enumerate(energy):
            part = sound[k * audio.HOP : k * audio.HOP + audio.FRAME]
            assert abs(e - 10 * np.log10((part**2).sum() / audio.FRAME + audio.FLOOR)) < 0.02


def test_segments_match_a_state_machine():
    rng = np.random.default_rng(3)
    for _ in range(300):
        energy = rng.integers(0, 12, rng.integers(1, 60)).astype(float)
        base, on, runs = np.quantile(energy, 0.1), False, []
        for k, e in enumerate(energy):
            on = True if e >= base + audio.START_DB else False if e < base + audio.END_DB else on
            if on:
                runs = [*runs[:-1], [runs[-1][0], k + 1]] if runs and runs[-1][1] == k else [*runs, [k, k + 1]]
        second = audio.HOP * audio.DOWN / (audio.UP * audio.RATE)
        want = [(a * second, b * second) for a, b in runs if b - a >= audio.LEAST]
        assert np.allclose(audio.segments(energy), want) if want else audio.segments(energy) == []


def test_blocks_do_not_change_features(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8).tobytes()
    mels, energy = audio.features(data)
    monkeypatch.setattr(audio, "BLOCK", 7)
    again = audio.features(data)
    assert np.abs(mels - again[0]).max() <= 1 and np.abs(energy - again[1]).max() < 0.02


def test_mel_peak_follows_the_tone():
    low, high = (audio.features(tone(h, 0.3).tobytes())[0].mean(axis=0).argmax() for h in (300, 3000))
    assert low < 10 < 25 < high


def test_segments_have_hysteresis():
    quiet = np.full(audio.RATE // 2, 128, np.uint8)
    sound = np.concatenate([quiet, tone(500, 0.5), quiet])
    (span,) = audio.segments(audio.features(sound.tobytes())[1])
    assert abs(span[0] - 0.5) < 0.05 and abs(span[1] - 1.0) < 0.05
    energy = np.array([0.0] * 50 + [7, 4, 4, 7, 4, 4] + [2] * 5)
    assert len(audio.segments(energy)) == 1


def test_tensors_are_fixed_shape_with_spans(spark):
    df = spark.createDataFrame([(1, "abc " * 9000, "", ""), (2, "x", "", ""), (2, "x", "", "")], SCHEMA)
    rows = audio.audio_digests(df).orderBy("doc_id")
    column = rows.toArrow()["tensors"]
    held = audio.tensor_array(column)
    assert held.type.shape == [audio.WINDOW, audio.MELS]
    values, at = held.to_numpy_ndarray(), 0
    for r in rows.collect():
        text = "abc " * 9000 if r.doc_id == 1 else "x" + " " * 191
        mels, _ = audio.features((text + " " * (-len(text) % 192)).encode())
        n = len(r.tensors)
        assert n == -(-len(mels) // audio.WINDOW) and all(len(w.mel) == audio.WINDOW * audio.MELS for w in r.tensors)
        assert np.allclose(values[at : at + n].reshape(-1, audio.MELS)[: len(mels)], mels / 100, atol=1e-4)
        starts, ends = np.array([w.start_s for w in r.tensors]), np.array([w.end_s for w in r.tensors])
        assert starts[0] == 0 and (starts[1:] <= ends[:-1] + 1e-9).all() and (ends > starts).all()
        at += n


def test_null_media_and_sending_in_parts(spark, monkeypatch):
    monkeypatch.setattr(audio, "SENT", 1)
    one = bytes(audio.stored_media(spark.createDataFrame([(1, "hello", "", "")], SCHEMA)).first().media)
    media = spark.createDataFrame([(1, 5, one), (2, None, None), (3, 5, one)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in audio.audio_features(media).collect()}
    assert got[2].feature is None and got[2].tensors is None and got[1].feature == got[3].feature and len(got[1].tensors) == 1
