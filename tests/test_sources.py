from __future__ import annotations

import wave

import numpy as np

from mediamill.sources import audio


def write(path, rate, channels, seconds):
    t = np.arange(int(rate * seconds))
    one = (np.sin(2 * np.pi * 440 * t / rate) * 12000).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(one, channels).tobytes())


def test_waves(spark, tmp_path):
    write(tmp_path / "a.wav", 48000, 1, 2)
    write(tmp_path / "b.wav", 44100, 2, 0.5)
    write(tmp_path / "c.wav", 44100, 1, 0.5)
    (tmp_path / "bad.wav").write_bytes(b"no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.with_hash(audio.read_waves(spark, str(tmp_path))).collect()}
    assert len(rows["a.wav"].left) == 88200 and rows["a.wav"].left == rows["a.wav"].right
    assert rows["b.wav"].audio_hash == rows["c.wav"].audio_hash != rows["a.wav"].audio_hash
    assert rows["bad.wav"].left is None and rows["bad.wav"].error.startswith("unsupported")
    sizes = audio.folder_sizes(spark, str(tmp_path)).first()
    assert sizes.files == 4 and sizes.bytes == sum(f.stat().st_size for f in tmp_path.iterdir())
