"""Waves in pieces against whole waves: every border, short waves, and hot keys."""

import numpy as np
import pytest

from lexaudit.operators import signal, waves

RATE = 16_000


def recordings():
    r = np.random.default_rng(3)
    t = np.arange(70_000) / RATE
    tone, noise = 0.5 * np.sin(2 * np.pi * 440 * t), r.normal(0, 0.4, 70_000)
    mixed = np.where((t > 1.1) & (t < 2.9), noise, tone)
    out = {"tone": tone, "noise": noise, "mixed": mixed, "short": tone[:700], "one": noise[:1], "frame": noise[:256], "more": noise[:1024], "two": noise[:1025], "edge": mixed[: 4 * 8192], "less": noise[:513]}
    return {k: v.astype(np.float32) for k, v in out.items()}


@pytest.fixture(scope="module")
def held(spark):
    """Segments of uneven length, dealt out of order."""
    rows = []
    for name, wave in recordings().items():
        cuts = [*range(0, len(wave), 3001), len(wave)]
        rows += [(name, RATE, len(wave), a, wave[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
    return spark.createDataFrame(rows, "media_id string, sr int, total long, s long, samples array<float>").repartition(5)


@pytest.mark.parametrize("size", [512, 8192, 1 << 16])
def test_features_are_those_of_whole_waves(held, size):
    got = {}
    for r in waves.features(held, size).collect():
        got.setdefault((r.media_id, r.feature), {})[r.frame_idx] = r.value
    for name, wave in recordings().items():
        wave = wave.astype(float)
        for feature, track in (("zcr", signal.zero_crossings(wave)), ("rms_energy", signal.energy(wave)), ("spectral_centroid", signal.centroid(wave, RATE)), ("spectral_entropy", signal.entropy(wave, RATE))):
            found = got.pop((name, feature), {})
            assert sorted(found) == list(range(len(track))), (name, feature)
            assert np.allclose([found[i] for i in range(len(track))], track, atol=1e-9, equal_nan=True), (name, feature)
    assert not got


@pytest.mark.parametrize("size", [1024, 8192, 1 << 16])
def test_anomalies_are_those_of_whole_waves(held, size):
    got = sorted(tuple(r) for r in waves.anomalies(held, RATE, synthetic=7.5, size=size).collect())
    want = sorted((name, *e) for name, wave in recordings().items() for e in signal.anomalies(wave.astype(float), RATE, synthetic=7.5))
    assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want] and len({w[3] for w in want}) == 2
    assert np.allclose([[g[1], g[2], g[4]] for g in got], [[w[1], w[2], w[4]] for w in want])


def test_numbers_of_rows(spark):
    """A key with most of the rows, ties, and null keys."""
    rows = [(1, i % 7, i) for i in range(300)] + [(2, 5, 1), (2, 4, 2), (None, 1, 1), (None, 0, 2), (3, 0, 0)]
    df = spark.createDataFrame(rows, "k long, a long, b long").repartition(4)
    got = {(r.k, r.a, r.b): (r._row, r._rows) for r in waves.numbered(df, "k", ["a", "b"], parts=6).collect()}
    for key in (1, 2, 3, None):
        mine = sorted((a, b) for k, a, b in rows if k == key)
        assert [got[key, a, b] for a, b in mine] == [(i, len(mine)) for i in range(len(mine))]
    assert waves.numbered(df.where("false"), "k", ["a"]).count() == 0


def test_segments_and_pieces(spark):
    samples = spark.range(1000).selectExpr("'m' AS media_id", "8 AS sr", "1000L AS total", "id AS s", "double(id) AS value").repartition(3)
    cut = waves.segments(samples, 300)
    assert sorted((r.s, len(r.samples)) for r in cut.collect()) == [(0, 300), (300, 300), (600, 300), (900, 100)]
    got = {r.piece: r.samples for r in waves.pieces(cut, 100, 512).collect()}
    assert got == {0: [float(i) for i in range(612)], 1: [float(i) for i in range(512, 1000)]}
    with pytest.raises(ValueError):
        waves.pieces(cut, 100, 500)
    nothing = cut.where("false")
    assert waves.features(nothing).count() == 0 and waves.anomalies(nothing, RATE).count() == 0
