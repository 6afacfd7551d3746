import pytest

from pixelloom.functions import gamma
from pixelloom.functions import metadata as md
from pixelloom.plans.formats import FORMATS, conversion
from pixelloom.plans.planner import Shape

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


@pytest.mark.parametrize("want", sorted(FORMATS))
def test_every_kind_reaches_every_format(want):
    for color, depth in ((0, 1), (0, 8), (0, 16), (2, 8), (2, 16), (3, 4), (4, 8), (4, 16), (6, 8), (6, 16)):
        for transparent in (False, True) if color not in (4, 6) else (False,):
            start = Shape(4, depth, color, CHANNELS[color])
            for background in (None, (1, 2, 3)):
                p = conversion(start, transparent, want, background=background)
                fmt = FORMATS[want]
                assert p.shape.depth == (16 if fmt.linear else 8), (want, color, depth)
                covered = start.has_alpha or transparent
                if fmt.alpha or not covered or background or fmt.linear:
                    assert p.shape.channels == fmt.channels or (covered and not fmt.alpha and not background), (want, color, depth, p.names)


def test_narrowing_table_is_monotonic_and_spans_the_range():
    for e in (30_000, 45_455, 100_000, 220_000):
        bounds = gamma.narrowing_bounds(e, 5)
        assert bounds == sorted(bounds) and len(bounds) == 255 and bounds[-1] <= 2048


def test_curves_are_monotonic():
    for e in (10_000, 45_455, 90_000, 220_000, 400_000):
        t = gamma.table_8(e)
        assert t == sorted(t) and (t[0], t[255]) == (0, 255)
    assert gamma.table_8(100_000) == list(range(256))


@pytest.mark.parametrize("value, text", [(0.0, "0"), (1.0, "1"), (-2.5, "-2.5"), (0.5, ".5"), (123456.0, "123460"), (1e7, "1E7"), (0.001, ".001"), (0.00012345, "12345E-8"), (1e-9, "1E-9"), (99999.6, "1E5"), (12.34567, "12.346"), (-100000.0, "-1E5")])
def test_numbers_as_text(spark, value, text):
    got = spark.range(1).select(md.double_to_text(md.F.lit(value)).alias("t")).first()["t"]
    assert got == text


def test_fixed_numbers_and_keywords(spark):
    rows = [(0, "0"), (100000, "1"), (-50000, "-.5"), (123, ".00123"), (1250000, "12.5")]
    got = spark.createDataFrame(rows, "v long, t string").select(md.fixed_to_text(md.F.col("v")).alias("g"), "t").collect()
    assert all(r["g"] == r["t"] for r in got)
    words = spark.createDataFrame([("a",), ("x" * 79,), ("x" * 80,), ("",), (None,)], "w string")
    assert [r[0] for r in words.select(md.valid_keyword(md.F.col("w"))).collect()] == [True, True, False, False, False]
