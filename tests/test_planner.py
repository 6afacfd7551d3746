import itertools
import random

import pytest

from pixelloom.plans.planner import REQUESTS, STEPS, Settings, Shape, plan, resolve, valid_shift

KINDS = [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)]
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def shape(color, depth, width=5):
    return Shape(width, depth, color, CHANNELS[color])


@pytest.mark.parametrize("color, depth", KINDS)
def test_order_of_requests_never_matters(color, depth):
    rng, names = random.Random(color * 17 + depth), sorted(REQUESTS - {"user_transform", "shift"})
    for _ in range(100):
        asked = rng.sample(names, rng.randint(0, 7))
        for transparent in (False, True) if color not in (4, 6) else (False,):
            one = plan(set(asked), shape(color, depth), transparent)
            two = plan(set(reversed(asked)), shape(color, depth), transparent)
            assert one.names == two.names and one.shape == two.shape
            places = [[s.name for s in STEPS].index(n) for n in one.names]
            assert places == sorted(places) and one.max_row_bytes >= one.shape.row_bytes


def test_rules():
    assert resolve({"expand"}, shape(3, 8), False) == {"expand", "expand_transparency"}
    assert resolve({"expand"}, shape(0, 2), False) == {"expand", "expand_gray"}
    assert resolve({"scale_16", "strip_16"}, shape(0, 16), False) == {"scale_16"}
    assert resolve({"expand_16", "swap_bytes"}, shape(0, 8), False) == {"expand_16"}
    assert resolve({"compose"}, shape(2, 8), True) == {"compose", "expand", "expand_transparency"}
    assert plan({"compose"}, shape(2, 8)).names == ()
    assert plan({"compose"}, shape(2, 8), True).names == ("expand_transparency", "compose")
    gamma = Settings(file_gamma=45455, screen_gamma=100000)
    assert plan({"gamma"}, shape(0, 8), settings=gamma).names == ("gamma",)
    assert plan({"gamma", "rgb_to_gray"}, shape(0, 8), settings=gamma).names == ()
    assert plan({"swap_alpha", "add_alpha"}, shape(2, 8)).names == ("swap_alpha", "filler")
    assert plan({"filler"}, shape(2, 8)).shape == Shape(5, 8, 2, 4) and plan({"add_alpha"}, shape(2, 8)).shape == Shape(5, 8, 6, 4)
    assert plan({"expand", "strip_alpha"}, shape(3, 8), True).shape == Shape(5, 8, 2, 3)
    with pytest.raises(ValueError):
        plan({"nonsense"}, shape(2, 8))
    with pytest.raises(ValueError):
        plan({"shift"}, shape(0, 4), settings=Settings(significant=(5,)))
    assert valid_shift((5, 6, 5), shape(3, 8)) and not valid_shift((5, 6), shape(3, 8))


def test_every_pair_of_requests_runs(spark):
    """Each plan's columns number its shape's channels."""
    px = spark.createDataFrame([(1, 0, 0, 10, 20, 30, 40), (1, 0, 1, 7, 7, 7, 255)], "image_id long, y long, x long, r long, g long, b long, a long")
    pal = spark.createDataFrame([(i, i, i, i, 255) for i in range(16)], "idx long, pr long, pg long, pb long, pa long")
    for color, cols in ((0, ["r"]), (2, ["r", "g", "b"]), (3, ["r"]), (4, ["r", "a"]), (6, ["r", "g", "b", "a"])):
        for asked in itertools.combinations(sorted(REQUESTS - {"user_transform", "quantize"}), 2):
            for transparent in (False, True) if color not in (4, 6) else (False,):
                p = plan(set(asked), shape(color, 8), transparent, Settings(file_gamma=45455, screen_gamma=100000, alpha_mode="optimized"))
                out = p.apply(px.select("image_id", "y", "x", *cols), pal)
                assert len(out.columns) == 3 + p.shape.channels, (color, asked, p.names)


def test_backgrounds_are_brought_to_the_scale_and_space_of_the_blend():
    from pixelloom.plans.planner import Background, resolve_background

    indexed, small, wide, gray8 = Shape(4, 8, 3, 1), Shape(4, 2, 0, 1), Shape(4, 16, 2, 3), Shape(4, 8, 0, 1)
    s = resolve_background(Background(index=1, in_file=True), {"compose", "expand"}, indexed, Settings(), [(1, 2, 3), (4, 5, 6)])
    assert s.background == s.background_linear == (4, 5, 6)
    s = resolve_background(Background(gray=2, in_file=True), {"compose", "expand"}, small, Settings())
    assert s.background == (170,)
    assert resolve_background(Background(1, 2, 3), {"compose", "expand", "scale_16"}, wide, Settings()).background == (257, 514, 771)
    assert resolve_background(Background(gray=65535), {"compose", "expand", "expand_16"}, gray8, Settings()).background == (255,)
    gammas = Settings(file_gamma=45_455, screen_gamma=100_000)
    at = lambda v, e: int(255 * (v / 255) ** e + 0.5)
    s = resolve_background(Background(gray=100, space="file"), {"compose", "expand", "gamma"}, gray8, gammas)
    assert (s.background, s.background_linear) == ((at(100, 2.19998),), (at(100, 2.19998),))
    s = resolve_background(Background(gray=100), {"compose", "expand", "gamma"}, gray8, Settings(file_gamma=100_000, screen_gamma=220_000))
    assert (s.background, s.background_linear) == ((100,), (at(100, 2.2),))
    s = resolve_background(Background(gray=100, space="own", gamma=50_000), {"compose", "expand", "gamma"}, gray8, gammas)
    assert s.background_linear == (at(100, 2.0),)


def test_curves_of_16_bits_follow_what_becomes_of_the_samples():
    from pixelloom.plans.planner import _Context

    wide = Shape(4, 16, 2, 3)
    context = lambda asked, bits=0: _Context(frozenset(asked), wide, False, Settings(100_000, 220_000, sample_bits=bits))
    assert [context({"gamma"}).coarse, context({"gamma"}, 11).coarse, context({"gamma", "scale_16"}).coarse, context({"gamma", "strip_16"}, 5).coarse] == [0, 5, 5, 8]


def test_quantized_indices_go_where_their_map_says(spark):
    px = spark.createDataFrame([(1, 0, x, i) for x, i in enumerate((0, 1, 2, 7))], "image_id long, y long, x long, i long")
    out = plan({"quantize"}, Shape(4, 8, 3, 1), settings=Settings(quantize_map=(5, 0, 3))).apply(px)
    assert [r["c0"] for r in out.orderBy("x").collect()] == [5, 0, 3, 7]


def test_write_plans_have_one_order_and_know_what_is_supplied():
    from pixelloom.plans.writing import plan_write

    p = plan_write({"bgr", "filler", "swap_bytes", "invert_mono"}, Shape(4, 16, 2, 3))
    assert p.steps == ("filler", "swap_bytes", "bgr") and (p.supplied.channels, p.supplied.depth) == (4, 16)
    assert plan_write({"packing", "shift"}, Shape(4, 2, 3, 1)).supplied.depth == 8
    with pytest.raises(ValueError):
        plan_write({"expand"}, Shape(4, 8, 0, 1))
