import numpy as np
import pytest

from pixelloom import api
from pixelloom.sources import codec


def test_many_kinds_at_once(spark):
    rng = np.random.default_rng(3)
    pal = [(10, 20, 30), (40, 50, 60), (70, 80, 90), (1, 2, 3)]
    gray, idx, rgb, wide = rng.integers(0, 4, (3, 4, 1)), rng.integers(0, 4, (3, 4, 1)), rng.integers(0, 256, (2, 5, 3)), rng.integers(0, 65536, (2, 2, 2))
    rgb[0, 0] = (9, 8, 7)
    made = {
        "gray": codec.encode(gray.astype(np.int32), 2, 0),
        "pal": codec.encode(idx.astype(np.int32), 2, 3, palette=pal, alpha=[0, 128]),
        "other": codec.encode(idx.astype(np.int32), 2, 3, palette=pal[::-1], alpha=[5]),
        "key": codec.encode(rgb.astype(np.int32), 8, 2, key=(9, 8, 7)),
        "wide": codec.encode(wide.astype(np.int32), 16, 4, interlaced=True),
        "bad": b"no",
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "image_id string, content binary")
    got = {}
    for r in api.read_as(files, "rgba").collect():
        got[r["image_id"], r["y"], r["x"]] = (r["c0"], r["c1"], r["c2"], r["c3"])
    assert len(got) == 12 * 3 + 10 + 4
    for y in range(3):
        for x in range(4):
            v, i = int(gray[y, x, 0]) * 85, int(idx[y, x, 0])
            assert got["gray", y, x] == (v, v, v, 255)
            assert got["pal", y, x] == (*pal[i], [0, 128, 255, 255][i])
            assert got["other", y, x] == (*pal[::-1][i], [5, 255, 255, 255][i])
    assert got["key", 0, 0] == (9, 8, 7, 0) and got["key", 1, 1] == (*map(int, rgb[1, 1]), 255)
    g, a = ((int(v) + 128) // 257 for v in wide[1, 0])
    assert got["wide", 1, 0] == (g, g, g, a)
    only = api.read_with(files.filter("image_id = 'gray'"), {"packing", "invert_mono"}).collect()
    assert {(r["y"], r["x"]): r["c0"] for r in only} == {(y, x): 3 - int(gray[y, x, 0]) for y in range(3) for x in range(4)}


def test_write_and_read_back(spark):
    px = spark.range(0, 60).selectExpr("id div 20 as image_id", "id % 20 div 5 as y", "id % 5 as x", "id * 3 % 256 as r", "id * 5 % 256 as g", "id * 7 % 256 as b")
    files = api.write_as(px, 5, ["r", "g", "b"], interlaced=True)
    back = api.read_as(files, "rgb").selectExpr("cast(image_id as long) image_id", "y", "x", "c0", "c1", "c2")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect()))
    assert api.read_as(files.limit(0), "rgb").count() == 0


def test_kinds_without_number_and_images_of_many_sizes(spark):
    """Every file has a key and a gamma of its own; sizes differ too."""
    made = []
    for i in range(40):
        px = np.full((1 + i % 3, 2 + i % 4, 3), i, np.int32)
        made.append((f"k{i}", bytearray(codec.encode(px, 8, 2, key=(i, i, i) if i % 2 else (255, 0, 0), metadata={"gAMA": 45_455 + i}))))
    files = spark.createDataFrame(made, "image_id string, content binary")
    got = {}
    for r in api.read_as(files, "rgba").collect():
        got.setdefault(r["image_id"], set()).add((r["c0"], r["c1"], r["c2"], r["c3"]))
    assert got == {f"k{i}": {(i, i, i, 0 if i % 2 else 255)} for i in range(40)}
    px = spark.createDataFrame([(n, y, x, n * 10 + x) for n in (1, 2, 3) for y in range(n) for x in range(n + 1)], "image_id long, y long, x long, v long")
    back = api.read_as(api.write_as(px, None, ["v"]), "gray").selectExpr("cast(image_id as long) image_id", "y", "x", "c0").collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, px.collect()))


def test_maps_that_cannot_be_are_refused(spark):
    files = spark.createDataFrame([("a", bytearray(codec.encode(np.zeros((1, 1, 2), np.int32), 8, 4)))], "image_id string, content binary")
    with pytest.raises(ValueError):
        api.read_indexed(files, "rgb")
    empty = api.read_indexed(files.limit(0), "rgb")
    assert [x.count() for x in empty] == [0, 0]
