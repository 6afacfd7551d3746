import numpy as np
import pytest

from pixelloom.sources import codec, datasource, images
from pixelloom.streaming.progressive import progressive_rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    rng = np.random.default_rng(1)
    made = {
        "rgb": codec.encode(rng.integers(0, 256, (4, 5, 3)).astype(np.int32), 8, 2, interlaced=True, text=[(-1, "Title", "t", "", "")], metadata={"gAMA": 45455}),
        "pal": codec.encode(rng.integers(0, 4, (3, 7, 1)).astype(np.int32), 2, 3, palette=[(1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 12)], alpha=[0, 9], metadata={"hIST": [1, 2, 3, 4]}),
        "over": codec.encode(np.full((2, 2, 1), 3, np.int32), 8, 3, palette=[(1, 2, 3)]),
        "wide": codec.encode(rng.integers(0, 65536, (2, 3, 2)).astype(np.int32), 16, 4, unknown=[("prVt", b"x", 1)]),
    }
    made["cut"] = made["rgb"][:-30]
    made["empty"] = b"not a file"
    for n, b in made.items():
        (root / f"{n}.png").write_bytes(b)
    return root, made


def names(df):
    return {r["image_id"].rsplit("/", 1)[1][:-4] for r in df.select("image_id").collect()}


def test_relations(spark, folder):
    root, made = folder
    files = images.files(spark, str(root))
    assert names(images.relation(files, "headers")) == {"rgb", "pal", "over", "wide", "cut"}
    px = images.pixels(files).collect()
    assert len(px) == 20 + 21 + 4 + 6
    for name in ("rgb", "pal", "wide"):
        want = codec.decode(made[name]).samples
        got = {(r["y"], r["x"]): [r[f"c{i}"] for i in range(want.shape[2])] for r in px if r["image_id"].endswith(f"{name}.png")}
        assert all(got[y, x] == want[y, x].tolist() for y in range(want.shape[0]) for x in range(want.shape[1]))
    pal = images.relation(files, "palette").filter("image_id like '%pal.png'").orderBy("idx").collect()
    assert [(r["r"], r["a"], r["freq"]) for r in pal] == [(1, 0, 1), (4, 9, 2), (7, 255, 3), (10, 255, 4)]
    bad = images.relation(files, "diagnostics")
    assert names(bad) == {"over", "cut", "empty"} and names(bad.filter("severity = 'error'")) == {"cut", "empty"}
    assert names(images.relation(files, "text")) == {"rgb", "cut"} and names(images.relation(files, "unknown")) == {"wide"}
    assert images.relation(files, "metadata").filter("name = 'gAMA'").first()["value"] == "45455"
    assert images.relation(files, "scanlines").filter("image_id like '%rgb.png'").count() == sum(h for _, _, h in codec.pass_sizes(5, 4, True))
    chunks = images.relation(files, "chunks").filter("image_id like '%pal.png'").orderBy("seq").collect()
    assert [c["name"] for c in chunks] == ["IHDR", "PLTE", "tRNS", "hIST", "IDAT", "IEND"]


def test_source_and_sink(spark, folder, tmp_path):
    datasource.register(spark)
    root, made = folder
    got = spark.read.format("loom_png").option("path", str(root)).load()
    assert got.filter("name = 'IHDR'").count() == 5
    files = images.files(spark, str(root))
    out = files.selectExpr("regexp_extract(image_id, '([a-z]+).png$', 1) as image_id", "content").filter("image_id != 'empty'")
    out.write.format("loom_png").option("path", str(tmp_path / "out")).mode("append").save()
    assert {p.stem: p.read_bytes() for p in (tmp_path / "out").glob("*.png")} == {k: v for k, v in made.items() if k != "empty"}


def test_stream_of_slices(spark, folder, tmp_path):
    _, made = folder
    rows = []
    for key, name in enumerate(("rgb", "pal", "over", "cut", "empty")):
        content = made[name]
        rows += [(key, i, content[at : at + 9]) for i, at in enumerate(range(0, len(content), 9))]
    schema = "image_id long, seq int, bytes binary"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = progressive_rows(stream).writeStream.format("memory").queryName("rows_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("rows_out").collect()
    for key, name in enumerate(("rgb", "pal", "over")):
        want = codec.decode(made[name]).samples
        assert sorted((r["y"], r["samples"]) for r in got if r["image_id"] == key) == [(y, row.ravel().tolist()) for y, row in enumerate(want)]
    assert [r["message"] for r in got if r["image_id"] == 4] == ["Not a PNG file"] and not [r for r in got if r["image_id"] == 3]
