"""Every registered image query against its SQL, and the ones SQL cannot express against plain Python."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import TABLES
from compare import rows as canonical
from pixelloom import catalog, fixtures
from pixelloom.functions import metadata as md
from pixelloom.operators import palettes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want) and len(got)


def test_checksums_equal_zlib(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in catalog.QUERIES["crc"](spark, DATA).collect():
        assert r["crc"] == zlib.crc32(b"tEXt" + docs[r["doc_id"]].encode())


def test_damage_is_reported_for_every_image_that_has_any(spark):
    found = catalog.QUERIES["diagnostics"](spark, DATA)
    assert found.filter("severity = 'error'").select("image_id").distinct().count() > 100
    assert {r["severity"] for r in found.select("severity").distinct().collect()} <= {"error", "warning"}


@pytest.mark.parametrize("name", ["quantize_by_frequency", "quantize_nearest_pair"])
def test_palette_reduction_of_whole_tables(spark, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert (got.groupby("image_id").new_idx.nunique() <= 6).all() and got.new_idx.max() < 6
    assert (got.groupby("image_id").size() == 16).all()
    colors = {tuple(c) for c in fixtures.palette(spark).select("pr", "pg", "pb").collect()}
    assert {tuple(c) for c in got[["pr", "pg", "pb"]].itertuples(index=False, name=None)} <= colors


def test_reduction_rules():
    colors = [(0, 0, 0), (255, 255, 255), (10, 0, 0), (250, 250, 250), (0, 200, 0)]
    kept, moved = palettes.reduce_by_frequency(colors, [5, 1, 9, 7, 3], 3)
    # sorted places are compared with the palette's own places, so entry 4 changes with entry 1 and not with 3
    assert kept == [colors[0], colors[4], colors[2]] and [moved[i] for i in (0, 2, 4)] == [0, 2, 1]
    assert kept[moved[1]] == min(kept, key=lambda c: palettes.distance(c, colors[1]))
    kept, moved = palettes.reduce_by_distance(colors, 3)
    assert len(kept) == 3 and moved[0] == moved[2] and moved[1] == moved[3]
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        cs = [tuple(map(int, c)) for c in rng.integers(0, 256, (n, 3))]
        most = int(rng.integers(1, n + 3))
        for kept, moved in (palettes.reduce_by_frequency(cs, rng.integers(0, 99, n).tolist(), most), palettes.reduce_by_distance(cs, most)):
            assert len(kept) <= max(most, 1) or n <= most
            assert len(moved) == n and max(moved) < len(kept) and set(kept) <= set(cs)


def merged_by_groups(colors, most):
    """Nearest pairs by the prose: each slot holds a group of entries under its founder's colour; a round starts from the slots as they are."""
    groups = [[e] for e in range(len(colors))]
    for radius in range(96, 862, 96):
        heads = [g[0] for g in groups]
        far = {(a, b): sum(abs(x - y) for x, y in zip(colors[a], colors[b])) for i, a in enumerate(heads) for b in heads[i + 1 :]}
        for d in range(radius + 1):
            for a, b in reversed([p for p, q in far.items() if q == d]):
                now = [g[0] for g in groups]
                if len(groups) > most and a in now and b in now:
                    gone, stays = (a, b) if len(groups) % 2 else (b, a)
                    groups[now.index(stays)] += groups[now.index(gone)]
                    groups[now.index(gone)] = groups[-1]
                    groups.pop()
    return [colors[g[0]] for g in groups], [next(s for s, g in enumerate(groups) if e in g) for e in range(len(colors))]


def test_nearest_pairs_against_groups():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 14))
        top = int(rng.choice([3, 40, 256]))
        cs = [tuple(map(int, c)) for c in rng.integers(0, top, (n, 3))]
        most = int(rng.integers(1, n + 2))
        assert palettes.reduce_by_distance(cs, most) == merged_by_groups(cs, most)


def test_a_rarest_entry_sinks_in_each_pass():
    rng = np.random.default_rng(2)
    for _ in range(50):
        weight = rng.integers(0, 6, 9).tolist()
        order = rng.permutation(9).tolist()
        want = list(order)
        for k in range(8):
            if weight[want[k]] < weight[want[k + 1]]:
                want[k], want[k + 1] = want[k + 1], want[k]
        assert palettes._sunk(order, weight) == want


def test_numbers_beyond_four_bytes_keep_their_value(spark, con, tmp_path):
    """Part keys of a table 60 times sf0.1 times 7919 pass 32 bits; fewer bytes than a number needs hold its low ones."""
    con.execute(f"COPY (SELECT p_partkey * 600_000 AS p_partkey FROM part) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["big_endian"](spark, str(tmp_path)).toPandas()
    want = con.execute(catalog.ORACLE_SQL["big_endian"].replace("FROM part", f"FROM '{tmp_path}/part.parquet'")).df()
    assert canonical(got) == canonical(want) and got.u32.max() > 1 << 32
    values = spark.createDataFrame([(0x1_2345_6789,), (-2,), (7,)], "v long")
    assert [[bytes(b) for b in r] for r in values.select(md.uint_bytes(F.col("v"), 4), md.uint_bytes(F.col("v"), 2)).collect()] == [[b"\x23\x45\x67\x89", b"\x67\x89"], [b"\xff\xff\xff\xfe", b"\xff\xfe"], [b"\0\0\0\7", b"\0\7"]]


@pytest.mark.parametrize("name", ["colormap_gray_alpha_composed", "colormap_rgba_to_gray", "colormap_palette", "colormap_rgba"])
def test_no_map_or_pixels_of_all_images_are_broadcast(spark, name):
    """Up to 256 entries an image are numbered out of one row, and Spark's estimate is that row's: broadcast, they filled the driver."""

    def walk(p, broadcast=False):
        broadcast |= p.nodeName().startswith("BroadcastExchange")
        assert not (broadcast and p.nodeName().startswith("Generate")), p.toString()
        for i in range(p.children().size()):
            walk(p.children().apply(i), broadcast)

    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan()
    walk(plan.initialPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan)
