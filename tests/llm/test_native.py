"""The operators that have SQL: whole tables against DuckDB, and made rows with every awkward case."""

import random
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from compare import rows as canonical  # noqa: E402
from pixelloom.llm import queries  # noqa: E402
from pixelloom.llm.exact_dedup import drop_exact_copies, exact_dedup  # noqa: E402
from pixelloom.llm.mixing import mix, mixed_rows  # noqa: E402
from pixelloom.llm.quality import keep_good, quality_report  # noqa: E402
from pixelloom.llm.url_filter import judge_urls  # noqa: E402

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, w long, rid long"


def sql(name, **frames):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        if t in frames:
            con.register(t, frames[t])
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con.execute(queries.ORACLE_SQL[name]).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_whole_table(spark, name):
    assert canonical(queries.QUERIES[name](spark, DATA).toPandas()) == canonical(sql(name))


def made_documents(seed, n=300):
    rng = random.Random(seed)
    words = "the of and la de x y # | a1 zz éé &&".split()

    def text():
        k = rng.random()
        if k < 0.05:
            return None
        if k < 0.1:
            return rng.choice(["", " ", "\n\n", "\t\x0b"])
        size = rng.choice([1, 2, 3, 49, 50, 60, 200])
        out = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\n\n", "\t", "\r\n"]) for _ in range(size))
        return out if k < 0.9 else (out + "\n") * 3

    pool = [text() for _ in range(n // 2)] + ["a b c " * 9000]
    return [(i, rng.choice(pool), "en", rng.choice([None, "a", "a", "a", "b", "é", "😀", "B"]), 1, None, None, 5, 7) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_made_documents(spark, seed):
    docs = spark.createDataFrame(made_documents(seed), DOCS).repartition(3)
    docs = spark.createDataFrame(docs.collect(), DOCS)
    frame = docs.toPandas()
    assert canonical(quality_report(docs).toPandas()) == canonical(sql("op2_quality_rules", documents=frame))
    assert canonical(exact_dedup(docs).drop("rid").toPandas()) == canonical(sql("op10_exact_dedup", documents=frame))
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert canonical(mixed.toPandas()) == canonical(sql("op5_mixing", documents=frame))


def test_exact_dedup_of_repeated_and_missing_ids(spark):
    rows = [(5, "a  b"), (5, "a\tb"), (None, "a b"), (None, None), (None, " "), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*r, *[None] * 7) for r in rows], DOCS)
    got = exact_dedup(docs).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) == 3
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(5, 3), (3, 3), (None, 1)}
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())[1:] == [(3, ""), kept.filter("doc_id = 5").select("doc_id", "text").first()]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_hot_groups_are_found_and_resolved(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", *[None] * 7) for i in range(3000)]
    got = exact_dedup(spark.createDataFrame(rows, DOCS)).filter("kept").collect()
    assert len(got) == 2001 and {r["group_size"] for r in got} == {1, 1000}


def test_mixing_keeps_its_promises(spark):
    docs = spark.createDataFrame(made_documents(3, 3000), DOCS)
    got = mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by = got.groupby(got.source.fillna("-")).agg({"taken": "sum", "target": "first", "source_size": "first", "size": "max"})
    assert abs(by.target.sum() - got["size"].sum()) < 1
    assert (by.target <= 3 * by.source_size + 1e-6).all() and ((by.taken - by.target).abs() <= by["size"]).all()
    assert (got.taken <= 3 * got["size"]).all()
    again = mix(docs.repartition(7)).select("doc_id", "taken").toPandas().sort_values("doc_id")
    assert again.taken.tolist() == got.sort_values("doc_id").taken.tolist()
    out = mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == int(mix(docs).agg({"times": "sum"}).first()[0])
    assert mix(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, *[None] * 7), (1, "", *[None] * 7)], DOCS)
    assert [r["taken"] for r in mix(empty).collect()] == [0, 0]


def test_quality_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, *[None] * 7), (None, "the of and to " * 20000, *[None] * 7), (2, "one two", *[None] * 7)], DOCS)
    got = {r["doc_id"]: r for r in quality_report(docs).collect()}
    assert (got[1]["n_words"], got[1]["base_failed"], got[1]["kept"]) == (0, True, False)
    assert got[None]["n_words"] == got[None]["n_repeat_words"] == 80000 and got[None]["base_failed"]
    assert keep_good(docs).columns == docs.columns and keep_good(docs).count() == 0
    assert quality_report(docs.limit(0)).count() == 0


URLS = [None, "", "no scheme", "http://", "://x", "HTTP://A.Example.NET/en/1", "http://example.net/enx", "http://net", "http://net/", "http://anet/", "https://a.org/fr/x?q#f", "http://example.com?x/de/", "http://example.com#a", "http://ÄB.com/Ä", "http://x.example.com/de/5", "http://x.example.com/de", "http://h.com/12.html", "http://h.com/deadbeef99/a//b"]


def test_urls(spark):
    rng = random.Random(2)
    urls = URLS * 2 + [f"http://{rng.choice(['spam-x', 'good', 'a.b', 'www.casino-win'])}.{rng.choice(['com', 'org', 'example.com', 'example.net'])}/{rng.choice(['en', 'de', 'fr', ''])}/{rng.choice(['a', 'b', rng.randint(1, 99)])}" for _ in range(600)]
    urls += [f"http://wide.org/{'fr' if i % 2 else 'en'}/s{i}" for i in range(200)] + ["http://long.com/" + "a/" * 50000]
    rows = [(i, u, "h", "c", "d") for i, u in enumerate(urls)] + [(None, "http://a.net/x", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, label string, path string")
    whole = lambda df: canonical(df.fillna({"page_id": -1}).astype({"page_id": "int64"}))
    assert whole(judge_urls(pages).toPandas()) == whole(sql("op9_url_filter", pages=pages.toArrow()))
    assert judge_urls(pages.limit(0)).count() == 0
    by = {r["page_id"]: r for r in judge_urls(pages).collect()}
    assert (by[5]["host"], by[5]["path"], by[5]["rule"], by[5]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert by[0]["host"] == by[2]["path"] == "" and by[2]["rule"] is None and by[7]["rule"] is None and by[8]["rule"] == "net/"


CLASH = ["__rid", "__q", "__w", "__kept", "row", "key", "rid", "q", "w", "h", "skey", "kept", "size", "n", "times", "a.b", "first"]


def clashing(spark, n=60):
    long = [" ".join(f"the w{i % 20}x{k} of" for k in range(30)) for i in range(n)]
    rows = [(i, long[i], "en", "ab"[i % 2], *[7 + k for k in range(len(CLASH))]) for i in range(n)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` long" for c in CLASH)
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("stage", ["keep_good", "drop_exact_copies", "keep_one_of_each", "mixed_rows"])
def test_columns_with_clashing_names_are_kept_as_they_are(spark, stage):
    from pixelloom.llm.simhash import keep_one_of_each

    docs = clashing(spark)
    out = {"keep_good": keep_good, "drop_exact_copies": drop_exact_copies, "keep_one_of_each": keep_one_of_each, "mixed_rows": mixed_rows}[stage](docs)
    assert out.schema.names == docs.schema.names
    given = {r["doc_id"]: r for r in docs.collect()}
    got = out.collect()
    assert got and all(r == given[r["doc_id"]] for r in got)


@pytest.mark.parametrize("stage", ["drop_exact_copies", "keep_one_of_each", "mixed_rows"])
def test_rows_are_found_again_when_the_table_is_split_otherwise(spark, tmp_path, stage):
    """A table of 20 files, planned at one parallelism and run at another, as when executors come and go between two scans."""
    from pixelloom.llm.simhash import keep_one_of_each

    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(200)]
    rows = [(i, text[i % 200], "a") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(20).write.parquet(f"{tmp_path}/t")
    at = "spark.sql.leafNodeDefaultParallelism"
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        spark.conf.set(at, 2)
        docs = spark.read.parquet(f"{tmp_path}/t")
        out = {"drop_exact_copies": drop_exact_copies, "keep_one_of_each": keep_one_of_each, "mixed_rows": mixed_rows}[stage](docs)
        spark.conf.set(at, 20)
        assert out.rdd.getNumPartitions() > 2 or stage != "mixed_rows"
        got = out.select("doc_id", "text").collect()
    finally:
        spark.conf.unset(at)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    if stage == "mixed_rows":
        assert len(got) == 1000
    else:
        assert sorted(r["doc_id"] for r in got) == list(range(200)) and len({r["text"] for r in got}) == 200


def test_repeated_rows_hot_and_few_leave_one_each(spark):
    """Rows that repeat id and text: half of the table one row, another row three times, and rows that differ in further columns only."""
    rows = [(1, "a b", "x")] * 500 + [(2, "c  d", "x")] * 3 + [(3, "e", c) for c in "zyx"] + [(10 + i, f"t{i}", None) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = sorted((r["doc_id"], r["text"], r["lang"] or "") for r in drop_exact_copies(docs).collect())
    assert got[:3] == [(1, "a b", "x"), (2, "c  d", "x"), (3, "e", "x")] and len(got) == 483


def test_documents_without_id_are_mixed_by_their_text(spark):
    rows = [(None, f"w{i} x y", "ab"[i % 4 == 0]) for i in range(100)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = got.groupby("source_size").agg({"taken": "sum", "target": "first"})
    assert ((by.taken - by.target).abs() <= 3).all()


def plain_verdicts(urls, rules, words):
    """The template tree by recursion over all levels of every host, without any short cut."""
    import re

    from pixelloom.llm.url_filter import PRIOR, PRIOR_N, REJECT_AT, Z

    def general(x):
        return re.sub("^[0-9]+", "{n}", x) if re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]+)?", x) else "{x}" if re.fullmatch("[0-9a-fA-F-]{8,}", x) else x

    pages, verdicts = {}, {}
    for i, url in enumerate(urls):
        host, _, path = url.split("://", 1)[1].partition("/")
        path = "/" + path if _ else ""
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len(r[0] + r[1]))[2] if fits else None
        label = rule or ("block" if any(w in re.split("[.-]", host) for w in words) else None)
        verdicts[i] = rule
        pages.setdefault(host, []).append((i, [general(x) for x in path.split("/") if x], label))

    def counts(rows):
        return sum(r[2] is not None for r in rows), sum(r[2] == "block" for r in rows)

    def judge(rows, level):
        n, b = counts(rows)
        if level > max(len(r[1]) for r in rows):
            for i, _, _ in rows:
                verdicts[i] = verdicts[i] or ("block" if (b + PRIOR * PRIOR_N) / (n + PRIOR_N) >= REJECT_AT else "allow")
            return
        branches, merged = {}, {}
        for r in rows:
            branches.setdefault(r[1][level] if level < len(r[1]) else "", []).append(r)
        for name, own in branches.items():
            k, c = counts(own)
            rate = b / n if n else 0
            alike = k > 0 and abs(c / k - rate) <= Z * (rate * (1 - rate) / k) ** 0.5
            merged.setdefault("*" if alike else "/" + name, []).extend(own)
        for own in merged.values():
            judge(own, level + 1)

    for rows in pages.values():
        judge(rows, 0)
    return verdicts


@pytest.mark.parametrize("seed", [1])
def test_the_tree_against_a_plain_one(spark, seed):
    """Deep paths, wide levels, rules deep inside, hosts that are marked as a whole."""
    from pixelloom.llm.url_filter import BLOCK_WORDS

    rng = random.Random(seed)
    rules = (("bad.com", "/a/b/", "block"), ("mix.org", "/x/", "allow"), ("mix.org", "/x/y/z", "block"), ("spam.mix.org", "/a/", "allow"), ("net", "/", "block"), ("deep.com", "/d/d/d/d/d/e", "block"))
    urls = []
    for _ in range(700):
        host = rng.choice(["bad.com", "www.bad.com", "mix.org", "spam.mix.org", "one.net", "casino-x.com", "clean.com", "deep.com"])
        parts = [rng.choice(["a", "b", "x", "y", "z", "d", "e", str(rng.randint(0, 99)), "deadbeef01", f"s{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 5))]
        if host == "deep.com":
            parts = ["d"] * rng.randint(3, 6) + rng.choice([["e"], ["e1"], ["f"], ["e", "k"], []])
        urls.append(f"http://{host}" + rng.choice(["/", ""] if not parts else ["/"]) + "/".join(parts))
    want = plain_verdicts(urls, rules, BLOCK_WORDS)
    docs = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(5)
    got = {r["page_id"]: r["verdict"] for r in judge_urls(docs, rules=rules).collect()}
    assert got == want and {"block", "allow"} == set(want.values())


def test_many_branches_are_not_condemned_by_one(spark):
    """A ruled directory is no evidence about its siblings, at 4 or at 400 of them; paths that differ from the third segment on are told apart."""
    rows = [f"http://{h}.example.com/de/{i}" for h in ("few", "many") for i in range(20)]
    rows += [f"http://few.example.com/s{i % 4}/{i}" for i in range(40)] + [f"http://many.example.com/s{i}/{i}" for i in range(400)]
    got = judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert all((r["verdict"] == "block") == ("/de/" in r["path"]) for r in got)
    deep = [f"http://h.com/a/b/{'bad' if i % 2 else 'good'}/{i}" for i in range(60)] + [f"http://h.com/a/b/bad{i}" for i in range(5)] + ["http://h.com/a/b/bad"] * 2
    got = judge_urls(spark.createDataFrame(list(enumerate(deep)), "page_id long, url string"), rules=(("h.com", "/a/b/bad/", "block"),)).collect()
    assert all(r["verdict"] == ("block" if r["path"].startswith("/a/b/bad/") else "block" if r["path"] == "/a/b/bad" else "allow") for r in got)
