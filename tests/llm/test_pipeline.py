"""The pipeline against a plain version in Python."""

import hashlib
from array import array
from collections import Counter

import corpus_pipeline
import duckdb
import sentencepiece

from pixelloom.llm import queries
from pixelloom.llm.common import table
from pixelloom.llm.pieces import default_model

from .test_simhash import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.001"


def plain(docs):
    con = duckdb.connect()

    def ask(name, rows):
        import pandas as pd

        con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
        out = con.execute(queries.ORACLE_SQL[name]).fetchdf()
        con.unregister("documents")
        return out

    good = set(ask("op2_quality_rules", docs).query("kept").doc_id)
    docs = [d for d in docs if d[0] in good]
    single = set(ask("op10_exact_dedup", docs).query("kept").doc_id)
    docs = [d for d in docs if d[0] in single]
    component = plain_components([d[0] for d in docs], [plain_fingerprint(d[1]) for d in docs])
    docs = [d for d, c in zip(docs, component) if d[0] == c]
    taken = {r.doc_id: r.taken // r.size for r in ask("op5_mixing", docs).itertuples()}
    sp = sentencepiece.SentencePieceProcessor(model_proto=default_model())
    out = Counter()
    for i, text, _ in docs:
        if taken[i]:
            ids = sp.encode(text, add_bos=True, add_eos=True)
            out[i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += taken[i]
    return out


def test_run_against_the_plain_version(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, DATA, "documents").collect()]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == plain(docs) and got


def test_every_stage_keeps_the_columns_and_takes_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid long, kept boolean"
    long = " ".join(f"the w{i} of x{i}" for i in range(30))
    rows = [(1, long, "en", "a", 1, 1, True), (1, long, "en", "a", 1, 1, True), (None, long + " more", None, None, None, None, None), (2, None, "en", "a", 0, 1, True), (3, "", "en", None, 0, 1, True), (4, "the of and to in is " * 50_000, "en", "b", 1, 1, True)]
    for name, made in (("full", rows), ("none", [])):
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.collect()
            if name == "none":
                assert out.count() == 0


def test_tables_of_finished_stages_are_removed(spark, tmp_path, monkeypatch):
    from pixelloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path / "shared"))
    out = corpus_pipeline.run(spark, DATA)
    left = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").iterdir())
    assert left == ["mixing"] and out.count() > 0
