"""The stages of the corpus pipeline, one after the other, against brute force."""

import re

from cases import ODD, SF_DIR, docs
from test_dedup import components_by_hand, copies_by_hand, fingerprint_by_hand
from test_secrets import spans_by_hand

import corpus_pipeline
from dialwise.llm import toxicity
from dialwise.llm.common import table
from dialwise.session import frozen


def test_every_stage_does_its_own_work(spark):
    rows = table(spark, SF_DIR, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "simhash near-dedup", "secret scans", "best-fit packing"]
    columns, kept = rows.columns, {}
    scored = toxicity.toxicity(rows, table(spark, SF_DIR, "labels")).where("predicted = 0")
    kept["toxicity"] = {r["doc_id"] for r in scored.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]
        rows = frozen(stage(spark, rows, SF_DIR), "stage")
        found = [r["doc_id"] for r in rows.select("doc_id").collect()]
        if name == "best-fit packing":
            assert set(found) == {i for i, _ in before}
            break
        assert rows.columns == columns and len(found) == len(set(found))
        if name == "exact dedup":
            kept[name] = {min(ids) for ids in copies_by_hand(before).values()}
        elif name == "simhash near-dedup":
            kept[name] = set(components_by_hand([(i, fingerprint_by_hand(t)) for i, t in before]))
        elif name == "secret scans":
            kept[name] = {i for i, t in before if not spans_by_hand(t)}
        assert set(found) == kept[name]


def test_run_and_odd_documents(spark, tmp_path):
    docs(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    none.write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in found.collect()}
    assert ids == {None, 1, 4, 6, 8, 9}
    assert corpus_pipeline.ORACLE_SQL is None and re.match("doc_id", found.columns[0])
