"""Small tables with every unusual case: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """Documents from (doc_id, text), with two more columns than usual, named like internal ones."""
    frame = spark.createDataFrame(
        [(i, t, "en", None, len(t or "")) for i, t in rows], DOCS
    )
    names = "digest won_digest won_id place fp kept_id kept_fp score found candidate_id assign row"
    for name in names.split():
        frame = frame.selectExpr("*", f"'x' AS `{name}`")
    return frame


SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (None, "a text without id"),
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two  three\nfour five"),
    (4, "one two  three\nfour five"),
    (5, "one two three four five"),
    (6, LONG),
    (7, f"é 😀 {SECRET} end"),
    (8, "word"),
    (9, "\x00 odd ﬁ ‮ 　 ▁▁ x"),
]


def texts(path="documents"):
    """(doc_id, text) of the smallest test table, read without Spark."""
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF_DIR}/{path}.parquet", columns=["doc_id", "text"])
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
