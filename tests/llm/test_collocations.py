import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, SF_DIR, docs
from oracle_check import compare, connect

from dialwise.llm import collocations as co
from dialwise.llm.queries import ORACLE, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, words=3, least=10, share=50, top=2000):
    """Rows (lang, text) to (lang, rank, phrase, a, l, r, n, score), as the rule is written."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            found = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(found)
            for k in range(1, words + 1):
                for i in range(len(found) - k + 1):
                    counts[lang or "und"][tuple(found[i : i + k])] += 1
    want = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longest = Counter()
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longest[g[i : i + k]] = max(longest[g[i : i + k]], a)
        scored = []
        for g, a in candidates.items():
            if not longest[g] or 100 * longest[g] < share * a:
                score, cut = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            want.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(want)


def found(frame):
    return sorted(map(tuple, frame.collect()))


def test_query_matches_duckdb(spark):
    query = QUERIES["op11_collocations"](spark, SF_DIR)
    assert query.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert compare(connect(SF_DIR), ORACLE["op11_collocations"], query) is None


def test_does_not_depend_on_chunks_partitions_and_broadcasts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(40)] + ["É", "the", "THE", "x\x0b", "a.b", "😀"]
    rows = [
        (["en", "de", None, "und"][i % 4], " ".join(rng.choice(vocab, rng.integers(0, 60)).tolist()))
        for i in range(400)
    ]
    rows += [("en", "New York\tcity hall! New York city hall\nnew york")] * 30
    monkeypatch.setattr(co, "CHUNK", 300)
    monkeypatch.setattr(co, "HELD", 700)
    monkeypatch.setattr(co, "MASS", 2_000)
    monkeypatch.setattr(co, "SECTION", 64)
    table = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert found(co.collocations(table, hot=3)) == by_hand(rows)
    assert found(co.collocations(table, words=2, least=4, share=30, top=7)) == by_hand(rows, 2, 4, 30, 7)
    assert found(co.collocations(table, words=4, least=6, top=None)) == by_hand(rows, 4, 6, 50, 10**9)


def test_a_phrase_in_a_third_of_all_texts(spark):
    rows = [("en", "same old line, " * 3)] * 500 + [("en", f"a{i} b{i % 9} c{i % 5}") for i in range(1000)]
    assert found(co.collocations(spark.createDataFrame(rows, "lang string, text string"))) == by_hand(rows)


def test_odd_rows_and_an_empty_table(spark):
    table = docs(spark, ODD).selectExpr("*", "'x' AS phrase", "1 AS a", "2 AS part", "3 AS n")
    rows = [("en", t) for _, t in ODD]
    assert found(co.collocations(table)) == by_hand(rows)
    assert co.collocations(table.limit(0)).count() == 0
    blank = spark.createDataFrame([("en", None), (None, " ;. "), (None, "")], "lang string, text string")
    assert co.collocations(blank).count() == 0


def test_counts_beyond_32_bits_stay_exact(spark):
    a, left, right = 10**13 + 7, 10**13 + 11, 3 * 10**14
    known = spark.createDataFrame(
        [("en", 2, "p q", a), ("en", 1, "p", left), ("en", 1, "q", right)],
        "lang string, size int, phrase string, a long",
    )
    sizes = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    row = co.scored_phrases(known, sizes).first()
    assert row["score"] == 10**6 * a * a // (left * right)


def test_misra_gries_keeps_every_frequent_key():
    rng = np.random.default_rng(3)
    keys = np.concatenate([rng.zipf(1.3, 30_000) % 5_000, rng.integers(0, 10**6, 30_000)]).astype(np.uint32)
    rng.shuffle(keys)
    for least in (2, 10, 200):
        parts = np.array_split(keys, 23)
        left, right = (co.MisraGries(len(keys) // least + 1) for _ in "ab")
        for i, part in enumerate(parts):
            (left if i % 2 else right).merge(part, np.ones(len(part)))
        left.merge(right.keys, right.counts, right.off)
        distinct, counts = np.unique(keys, return_counts=True)
        assert left.off < least and left.off * (left.capacity + 1) <= len(keys)
        assert set(distinct[counts >= least]) <= set(left.reaching(least))
        true = dict(zip(distinct.tolist(), counts.tolist()))
        for key, count in zip(left.keys.tolist(), left.counts.tolist()):
            assert count <= true[key] <= count + left.off


def test_numbers_survive_packing():
    for kind in (np.uint32, np.int32):
        for n in (0, 1, 1000):
            values = np.arange(n).astype(kind) * 7
            assert co.unpack(co.pack(values), kind).tolist() == values.tolist()


@pytest.mark.parametrize("size", [16, 1 << 22])
def test_sections_end_where_pieces_end(size):
    raw = b"one two three. four five six! seven" + b" eight" * 20 + b"; nine"
    parts = list(co._sections(raw, size))
    assert b"".join(parts) == raw and all(p[-1:] in b".!;" for p in parts[:-1])
    held = co._Held()
    for part in parts:
        held.add(part)
    batch = held.chunk("en", 0)
    assert isinstance(batch, pa.RecordBatch) and batch["n_words"][0].as_py() == 28
