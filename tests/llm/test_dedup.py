import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from cases import ODD, SF_DIR, docs, texts

from dialwise.llm import exact_dedup, simhash
from dialwise.llm.components import components
from dialwise.llm.queries import QUERIES


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def copies_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    return groups


def test_copies_of_all_documents_match_brute_force(spark):
    rows = texts()
    groups = copies_by_hand(rows)
    found = {r["doc_id"]: r for r in QUERIES["op10_exact_dedup"](spark, SF_DIR).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        same = groups[normal(t)]
        r = found[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), i == min(same))
        assert r["text_sha256"] == hashlib.sha256(normal(t).encode()).hexdigest()


@pytest.mark.parametrize("counters", [1, 3, 256])
def test_odd_rows_and_few_counters(spark, counters):
    rows = [*ODD, *[(100 + i, "hot  text") for i in range(50)], (20, "hot\ntext"), (None, "hot text")]
    table = docs(spark, rows)
    found = exact_dedup.label_copies(table, counters=counters).collect()
    assert len(found) == len(rows)
    assert sum(r["kept"] for r in found) == len(copies_by_hand(rows))
    hot = [r for r in found if r["group_size"] == 52]
    assert len(hot) == 52 and {r["keep_id"] for r in hot} == {20}
    left = exact_dedup.drop_copies(table, counters=counters)
    assert left.columns == table.columns
    kept = sorted((normal(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in left.collect())
    want = sorted(
        (t, min((i for i in ids if i is not None), default=-1))
        for t, ids in copies_by_hand(rows).items()
    )
    assert kept == want


def test_an_empty_table_has_no_copies(spark):
    none = docs(spark, ODD).limit(0)
    assert exact_dedup.label_copies(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(rows):
    """Rows of (id, fingerprint) to the smallest id reachable, by comparing every pair."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = np.array([f for _, f in rows], np.uint64)
    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 2):
            x, y = sorted((find(a), find(int(b))))
            root[y] = x
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return [smallest[find(k)] for k in range(len(rows))]


def test_near_duplicates_of_all_documents_match_brute_force(spark):
    rows = [(i, fingerprint_by_hand(t)) for i, t in texts()]
    want = dict(zip((i for i, _ in rows), components_by_hand(rows)))
    prints = dict(rows)
    for r in QUERIES["op2_simhash"](spark, SF_DIR).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


def test_odd_rows_share_components(spark):
    near = [(50 + i, " ".join(["same", "words"] * 300 + [f"x{i}"])) for i in range(6)]
    rows = [*ODD, *near]
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r["component_id"] for r in found}
    assert by_id[1] == by_id[2] == by_id[3] == 1
    assert by_id[4] == 4 and by_id[5] == 4
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    per_component = {r["component_id"] for r in found if r["component_id"] is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(per_component)
    assert ids.count(None) == 1


def dense():
    """Clusters of fingerprints a few bits apart, as rows of id and signed fingerprint."""
    rng = random.Random(1)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            p = centre
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    rows = list(enumerate(sorted(prints)))
    return rows, [(i, int(np.uint64(p).astype(np.int64))) for i, p in rows]


def test_links_of_dense_fingerprints_match_brute_force(spark):
    rows, signed = dense()
    frame = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    found = {r["fp"]: r["component_id"] for r in simhash.component_of_fingerprints(frame).collect()}
    assert [found[f] for _, f in signed] == components_by_hand(rows)


def test_links_by_middle_words_match_brute_force(spark):
    rows, signed = dense()
    by_print = {f: i for i, f in signed}
    frame = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    edges = simhash._by_middle_words(frame)
    found = {by_print[r["node"]]: r["root"] for r in components(edges).collect()}
    want = components_by_hand(rows)
    groups = defaultdict(set)
    for i, root in found.items():
        groups[root].add(want[i])
    assert all(len(g) == 1 for g in groups.values())
    sizes = [want.count(w) for w in set(want)]
    assert len(groups) == sum(n > 1 for n in sizes) and len(found) == sum(n for n in sizes if n > 1)


def test_crowded_anchors_pass_their_fingerprints_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "LIMIT", 3)
    anchor = np.repeat([1, 2, 3], [2, 9, 2])
    fp = np.array([8, 9, *range(100, 109), 20, 21])
    cuts = [(0, 5), (5, 8), (8, 13)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(anchor[a:b]), pa.array(fp[a:b])], names=["anchor", "fp"])
        for a, b in cuts
    ]
    out = pa.Table.from_batches(list(simhash._compare(iter(batches))))
    rows = list(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    assert (9, 8) in rows and (21, 20) in rows
    assert {a for a, b in rows if b is None} == set(range(100, 109))


def test_every_close_pair_meets_at_a_home_anchor():
    rng = np.random.default_rng(3)
    fp = rng.integers(-(2**63), 2**63 - 1, 300)
    row, anchor = simhash.anchors(fp)
    near = {i: set() for i in range(len(fp))}
    for r, a in zip(row.tolist(), anchor.tolist()):
        near[r].add(a)
    sizes = [len(x) for x in near.values()]
    assert 40 < sum(sizes) / len(sizes) < 80 and len(row) == sum(sizes)
    for i in range(0, 300, 7):
        for bits in ([], [3], [5, 40], [63, 62], [0, 22], [23, 45]):
            other = fp[i]
            for b in bits:
                other = other ^ np.int64(-(2**63) if b == 63 else 1 << b)
            _, theirs = simhash.anchors(np.array([other]))
            assert near[i] & set(theirs.tolist())


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(80)] + [(7000, 7000)]
    frame = spark.createDataFrame(path + star, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components(frame).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[1000 + i] == 1000 for i in range(81))
    assert 7000 not in found
