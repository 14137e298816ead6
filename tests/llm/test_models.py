"""Toxicity and language-model scoring."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import ODD, SF_DIR, docs, texts

from dialwise.llm import lm, toxicity
from dialwise.llm.ngram_trie import LOWEST, Bigrams, EliasFano, Unigrams, open_arrays, quantise, restored
from dialwise.llm.queries import QUERIES
from dialwise.session import new_table_path

STEMS = ("vermlo", "quazbi", "drimpf", "zolthu")


def made_up(n, share=0.3):
    """Texts of invented words; toxic ones hold stems with endings never seen twice."""
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(plain, rng.integers(40, 120)).tolist()
        toxic = int(rng.random() < share)
        for _ in range(3 * toxic):
            ending = "".join(rng.choice(list("bcdfghkm"), 3))
            words.insert(int(rng.integers(len(words))), STEMS[rng.integers(len(STEMS))] + ending)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_unseen_spellings_are_found_on_held_out_texts(spark):
    rows, labels = made_up(900)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows), table).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in held if not found[i]["held_out"]] == [] and len(held) > 200
    wrong = [i for i in held if found[i]["predicted"] != labels[i][2]]
    assert len(wrong) <= 0.03 * len(held)
    clean_hit = [i for i in held if found[i]["predicted"] and not labels[i][2]]
    assert len(clean_hit) <= 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())


def test_odd_rows_get_scores_and_labels_may_be_odd(spark):
    rows, labels = made_up(60)
    odd = [(None, None, 1), (7, 1, None), (8, None, 1), (8, None, 0)]
    table = spark.createDataFrame(labels + odd, "doc_id bigint, quality int, toxic int")
    mixed = docs(spark, rows + [(1000 + (i or 0), t) for i, t in ODD] + [(None, "x")])
    found = toxicity.toxicity(mixed, table).collect()
    assert len(found) == 60 + len(ODD) + 1
    same = {round(r["score"], 12) for r in found if r["doc_id"] in (1001, 1002, 1003)}
    assert len(same) == 1 and max(same) < 0.7
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    none = toxicity.toxicity(docs(spark, ODD), table.limit(0)).collect()
    assert len(none) == len(ODD) and max(r["score"] for r in none) < 1e-6
    assert toxicity.toxicity(mixed.limit(0), table).count() == 0
    kept = toxicity.drop_toxic(docs(spark, ODD), table.limit(0))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(ODD)


def test_a_long_text_scores_by_its_worst_passage():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), -3.0)
    words = [b"w%d" % i for i in range(5000)] + [b"insult"]
    buckets, _ = toxicity.gram_buckets([b"insult"])
    model.weight[buckets] = 90.0
    scores = toxicity.word_scores(words, model.weight)
    value, begin = toxicity.worst_passages(scores)
    assert value > 10 and begin[0] >= 5001 - 2 * toxicity.WINDOW
    assert model.chance(value) > 0.99 > 0.1 > model.chance(toxicity.worst_passages(scores[:100])[0])


@pytest.mark.parametrize(
    "n,top",
    [(0, 1), (1, 0), (5, 9), (1000, 10**6), (3000, 2**50), (2000, 2001), (700, 2**64 - 1), (3, 2**64 - 1)],
)
def test_elias_fano_finds_every_value_and_no_other(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    level = EliasFano.of(values)
    assert level.at(np.arange(len(values))).tolist() == values.tolist()
    asked = np.concatenate([values, rng.integers(0, top, 300, dtype=np.uint64, endpoint=True)])
    place = level.find(asked)
    assert ((place >= 0) == np.isin(asked, values)).all()
    assert (values[place[place >= 0]] == asked[place >= 0]).all()


def test_elias_fano_keeps_equal_neighbours_and_few_bits():
    values = np.sort(np.random.default_rng(2).integers(0, 500, 4000)).astype(np.uint64)
    assert EliasFano.of(values).at(np.arange(4000)).tolist() == values.tolist()
    wide = np.unique(np.random.default_rng(3).integers(0, 2**40, 100_000)).astype(np.uint64)
    level = EliasFano.of(wide)
    size = 8 * sum(x.nbytes for x in level.arrays("x").values()) / len(wide)
    # 40 bits a number as they are; log2(2^40 / n) + 2 bits, and the directory.
    assert size < 40 - math.log2(len(wide)) + 2 + 4


def test_levels_answer_from_their_files(tmp_path):
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 60, (800, 2)), axis=0)
    log10 = -rng.random(len(pairs)) * 9
    Bigrams.write(f"{tmp_path}/b", pairs[:, 0], pairs[:, 1], log10)
    trie = Bigrams.open(f"{tmp_path}/b")
    assert isinstance(trie.successors.high.base, np.memmap) and isinstance(trie.codes.base, np.memmap)
    codes = trie.find(pairs[:, 0], pairs[:, 1])
    assert np.abs(np.log10(restored(codes)) - log10).max() <= -LOWEST / 254 / 2 + 1e-9
    there = {tuple(p) for p in pairs.tolist()}
    a, b = rng.integers(0, 90, 2000), rng.integers(0, 90, 2000)
    assert [c > 0 for c in trie.find(a, b)] == [p in there for p in zip(a.tolist(), b.tolist())]
    words = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    counts = rng.integers(1, 10**12, len(words))
    Unigrams.write(f"{tmp_path}/u", words, counts)
    level = Unigrams.open(f"{tmp_path}/u")
    rank, found = level.find(np.concatenate([words, words + np.uint64(1)]))
    assert rank[: len(words)].tolist() == list(range(len(words))) and (rank[len(words) :] == -1).all()
    assert found.tolist() == counts.tolist() + [0] * len(words)
    for level in (Bigrams.open(f"{tmp_path}/none"), Bigrams.open(_empty(f"{tmp_path}/e"))):
        assert level.find(np.array([0]), np.array([0])).tolist() == [0]
    assert open_arrays(f"{tmp_path}/none") is None
    assert Unigrams.open(f"{tmp_path}/none").find(words[:3])[0].tolist() == [-1] * 3
    assert quantise(np.array([0.0, LOWEST])).tolist() == [255, 1]


def _empty(path):
    none = np.zeros(0, np.int64)
    Bigrams.write(path, none, none, np.zeros(0))
    return path


def scores_by_hand(rows, mu=lm.MU, train=None):
    def tokens(text):
        return (text or "").encode().lower().split() + ["end"]

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 10 == 0

    count, pairs, begins = Counter(), Counter(), 0
    for i, text in rows if train is None else train:
        if train is not None or not out(i):
            own = tokens(text)
            count.update(own)
            pairs.update(zip(["begin", *own], own))
            begins += 1
    total, known = sum(count.values()), len(count)
    found = []
    for i, text in rows:
        own = tokens(text)
        single = [(count[w] + 0.1) / (total + 0.1 * (known + 1)) for w in own]
        base = sum(map(math.log10, single))
        whole = 0.0
        for before, w, p in zip(["begin", *own], own, single):
            n = begins if before == "begin" else count[before]
            whole += math.log10((pairs[before, w] + mu * p) / (n + mu)) if n else math.log10(p)
        found.append((i, out(i), len(own), sum(count[w] > 0 for w in own), total, base, whole))
    return found


def check_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= 0.03 * w[2] + 1e-9
    return got


def test_scores_of_all_documents_match_counting_by_hand(spark):
    got = check_scores(QUERIES["op7_lm_score"](spark, SF_DIR).collect(), scores_by_hand(texts()))
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)


def test_scores_do_not_depend_on_chunks_and_shards(spark, monkeypatch):
    rows = [(i, f"a b c d{i % 7} e{i} the the the cat {'x ' * (i % 50)}") for i in range(400)]
    rows += [*ODD, (10, "the cat"), (10, "the cat")]
    monkeypatch.setattr(lm, "SHARD", 2000)
    table = docs(spark, rows).repartition(7)
    check_scores(lm.score(table).collect(), scores_by_hand(rows))


def test_a_kept_model_scores_other_texts_without_counting(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 1500)
    rows = [(i, f"a b c d{i % 7} e{i} the the cat {'x ' * (i % 30)}") for i in range(300)]
    folder = new_table_path(spark, "model")
    lm.train(docs(spark, rows), folder, fold=-1)
    model = lm.Model.open(folder)
    assert model.shards > 2 and model.tokens == sum(len(t.split()) + 1 for _, t in rows)
    other = [(1000 + i, t) for i, t in enumerate(["the cat", "", "a b unseen words c d3", "x " * 99, None])]
    own = {r[0]: r for r in lm.score(docs(spark, rows + other), fold=-1, model=model).collect()}
    again = {r[0]: r for r in lm.score(docs(spark, rows), fold=-1).collect()}
    for i, row in again.items():
        assert own[i] == row
    by_hand = scores_by_hand([(i, t) for i, t in rows + other], train=rows)
    for i, _, n, known, total, base, whole in by_hand:
        got = own[i]
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (n, known, total)
        assert got["base_score"] == pytest.approx(base, rel=1e-9)
        assert abs(got["score"] - whole) <= 0.03 * n + 1e-9


def test_long_texts_are_split_in_sections():
    text = b"one two\tthree " * 50 + b"x" * 500 + b" end"
    for size in (1, 7, 64, 1 << 22):
        assert [w for part in lm._split_words(text, size) for w in part] == text.split()


def test_without_training_rows_and_without_rows(spark):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    rows = [(i, "only held out words") for i in held]
    check_scores(lm.score(docs(spark, rows)).collect(), [
        (i, True, 5, 0, 0, 0.0, 0.0) for i in held
    ])
    assert lm.score(docs(spark, rows).limit(0)).count() == 0


def test_scores_match_a_slow_scorer_over_every_passage(spark):
    """The learnt model applied word by word, n-gram by n-gram and passage by passage."""
    rows, labels = made_up(120)
    rows += [(1000 + (i or 0), t) for i, t in ODD if t is None or len(t) < 5000]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs(spark, rows), table)
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs(spark, rows), table).collect()}

    def word(w):
        marked = b"<%b>" % w
        total, grams = 0.0, 0
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                code = sum(c * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, c in enumerate(marked[i : i + n]))
                code = (code + n) * 0xD6E8FEB86659FD93 % (1 << 64) >> 46
                total += float(model.weight[code % toxicity.BUCKETS])
                grams += 1
        return total / grams

    for i, text in rows:
        words = [word(w) for w in dict.fromkeys((text or "").lower().encode().split())]
        size = toxicity.WINDOW
        ends = [*range(0, max(len(words) - size, 0), toxicity.STEP), max(len(words) - size, 0)]
        means = [sum(words[a : a + size]) / len(words[a : a + size]) for a in ends] if words else [0.0]
        want = 1 / (1 + math.exp(-max(-50, min(50, max(means) + model.bias))))
        assert found[i] == pytest.approx(want, rel=1e-4, abs=1e-9)
