"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (3 to 5 bytes of ``<word>``, hashed), so
unseen misspellings and endings share vectors with the words they resemble. A passage of ``WINDOW``
words is the mean of its words, and a linear softmax on it gives the chance of toxicity. A document
scores as its most toxic passage, so that a few insults are not averaged away in a long text. Passages
overlap by half and run over the first place of every different word: words that come again form no
further passage, however dense they stand there. Embeddings and softmax are trained jointly with Adagrad.

Learning takes a bounded sample of labelled rows, ``TOXIC_SAMPLE`` toxic and ``CLEAN_SAMPLE`` clean
ones (documented bounds; the smallest hashes of the ids), with their whole texts, in one task. Scoring reads every
whole text where it lies; no row moves, and what is broadcast is one number per hash bucket.

Defined cases: a null or empty text scores as the model's bias; a row without an id is not learnt
from; labels that contradict each other count as toxic, null labels not at all; without any label
every score is 0; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dialwise.llm.common import filled, fresh

WINDOW, STEP = 6, 3
BUCKETS, SIZE = 1 << 18, 8
GRAMS = (3, 4, 5)
TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 4500
WARM, EPOCHS, BATCH, RATE, SEED = 6, 12, 64, 0.15, 7
#: An n-gram that so few words of the sample hold keeps a zero vector, as one that is not seen at all.
LEAST_SEEN = 5
THRESHOLD = 0.7
#: Words whose scores a worker keeps between documents, and texts it looks at together.
CACHED, TOGETHER = 200_000, 500


def words_of(text: str) -> list[bytes]:
    """The different words of a text, in the order in which they first appear."""
    return list(dict.fromkeys(text.lower().encode().split()))


def gram_buckets(words: list[bytes], together: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """The hash buckets of the words' n-grams, word after word, and where each word's begin."""
    parts = [_buckets(words[i : i + together]) for i in range(0, len(words), together)]
    count = np.concatenate([n for _, n in parts])
    return np.concatenate([b for b, _ in parts]), np.cumsum(count) - count


def _buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    marked = b"".join(b"<%b>" % w for w in words)
    letters = np.frombuffer(marked, np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(lengths), lengths)
    at, word = np.arange(len(letters)), np.repeat(np.arange(len(words)), lengths)
    found, owner = [], []
    code = np.zeros(len(letters), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        code[: len(letters) - n + 1] += letters[n - 1 :] * np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))
        if n in GRAMS:
            # A word shorter than its shortest n-gram still has one, cut at its end.
            fits = at + n <= ends
            found.append((code[fits] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(46))
            owner.append(word[fits])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    count = np.bincount(owner_all, minlength=len(words))
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int32), count


def word_scores(words: list[bytes], weight: np.ndarray) -> np.ndarray:
    if not words:
        return np.zeros(0)
    buckets, start = gram_buckets(words)
    count = np.diff(np.append(start, len(buckets)))
    return np.add.reduceat(weight[buckets], start) / count


def passages(n: int) -> np.ndarray:
    """Where the passages of a text of n words begin; the last one ends with the text."""
    return np.append(np.arange(0, max(n - WINDOW, 0), STEP), max(n - WINDOW, 0))


def worst_passages(scores: np.ndarray, most: int = 1) -> tuple[float, np.ndarray]:
    """The largest mean score of a passage, and where the ``most`` passages of largest mean begin."""
    if not len(scores):
        return 0.0, np.zeros(1, int)
    start, total = passages(len(scores)), np.append(0.0, np.cumsum(scores))
    stop = np.minimum(start + WINDOW, len(scores))
    mean = (total[stop] - total[start]) / (stop - start)
    best = np.argsort(-mean, kind="stable")[:most] if most > 1 else [mean.argmax()]
    return float(mean[best[0]]), start[best]


@dataclass
class Model:
    """What scoring needs of embeddings and softmax: one number per bucket, and the bias."""

    weight: np.ndarray
    bias: float

    def chance(self, mean_score: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(mean_score + self.bias, -50, 50))))


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """Embeddings and softmax by Adagrad on the currently worst passages of each text."""
    if not len(texts) or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS), -50.0 if not len(texts) or not toxic.max() else 50.0)
    vocab: dict[bytes, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
    buckets, start = gram_buckets(list(vocab) or [b""])
    count = np.diff(np.append(start, len(buckets)))
    del vocab
    rng = np.random.default_rng(SEED)
    embed = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE))
    spread = np.bincount(np.concatenate(docs), minlength=len(count))
    often = np.bincount(buckets, np.repeat(spread, count), BUCKETS) >= LEAST_SEEN
    embed *= often[:, None]
    seen = np.full(embed.shape, 1e-6)
    soft, bias = rng.uniform(-1, 1, (SIZE, 2)), np.zeros(2)
    repeats = max(1, 6000 // len(docs))
    for epoch in range(WARM + EPOCHS):
        weight = embed @ (soft[:, 1] - soft[:, 0])
        scores = np.add.reduceat(weight[buckets], start) / count
        chosen, of = [], []
        for i, d in enumerate(docs):
            begins = []
            if epoch >= WARM:
                begins = worst_passages(scores[d], 1 + toxic[i])[1].tolist()
                begins *= repeats if toxic[i] else 1
            # At first any passage stands for its text; later only those of clean texts do.
            if epoch < WARM or not toxic[i]:
                begins += rng.choice(passages(len(d)), 2 * repeats).tolist()
            chosen += [d[begin : begin + WINDOW] for begin in begins]
            of += [i] * len(begins)
        of = np.array(of)
        # Both classes weigh the same, however rare one of them is.
        share = np.where(toxic[of] == 1, 0.5 / toxic[of].mean(), 0.5 / (1 - toxic[of].mean()))
        for batch in np.array_split(rng.permutation(len(of)), len(of) // BATCH + 1):
            lengths = np.array([len(chosen[i]) for i in batch])
            word = np.concatenate([chosen[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), lengths)
            n = count[word]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[word], n)
            part = np.repeat(1 / (n * lengths[doc]), n)
            owner, rows = np.repeat(doc, n), buckets[at]
            mean = np.zeros((len(batch), SIZE))
            np.add.at(mean, owner, embed[rows] * part[:, None])
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), toxic[of[batch]]] -= 1
            p *= share[batch][:, None] / len(batch)
            by_mean = p @ soft.T
            used, place = np.unique(rows, return_inverse=True)
            step = np.zeros((len(used), SIZE))
            np.add.at(step, place, by_mean[owner] * part[:, None])
            step *= often[used][:, None]
            seen[used] += step**2
            embed[used] -= RATE * step / np.sqrt(seen[used])
            soft -= RATE * mean.T @ p
            bias -= RATE * p.sum(axis=0)
    return Model(embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def held_out(doc_id: str | Column, fold: int = 1, folds: int = 3) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; false for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the bounded sample of labelled rows that are not held out."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    rank = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = (
        known.where("toxic = 1").orderBy(*rank).limit(TOXIC_SAMPLE)
        .unionByName(known.where("toxic <> 1").orderBy(*rank).limit(CLEAN_SAMPLE))
    )
    rows = (
        docs.select("doc_id", filled("text").alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )
    found = rows.coalesce(1).mapInArrow(_train, "weight binary, bias double").first()
    if found is None:  # no row, no task
        return train([], np.zeros(0, int))
    return Model(np.frombuffer(found.weight, np.float32), found.bias)


def _train(batches):
    """The model of all rows (at most ``TOXIC_SAMPLE`` + ``CLEAN_SAMPLE``), in order of their ids."""
    rows = sorted(
        row
        for batch in batches
        for row in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "toxic", "text")))
    )
    toxic = np.array([t == 1 for _, t, _ in rows], int)
    model = train([text for _, _, text in rows], toxic)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([model.weight.astype(np.float32).tobytes()], pa.binary()),
            pa.array([model.bias], pa.float64()),
        ],
        names=["weight", "bias"],
    )


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The chance of toxicity of each text; ``BUCKETS`` numbers are broadcast."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weight, model.bias))
    return F.arrow_udf(_scorer(sent), DoubleType())(filled(text_col))


def _scorer(sent):
    cached: dict[bytes, float] = {}

    def run(text: pa.Array) -> pa.Array:
        weight, bias = sent.value
        model, out = Model(weight, bias), []
        for begin in range(0, len(text), TOGETHER):
            docs = [words_of(t) for t in text[begin : begin + TOGETHER].to_pylist()]
            new = list({w for d in docs for w in d if w not in cached})
            fresh_scores = dict(zip(new, word_scores(new, weight).tolist()))
            if len(cached) + len(new) > CACHED:
                fresh_scores |= {w: cached[w] for d in docs for w in d if w in cached}
                cached.clear()
            cached.update(fresh_scores)
            for d in docs:
                out.append(model.chance(worst_passages(np.array([cached[w] for w in d]))[0]))
        return pa.array(out, pa.float64())

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    score = score_texts(docs, learn(docs, labels))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more, all columns kept."""
    (score,) = fresh(docs, "score")
    scored = docs.withColumn(score, score_texts(docs, learn(docs, labels)))
    return scored.where(F.col(score) < THRESHOLD).drop(score)
