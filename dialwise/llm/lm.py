"""Language-model scoring with an Elias-Fano n-gram trie that is kept.

The model is a bigram one with Dirichlet smoothing: n(c, w) of the training part discounted by the
context's count plus ``mu``, and the rest of the mass by unigrams with 0.1 added to every count. It lives
in a folder of the shared file system: per shard a level of words with exact counts, and a level of
contexts, pointers, successors and quantised probabilities (``ngram_trie.py``). :func:`train` writes it,
:func:`score` opens the levels memory-mapped, for the texts it was trained on or for any others.

Neither model nor texts pass through one place. Documents are read once into chunks of about ``CHUNK``
tokens (word hashes and the places of words), a bucketed table in the shared folder, so that answers
come to the chunks and chunks are never shuffled. A chunk's distinct words go to the shards by ranges of
their hashes, then its distinct bigrams by context, those of frequent contexts by context and word, with
the context's count sent along. In training a shard adds up the counts of all chunks and writes its part
of the levels; then, as in scoring alone, it opens the part and answers each chunk from it. A row of
these exchanges holds what one chunk asks of one shard, at least one key, so there are never more rows
than distinct words and bigrams of chunks.

Words are told apart by 64-bit hashes, and word numbers have 32 bits: more than 4 billion different
words raise an error.

Defined cases: a null or empty text has its end token alone; a null id counts as training; without
training rows counts are zero; repeated rows are scored (and learnt from) each; an empty table gives an
empty result; a document is never cut, so a chunk is as long as its longest one at least; other columns
are ignored.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.llm.common import filled
from dialwise.llm.ngram_trie import Bigrams, Unigrams, restored
from dialwise.session import bucketed, frozen, new_table_path

ADD, MU = 0.1, 4.0
CHUNK, SHARD = 1_500_000, 3_000_000
#: Bytes of a text that are split into words at once.
SECTION = 1 << 22
END = xxhash.xxh64_intdigest(b"")
BEGIN = (1 << 32) - 1

_CHUNK_FIELDS = [
    ("number", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
    ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("places", pa.binary()),
    ("tokens", pa.binary()), ("n_tokens", pa.int64()), ("n_train", pa.int64()), ("n_begin", pa.int64()),
]
_CHUNK = (
    "number int, doc_ids array<long>, held_out array<boolean>, lengths array<long>, words binary,"
    " places binary, tokens binary, n_tokens long, n_train long, n_begin long"
)
_ASKED = "shard long, chunk long, keys binary, counts binary, hot binary, hot_counts binary"
_ASKED_FIELDS = [
    ("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()),
    ("hot", pa.binary()), ("hot_counts", pa.binary()),
]
_WORDS = "shard long, chunk long, known binary, ranks binary, counts binary, new long"
_CODES = "shard long, chunk long, codes binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Model:
    """A trained model: its folder, and what scoring needs beside the levels."""

    folder: str
    shards: int
    tokens: int
    known: int
    begins: int
    hot: float
    mu: float

    def save(self) -> Model:
        system, name = pafs.FileSystem.from_uri(f"{self.folder}/model.json")
        with system.open_output_stream(name) as out:
            out.write(json.dumps(asdict(self)).encode())
        return self

    @classmethod
    def open(cls, folder: str) -> Model:
        system, name = pafs.FileSystem.from_uri(f"{folder}/model.json")
        with system.open_input_file(name) as file:
            return cls(**json.loads(file.read()) | {"folder": folder})

    def level(self, name: str, shard: int) -> str:
        return f"{self.folder}/{name}-{shard:07d}"


def packed(numbers: np.ndarray) -> bytes:
    """Bytes of whole numbers, same places of all numbers together, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    head = np.array([len(numbers)], np.int64).tobytes()
    return head + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind) -> np.ndarray:
    (n,) = np.frombuffer(raw, np.int64, 1)
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(raw[8:], int(n) * size, codec="zstd", asbytes=True)
    flat = np.frombuffer(planes, np.uint8).reshape(size, int(n))
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def _steps(rising: np.ndarray) -> bytes:
    """Sorted unsigned numbers, as packed differences."""
    return packed(np.diff(rising, prepend=np.zeros(1, rising.dtype)))


def _risen(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unpacked(raw, kind), dtype=kind)


# Texts to chunks.


class _Numbers(dict):
    """Words numbered in the order they come."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _split_words(text: bytes, size: int):
    """The words of a text, some at a time."""
    start = 0
    while len(text) - start > size:
        end = next((i for i in range(start + size, len(text)) if text[i] in b" \t\n\v\f\r"), len(text))
        yield text[start:end].split()
        start = end
    yield text[start:].split()


class _Reading:
    """The documents that a task has read and not yet written."""

    def __init__(self):
        # Number 0 is the end of a text.
        self.numbers, self.arrays = _Numbers({b"": 0}), []
        self.doc_ids, self.held_out, self.lengths, self.size = [], [], [], 0

    def add(self, doc_id, held_out: bool, text: bytes, section: int) -> None:
        before = self.size
        for words in _split_words(text.lower(), section):
            self.arrays.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
        self.arrays.append(np.zeros(1, np.int32))
        self.size += 1
        self.doc_ids.append(doc_id)
        self.held_out.append(held_out)
        self.lengths.append(self.size - before)

    def chunk(self, number: int) -> pa.RecordBatch:
        hashes = np.array([*map(xxhash.xxh64_intdigest, self.numbers)], np.uint64)
        order = np.argsort(hashes)
        train = sum(n for n, out in zip(self.lengths, self.held_out) if not out)
        row = {
            "number": number, "doc_ids": self.doc_ids, "held_out": self.held_out, "lengths": self.lengths,
            "words": _steps(hashes[order]), "places": packed(order.astype(np.int32)),
            "tokens": packed(np.concatenate(self.arrays)), "n_tokens": self.size, "n_train": train,
            "n_begin": len(self.held_out) - sum(self.held_out),
        }
        return pa.RecordBatch.from_pylist([row], pa.schema(_CHUNK_FIELDS))


def _chunks(size: int, section: int):
    def run(batches):
        held, number = _Reading(), 0
        for batch in batches:
            ids, outs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, out, text in zip(ids, outs, batch.column(2)):
                held.add(doc_id, out, text.as_buffer().to_pybytes(), section)
                if held.size >= size:
                    yield held.chunk(number)
                    held, number = _Reading(), number + 1
        if held.size:
            yield held.chunk(number)

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16)


def _range_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each word: a range of hashes, so sorted words are sorted by shard."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _runs(shard: np.ndarray):
    cuts = np.flatnonzero(np.diff(shard)) + 1
    edges = [0, *cuts.tolist(), len(shard)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


class _Chunk:
    """A chunk's tokens, and what the shards know of its words."""

    def __init__(self, row: dict, model: Model):
        self.name, self.model = {"chunk": row["chunk"]}, model
        self.doc_ids, self.held_out = row["doc_ids"], row["held_out"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.places = unpacked(row["places"], np.int32)
        self.tokens = unpacked(row["tokens"], np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = ~np.repeat(np.array(self.held_out, bool), self.lengths)
        if "of_words" in row:
            ids, counts = [], []
            for part in sorted(row["of_words"], key=lambda p: p["shard"]):
                known = np.unpackbits(
                    np.frombuffer(part["known"], np.uint8, offset=8),
                    count=int.from_bytes(part["known"][:8], "little"),
                ).astype(bool)
                own_ids, own_counts = np.full(len(known), -1), np.zeros(len(known), np.int64)
                own_ids[known] = _risen(part["ranks"], np.uint32) * model.shards + part["shard"]
                own_counts[known] = unpacked(part["counts"], np.int64)
                ids.append(own_ids)
                counts.append(own_counts)
            self.ids, self.counts = np.empty(len(self.places), np.int64), np.empty(len(self.places), np.int64)
            self.ids[self.places], self.counts[self.places] = np.concatenate(ids), np.concatenate(counts)

    def bigrams(self):
        """Per token the number and count of its context, and the key of its bigram (-1: unknown)."""
        before = np.roll(self.tokens, 1)
        context, count = self.ids[before], self.counts[before]
        context[self.starts], count[self.starts] = BEGIN, self.model.begins
        word = self.ids[self.tokens]
        known = (context >= 0) & (word >= 0) & (count > 0)
        return context, count, np.where(known, context << 32 | word, -1)

    def asked(self):
        """Distinct known keys with their shards and training counts, in order of shard and key."""
        context, count, key = self.bigrams()
        keys, first, back = np.unique(key, return_index=True, return_inverse=True)
        trained = np.bincount(back, self.train, len(keys)).astype(np.int64)
        frequent = count[first] > self.model.hot
        # The context alone, or with the word if the context is frequent; BEGIN is negative as 64 bits.
        dealt = np.where(frequent, keys, context[first] << 32)
        shard = (_mixed(dealt) % np.uint64(self.model.shards)).astype(np.int64)
        order = np.lexsort((keys.view(np.uint64), shard))
        order = order[keys[order] != -1]
        return keys[order], shard[order], trained[order], frequent[order], count[first][order], back, order


def _each_chunk(batches, model: Model):
    for batch in batches:
        for row in batch.to_pylist():
            yield row, _Chunk(row, model)


def _ask_words(model: Model):
    def run(batches):
        for row, chunk in _each_chunk(batches, model):
            words = _risen(row["words"], np.uint64)
            count = np.bincount(chunk.tokens, chunk.train, len(words)).astype(np.int64)[chunk.places]
            shard = _range_of(words, model.shards)
            out = [
                chunk.name | {
                    "shard": int(shard[a]), "keys": _steps(words[a:b]), "counts": packed(count[a:b]),
                    "hot": b"", "hot_counts": b"",
                }
                for a, b in _runs(shard)
            ]
            yield pa.RecordBatch.from_pylist(out, pa.schema(_ASKED_FIELDS))

    return run


def _asking(table: pa.Table):
    """The questions of all chunks to one shard: rows, the keys of each, distinct keys, their place."""
    rows = table.to_pylist()
    keys = [_risen(r["keys"], np.uint64) for r in rows]
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys]).tolist()
    return rows, distinct, back, [back[a:b] for a, b in zip([0, *ends], ends)]


def _total(rows: list, back: np.ndarray, size: int) -> np.ndarray:
    counts = np.concatenate([unpacked(r["counts"], np.int64) for r in rows])
    return np.bincount(back, counts, size).astype(np.int64)


def _answer_words(model: Model, training: bool):
    def run(table: pa.Table) -> pa.Table:
        rows, words, back, places = _asking(table)
        shard = rows[0]["shard"]
        path = model.level("unigrams", shard)
        if training:
            total = _total(rows, back, len(words))
            Unigrams.write(path, words[total > 0], total[total > 0])
        rank, counts = Unigrams.open(path).find(words)
        if len(rank) and rank.max() * model.shards + shard >= BEGIN:
            raise ValueError("more different words than word numbers")
        out = []
        for i, (row, at) in enumerate(zip(rows, places)):
            known = rank[at] >= 0
            out.append(
                {
                    "shard": shard, "chunk": row["chunk"],
                    "known": len(known).to_bytes(8, "little") + np.packbits(known).tobytes(),
                    "ranks": _steps(rank[at][known].astype(np.uint32)), "counts": packed(counts[at][known]),
                    "new": 0 if i else int((counts > 0).sum()),
                }
            )
        fields = [("known", pa.binary()), ("ranks", pa.binary()), ("counts", pa.binary()), ("new", pa.int64())]
        return pa.Table.from_pylist(out, pa.schema([*_ASKED_FIELDS[:2], *fields]))

    return run


def _ask_bigrams(model: Model):
    def run(batches):
        for _, chunk in _each_chunk(batches, model):
            keys, shard, trained, frequent, count, _, _ = chunk.asked()
            out = []
            for a, b in _runs(shard):
                own = np.flatnonzero(frequent[a:b]) + a
                contexts, first = np.unique(keys[own].view(np.uint64) >> np.uint64(32), return_index=True)
                out.append(
                    chunk.name | {
                        "shard": int(shard[a]), "keys": _steps(keys[a:b].view(np.uint64)),
                        "counts": packed(trained[a:b].astype(np.uint32)), "hot": packed(contexts),
                        "hot_counts": packed(count[own[first]]),
                    }
                )
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(_ASKED_FIELDS))

    return run


def _learn(rows: list, keys: np.ndarray, total: np.ndarray, mu: float, path: str) -> None:
    """Write the level of the bigrams that the training part has among ``keys``."""
    context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(BEGIN)).astype(np.int64)
    own = total > 0
    contexts, rank = np.unique(context[own], return_inverse=True)
    size = np.bincount(rank, total[own], len(contexts))
    # Not all successors of a frequent context are here; the chunks know its count.
    hot = np.concatenate([unpacked(r["hot"], np.uint64) for r in rows]).astype(np.int64)
    hot_counts = np.concatenate([unpacked(r["hot_counts"], np.int64) for r in rows])
    at = np.searchsorted(contexts, hot)
    there = np.flatnonzero(at < len(contexts))
    there = there[contexts[at[there]] == hot[there]]
    size[at[there]] = hot_counts[there]
    Bigrams.write(path, context[own], word[own], np.log10(total[own] / (size[rank] + mu)))


def _answer_bigrams(model: Model, training: bool):
    def run(table: pa.Table) -> pa.Table:
        rows, keys, back, places = _asking(table)
        path = model.level("bigrams", rows[0]["shard"])
        if training:
            counts = np.concatenate([unpacked(r["counts"], np.uint32) for r in rows])
            total = np.bincount(back, counts, len(keys)).astype(np.int64)
            _learn(rows, keys, total, model.mu, path)
            del counts, total
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(BEGIN)).astype(np.int64)
        codes = Bigrams.open(path).find(context, word)
        out = [
            {"shard": r["shard"], "chunk": r["chunk"], "codes": packed(codes[at])}
            for r, at in zip(rows, places)
        ]
        return pa.Table.from_pylist(out, pa.schema([*_ASKED_FIELDS[:2], ("codes", pa.binary())]))

    return run


def _score(model: Model):
    def run(batches):
        for row, chunk in _each_chunk(batches, model):
            context, count, _ = chunk.bigrams()
            _, _, _, _, _, back, order = chunk.asked()
            parts = sorted(row["of_bigrams"] or [], key=lambda p: p["shard"])
            found = np.zeros(int(back.max()) + 1)
            if len(order):
                found[order] = restored(np.concatenate([unpacked(p["codes"], np.uint8) for p in parts]))
            n = chunk.counts[chunk.tokens]
            single = (n + ADD) / (model.tokens + ADD * (model.known + 1))
            share = np.where((context >= 0) & (count > 0), model.mu / (count + model.mu), 1.0)
            whole = found[back] + share * single
            sums = [
                np.add.reduceat(x, chunk.starts)
                for x in ((n > 0).astype(np.int64), np.log10(single), np.log10(whole))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.doc_ids, pa.int64()), pa.array(chunk.held_out, pa.bool_()),
                    pa.array(chunk.lengths), *map(pa.array, sums),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


# The plan.


def _chunk_table(docs: DataFrame, id_col: str, text_col: str, fold: int, folds: int) -> DataFrame:
    """The chunks, bucketed by their number, so that answers are joined without moving them."""
    spark, doc_id = docs.sparkSession, F.col(id_col)
    out = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
    texts = docs.select(
        doc_id.alias("doc_id"), out.alias("held_out"), filled(text_col).cast("binary").alias("text")
    )
    chunks = texts.mapInArrow(_chunks(CHUNK, SECTION), _CHUNK)
    chunk = (F.spark_partition_id().cast("long") * (1 << 32) + F.col("number")).alias("chunk")
    return bucketed(chunks.select(chunk, "*").drop("number"), "chunk", "chunks")


def _with(chunks: DataFrame, answers: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """The chunks, each with its answers."""
    columns = [c for c in answers.columns if c != "chunk"]
    grouped = answers.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias(name))
    return chunks.drop("words").join(grouped, "chunk", how)


def _answered_words(chunks: DataFrame, model: Model, training: bool) -> DataFrame:
    asked = chunks.mapInArrow(_ask_words(model), _ASKED)
    return frozen(asked.groupBy("shard").applyInArrow(_answer_words(model, training), _WORDS), "words")


def _answered_bigrams(chunks: DataFrame, model: Model, training: bool) -> DataFrame:
    asked = chunks.mapInArrow(_ask_bigrams(model), _ASKED)
    return frozen(asked.groupBy("shard").applyInArrow(_answer_bigrams(model, training), _CODES), "codes")


def _learnt(chunks: DataFrame, folder: str, mu: float) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the training part of the chunks, and its answers to them."""
    n_tokens, n_train, begins = chunks.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_train", "n_begin")]
    ).first()
    shards = n_tokens // SHARD + 1
    system, name = pafs.FileSystem.from_uri(folder)
    system.create_dir(name, recursive=True)
    model = Model(folder, shards, n_train, 0, begins, n_tokens / shards / 16, mu)
    words = _answered_words(chunks, model, True)
    known = words.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]
    model = Model(**asdict(model) | {"known": known}).save()
    words = words.drop("new")
    return model, words, _answered_bigrams(_with(chunks, words, "of_words"), model, True)


def train(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", fold: int = 0,
    folds: int = 10, mu: float = MU,
) -> Model:
    """Learn a model from the rows that are not held out, and keep it in ``folder``."""
    return _learnt(_chunk_table(docs, id_col, text_col, fold, folds), folder, mu)[0]


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 0, folds: int = 10,
    mu: float = MU, model: Model | None = None,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Without a ``model`` one is learnt from the rows that are not held out.
    """
    chunks = _chunk_table(docs, id_col, text_col, fold, folds)
    if model is None:
        model, words, codes = _learnt(chunks, new_table_path(docs.sparkSession, "lm"), mu)
    else:
        words = _answered_words(chunks, model, False).drop("new")
        codes = _answered_bigrams(_with(chunks, words, "of_words"), model, False)
    answered = _with(chunks, words, "of_words")
    scored = _with(answered, codes, "of_bigrams", "left").mapInArrow(_score(model), _SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
