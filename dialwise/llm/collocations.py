"""Phrase collocations: frequent word sequences found by mergeable Misra-Gries summaries, then counted.

Texts become chunks of one language (distinct words and word numbers, a bucketed table in the shared
folder, so that answers come to the chunks and chunks are never shuffled). A chunk's distinct n-grams of
1 to ``words`` words, with their counts, are a Misra-Gries summary that is not full yet. Its shares go to
hash partitions of n-grams, each a row of sorted hashes, packed.

First pass: a hash partition merges its shares. Its capacity exceeds its mass (all occurrences dealt to
it) divided by the threshold, so what merging takes off every counter stays below the threshold, and
every n-gram that reaches it survives. Second pass: the partition counts the survivors exactly. Those
that do reach the threshold are spelled out once: the partition asks the first chunk that has one for
its words. So text moves once per frequent n-gram, whatever the number of chunks that hold it.

N-grams are told apart by a partition and 64 bits, from two hashes of each word. A partition holds some
millions of n-grams, so one in 10^12 frequent n-grams would be counted together with another one.

A row of the exchange holds at least one n-gram, so there are never more rows than distinct n-grams of
chunks, at any size of corpus. A word sequence in a third of all texts is one counter of each chunk.

The score of a phrase is its lowest over all cuts into two parts (ties: the shorter first part):
floor(1,000,000 a a / (l r)) in decimals, exact up to counts of 10^15. Counts of parts are joined by
phrase; the ``HOT`` parts that most phrases ask for are broadcast, the others have at most 1/``HOT`` of
all questions each.

Defined cases: a null text has no words; a null language is ``und``; repeated rows count each; a text
without words adds nothing; chunks end at the ends of pieces, and a piece is held whole; an empty table
gives an empty result; null ids and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialwise.llm.common import filled
from dialwise.session import bucketed, frozen

WORDS, LEAST, TOP, SHARE = 3, 10, 2000, 50
#: Tokens of a chunk, tokens held by a task, n-gram occurrences of a hash partition, broadcast parts,
#: groups of the first ranking.
CHUNK, HELD, MASS, HOT, SPREAD = 1_500_000, 3_000_000, 16_000_000, 4096, 32
#: Texts longer than this are read in sections that end where a piece ends.
SECTION = 1 << 22

#: Characters that end a piece.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(
    BREAKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(BREAKS) + b"abcdefghijklmnopqrstuvwxyz"
)

_CHUNK = "number int, lang string, words binary, tokens binary, n_words long"
_CHUNK_FIELDS = [
    ("number", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("tokens", pa.binary()),
    ("n_words", pa.int64()),
]
_SHARE = "bucket long, chunk long, hashes binary, counts binary, mass long"
_SHARE_FIELDS = [
    ("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()),
    ("mass", pa.int64()),
]
_KEPT = "bucket long, chunk long, spell binary, totals binary"
_KEPT_FIELDS = [*_SHARE_FIELDS[:2], ("spell", pa.binary()), ("totals", pa.binary())]
_PHRASES = "lang string, size int, phrase string, a long"
_PHRASE_FIELDS = [
    ("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())
]


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, equal places of all numbers together, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T) if len(numbers) else numbers
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(raw[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


# Texts to chunks.


class _Numbers(dict):
    """Words numbered in the order they come; number 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _sections(raw: bytes, size: int):
    """``raw`` in sections of at least ``size`` bytes that end where a piece ends."""
    start = 0
    while len(raw) - start > size:
        ends = [at for b in BREAKS if (at := raw.find(bytes([b]), start + size)) >= 0]
        if not ends:
            break
        yield raw[start : min(ends) + 1]
        start = min(ends) + 1
    yield raw[start:]


class _Held:
    """The words of one language that a task has read and not yet written."""

    def __init__(self):
        self.numbers, self.arrays, self.size = _Numbers(), [], 0

    def add(self, section: bytes) -> int:
        words = section.translate(_TABLE).replace(b".", b" . ").split()
        words.append(b".")
        self.arrays.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        return len(words)

    def chunk(self, lang: str, number: int) -> pa.RecordBatch:
        tokens = np.concatenate(self.arrays)
        words = pa.compress(b" ".join(self.numbers), codec="zstd", asbytes=True)
        length = sum(map(len, self.numbers)) + len(self.numbers) - 1
        row = {
            "number": number, "lang": lang, "words": length.to_bytes(8, "little") + words,
            "tokens": pack(tokens), "n_words": int(np.count_nonzero(tokens)),
        }
        return pa.RecordBatch.from_pylist([row], pa.schema(_CHUNK_FIELDS))


def _chunks(size: int, most: int, section: int):
    """Texts (lang, text) to chunks of about ``size`` tokens of a language; a task holds ``most``."""

    def run(batches):
        held: dict[str, _Held] = {}
        total = number = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in _sections(text.as_buffer().to_pybytes(), section):
                    own = held.setdefault(lang, _Held())
                    total += own.add(part)
                    if own.size >= size or total >= most:
                        full = lang if own.size >= size else max(held, key=lambda x: held[x].size)
                        out = held.pop(full)
                        total -= out.size
                        yield out.chunk(full, number)
                        number += 1
        for lang, own in held.items():
            yield own.chunk(lang, number)
            number += 1

    return run


# N-grams of a chunk.


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


class _Chunk:
    """Distinct n-grams of a chunk, level by level: word numbers, counts and hashes, in a fixed order."""

    def __init__(self, row: dict, buckets: int, words: int):
        raw = row["words"]
        size = int.from_bytes(raw[:8], "little")
        self.words = pa.decompress(raw[8:], size, codec="zstd", asbytes=True).split(b" ")
        tokens = unpack(row["tokens"], np.int32).astype(np.int64)
        lang = xxhash.xxh64_intdigest(row["lang"].encode())
        seeds = (lang, lang ^ 0x5DEECE66D)
        of_word = [np.array([xxhash.xxh64_intdigest(w, s) for w in self.words], np.uint64) for s in seeds]
        self.levels, hashes = [], ([], [])
        # ``place`` numbers the distinct n-grams that start at ``start``; longer ones extend them.
        start = np.flatnonzero(tokens)
        grams, place, counts = np.unique(tokens[start], return_inverse=True, return_counts=True)
        columns, own = [grams], [_mixed(h[grams]) for h in of_word]
        for size in range(1, words + 1):
            if size > 1:
                ends = np.minimum(start + size - 1, len(tokens) - 1)
                word = np.where(start + size - 1 < len(tokens), tokens[ends], 0)
                inside = word > 0
                start, place, word = start[inside], place[inside], word[inside]
                keys, place, counts = np.unique(
                    place * len(self.words) + word, return_inverse=True, return_counts=True
                )
                first, word = keys // len(self.words), keys % len(self.words)
                columns = [c[first] for c in columns] + [word]
                own = [_mixed(o[first] * np.uint64(3) + h[word]) for o, h in zip(own, of_word)]
            self.levels.append((columns, counts))
            for all_, level in zip(hashes, own):
                all_.append(level)
        self.counts = np.concatenate([c for _, c in self.levels])
        self.hashes, dealt = map(np.concatenate, hashes)
        self.bucket = (dealt % np.uint64(buckets)).astype(np.int32)
        self.order = np.lexsort((self.hashes, self.bucket))

    def shares(self):
        """(bucket, hashes in order, counts) for every hash partition that gets something."""
        hashes, counts, bucket = (x[self.order] for x in (self.hashes, self.counts, self.bucket))
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield int(bucket[a]), hashes[a:b], counts[a:b]


def _shares(buckets: int, words: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = [
                    {
                        "bucket": bucket, "chunk": row["chunk"],
                        "hashes": pack(np.diff(hashes, prepend=np.uint64(0))),
                        "counts": pack(counts.astype(np.uint32)), "mass": int(counts.sum()),
                    }
                    for bucket, hashes, counts in _Chunk(row, buckets, words).shares()
                ]
                yield pa.RecordBatch.from_pylist(out, pa.schema(_SHARE_FIELDS))

    return run


# Misra-Gries.


class MisraGries:
    """A summary of weighted keys with ``capacity`` counters.

    ``off`` is what merges have taken off every counter: a key's true count lies between its counter
    (0 if it has none) and its counter plus ``off``, and ``off`` * (capacity + 1) is at most the mass.
    """

    def __init__(self, capacity: int, kind=np.uint64):
        self.capacity, self.off = capacity, 0
        self.keys, self.counts = np.zeros(0, kind), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, off: int = 0) -> None:
        """Add another summary (any order, repeated keys allowed)."""
        both = np.concatenate([self.keys, keys])
        self.keys, place = np.unique(both, return_inverse=True)
        weights = np.concatenate([self.counts, counts.astype(np.int64)])
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(self.keys)))
        self.counts = np.add.reduceat(weights[order], starts) if len(order) else weights
        self.off += off
        if len(self.keys) > self.capacity:
            cut = len(self.keys) - self.capacity - 1
            least = int(np.partition(self.counts, cut)[cut])
            left = self.counts > least
            self.keys, self.counts = self.keys[left], self.counts[left] - least
            self.off += least

    def reaching(self, least: int) -> np.ndarray:
        """The keys that may have ``least`` occurrences; none that has is missing if off < least."""
        return self.keys[self.counts + self.off >= least]


def _frequent(least: int):
    """Merge the shares of one hash partition, count its survivors, and ask chunks to spell them out."""

    def run(table: pa.Table) -> pa.Table:
        # In the order of chunks, so that a repeated task asks the same ones.
        table = table.sort_by("chunk")
        rows = table.select(["bucket", "chunk"]).to_pylist()

        def shares():
            for hashes, counts in zip(table["hashes"], table["counts"]):
                keys = np.cumsum(unpack(hashes.as_py(), np.uint64), dtype=np.uint64)
                yield keys, unpack(counts.as_py(), np.uint32)

        capacity = int(pc.sum(table["mass"]).as_py()) // least + 1
        summary, waiting, held = MisraGries(capacity), [], 0
        for keys, counts in shares():
            waiting.append((keys, counts))
            held += len(keys)
            if held > capacity:
                summary.merge(*(np.concatenate(x) for x in zip(*waiting)))
                waiting, held = [], 0
        if waiting:
            summary.merge(*(np.concatenate(x) for x in zip(*waiting)))
        alive = summary.reaching(least)
        totals = np.zeros(len(alive) + 1, np.int64)

        def placed(keys):
            """The place of each key among the survivors, the last place for others."""
            at = np.searchsorted(alive, keys)
            return np.where(np.append(alive, 0)[at] == keys, at, len(alive)) if len(alive) else at

        for keys, counts in shares():
            np.add.at(totals, placed(keys), counts)
        open_ = totals >= least
        open_[-1] = False
        for row, (keys, _) in zip(rows, shares()):
            at = placed(keys)
            spell = open_[at]
            open_[at] = False
            row["spell"] = len(keys).to_bytes(8, "little") + np.packbits(spell).tobytes()
            row["totals"] = pack(totals[at[spell]])
        return pa.Table.from_pylist(rows, pa.schema(_KEPT_FIELDS))

    return run


def _phrases(buckets: int, words: int):
    """The frequent n-grams that each chunk is asked for, as phrases with their total counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, buckets, words)
                spell, totals = [], []
                for kept in sorted(row["kept"], key=lambda k: k["bucket"]):
                    n = int.from_bytes(kept["spell"][:8], "little")
                    spell.append(np.unpackbits(np.frombuffer(kept["spell"], np.uint8, offset=8), count=n))
                    totals.append(unpack(kept["totals"], np.int64))
                asked = chunk.order[np.concatenate(spell).astype(bool)]
                total = np.zeros(len(chunk.order), np.int64)
                total[asked] = np.concatenate(totals)
                texts = pa.array(chunk.words, pa.binary()).cast(pa.string())
                done = 0
                for size, (columns, counts) in enumerate(chunk.levels, 1):
                    of_level = total[done : done + len(counts)]
                    own = np.flatnonzero(of_level)
                    done += len(counts)
                    for at in range(0, len(own), 100_000):
                        some = own[at : at + 100_000]
                        phrase = texts.take(pa.array(columns[0][some]))
                        for column in columns[1:]:
                            phrase = pc.binary_join_element_wise(phrase, texts.take(pa.array(column[some])), " ")
                        n = len(some)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([row["lang"]] * n, pa.string()), pa.array(np.full(n, size, np.int32)),
                                phrase, pa.array(of_level[some]),
                            ],
                            schema=pa.schema(_PHRASE_FIELDS),
                        )

    return run


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, least: int = LEAST
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a): every phrase of 1 to ``words`` words with ``least`` occurrences or more,
    counted exactly; and (lang, n): all words of each language. Both are kept in the shared folder.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        filled(text_col).cast("binary").alias("text"),
    )
    chunk = (F.spark_partition_id().cast("long") * (1 << 32) + F.col("number")).alias("chunk")
    chunks = texts.mapInArrow(_chunks(CHUNK, HELD, SECTION), _CHUNK).select(chunk, "*").drop("number")
    chunks = bucketed(chunks, "chunk", "chunks")
    sizes = frozen(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0"), "languages")
    mass = words * (chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    buckets = mass // MASS + 1
    kept = (
        chunks.mapInArrow(_shares(buckets, words), _SHARE)
        .groupBy("bucket")
        .applyInArrow(_frequent(least), _KEPT)
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("bucket", "spell", "totals")).alias("kept"))
    )
    phrases = chunks.join(kept, "chunk").mapInArrow(_phrases(buckets, words), _PHRASES)
    return frozen(phrases, "phrases"), sizes


# Scores.


def _parts(candidates: DataFrame, words: int) -> DataFrame:
    """One row per candidate, cut and side: the part whose count the score needs."""
    asked = []
    for at in range(1, words):
        size = F.col("size")
        first = F.substring_index("phrase", " ", at)
        rest = F.expr(f"substring_index(phrase, ' ', {at} - size)")
        for side, part in (("l", first), ("r", rest)):
            row = F.struct(F.lit(at).alias("cut"), F.lit(side).alias("side"), part.alias("part"))
            asked.append(F.when(size > at, row))
    rows = candidates.select("*", F.explode(F.array(*asked)).alias("asked")).where("asked IS NOT NULL")
    return rows.select("lang", "size", "phrase", "a", "asked.*")


def _counted(parts: DataFrame, known: DataFrame, hot: int) -> DataFrame:
    """Each part with its count ``f``; the most wanted parts are broadcast, the others shuffled."""
    wanted = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("asked"))
    top = wanted.orderBy(F.desc("asked"), "lang", "part").limit(hot).select("lang", "part")
    counts = known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    top = F.broadcast(frozen(F.broadcast(top).join(counts, ["lang", "part"]), "hot-parts"))
    rest = parts.join(top, ["lang", "part"], "left_anti").join(counts, ["lang", "part"])
    return parts.join(top, ["lang", "part"]).unionByName(rest)


def _inner(candidates: DataFrame, words: int) -> DataFrame:
    """(lang, phrase, longest): the largest count of a longer candidate that holds the phrase's words."""
    spans = [
        F.when(F.col("size") > size, F.concat_ws(" ", F.slice(F.split("phrase", " "), start, size)))
        for size in range(2, words)
        for start in range(1, words - size + 2)
    ]
    if not spans:
        return candidates.select("lang", "phrase", F.col("a").alias("longest")).limit(0)
    # A span that starts too late is shorter than its size and equals no candidate of that size.
    held = candidates.select("lang", F.explode(F.array(*spans)).alias("phrase"), "a").where("phrase IS NOT NULL")
    return held.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS,
    least: int = LEAST, share: int = SHARE, top: int | None = TOP, hot: int = HOT,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language the ``top`` phrases (all if None) of 2 to
    ``words`` words by score, count and phrase, without those that a longer one holds in ``share``
    percent of their occurrences or more.
    """
    known, sizes = frequent_phrases(docs, text_col, lang_col, words, least)
    return scored_phrases(known, sizes, words, share, top, hot)


def scored_phrases(
    known: DataFrame, sizes: DataFrame, words: int = WORDS, share: int = SHARE, top: int | None = TOP,
    hot: int = HOT,
) -> DataFrame:
    """The ranking of :func:`collocations` from counted phrases and the sizes of languages."""
    candidates = known.where("size > 1")
    parts = frozen(_parts(candidates, words), "parts")
    sides = _counted(parts, known, hot).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"),
        *[
            F.max(F.when((F.col("cut") == at) & (F.col("side") == side), F.col("f"))).alias(f"{side}{at}")
            for at in range(1, words)
            for side in "lr"
        ],
    )
    whole = "CAST({} AS DECIMAL(38,0))"
    square = f"{whole.format('a')} * {whole.format('a')} * {whole.format('1000000')}"
    cuts = [
        F.when(
            F.col(f"l{at}").isNotNull(),
            F.struct(
                F.expr(f"({square}) div ({whole.format(f'l{at}')} * {whole.format(f'r{at}')})").alias("score"),
                F.lit(at).alias("cut"),
                F.col(f"l{at}").alias("l"),
                F.col(f"r{at}").alias("r"),
            ),
        )
        for at in range(1, words)
    ]
    lowest = F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))
    scored = (
        sides.select("lang", "phrase", "a", lowest.alias("lowest"))
        .join(_inner(candidates, words), ["lang", "phrase"], "left")
        .where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
        .select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]

    def placed(rows: DataFrame, *keys) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order))
        rows = rows.withColumn("rank", place.cast("long"))
        return rows if top is None else rows.where(F.col("rank") <= top)

    if top is not None:
        # However many tasks there are, at most ``SPREAD`` times ``top`` rows of a language meet.
        scored = placed(scored, F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).drop("rank")
    ranked = placed(scored)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
