"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked (spaces become U+2581, one is put in front) and falls into words: a run of marks and
the characters up to the next mark. The distinct words of some texts are sorted, which lays them out as
a trie in depth-first order, and a forward pass walks it: the state of a prefix depends on its
characters alone, so a word starts where it leaves the word before it.

The public vocabulary is a BPE one. Its scores are merge priorities, and the largest sum of scores is
not what its encoder returns; the forward score here is whether a prefix's segmentation is the one that
merging gives. The segmentation of a prefix is unique, and its last piece is the one piece whose
neighbour, the last piece of the shorter prefix, does not merge with it (two pieces merge if the
encoding of their joined text is not the two of them). Ids are those of the library, byte for byte.

Defined cases: a null or empty text has no ids; characters that no piece holds become their bytes;
repeated rows are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from functools import cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dialwise.llm.common import filled

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Bounds of what a worker keeps between texts, and of the texts whose words are sorted together.
CACHED_WORDS, CACHED_PAIRS, TOGETHER = 250_000, 400_000, 1000
DECODED_TOGETHER = 100
#: Stands for the byte pieces beyond ASCII; a text that holds it itself is only decoded more slowly.
BYTE = "\ue000"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces, their scores and the encoding of words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.shown = list(self.texts)
        for byte, i in enumerate(self.byte_ids):
            self.shown[i] = chr(byte) if byte < 128 else BYTE
        self.ids = {
            text: i
            for i, text in enumerate(self.texts)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        self.score = {text: model.get_score(i) for text, i in self.ids.items()}
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, array] = {}
        self.before: dict[str, array] = {}
        # The pieces that the encoding of their own text is; only these are ever returned.
        self.whole = {text for text in self.ids if len(text) < 2 or self.merge(text) == [text]}
        # By their last three characters, the lengths of these pieces, longest first.
        sizes: dict[str, set[int]] = {}
        for text in self.whole:
            if len(text) > 2:
                sizes.setdefault(text[-3:], {1}).add(len(text))
        for end, found in sizes.items():
            found |= {2} if end[1:] in self.whole else set()
        self.sizes = {end: tuple(sorted(found, reverse=True)) for end, found in sizes.items()}

    def merge(self, text: str) -> list[str]:
        """The segmentation by merging the best neighbours, first ones first, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether the encoding of both together is the two pieces; with no left one, of the right."""
        if len(self.apart) >= CACHED_PAIRS:
            self.apart.clear()
        together = self.merge(left + right) == [p for p in (left, right) if p]
        self.apart[left, right] = together
        return together

    def segment(self, words: list[str]):
        """Pieces of each word of a sorted list; prefixes of the word before are not passed again."""
        last: list[str] = [""]  # by length of the prefix, its last piece
        before, apart, whole, sizes, two, one = "", self.apart, self.whole, self.sizes, (2, 1), (1,)
        for word in words:
            common, n = 0, len(word)
            for common, (x, y) in enumerate(zip(word, before)):
                if x != y:
                    break
            else:
                common = min(n, len(before))
            del last[common + 1 :]
            for end in range(common + 1, n + 1):
                found = sizes.get(word[end - 3 : end]) if end > 2 else None
                for size in found or (two if end > 1 else one):
                    if size > end:
                        continue
                    begin = end - size
                    piece = word[begin:end]
                    if size > 1 and piece not in whole:
                        continue
                    if begin:
                        pair = last[begin], piece
                        free = apart.get(pair)
                        if not (self.stay_apart(*pair) if free is None else free):
                            continue
                    last.append(piece)
                    break
            pieces, end = [], n
            while end:
                piece = last[end]
                pieces.append(piece)
                end -= len(piece)
            pieces.reverse()
            yield pieces
            before = word

    def encode(self, texts: list[str]) -> list[array]:
        split = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:  # what is not used again until the next time is dropped
            self.before, self.known = self.known, {}
        known, before, new = self.known, self.before, []
        for word in set().union(*split):
            if word not in known:
                held = before.get(word)
                if held is None:
                    new.append(word)
                else:
                    known[word] = held
        new.sort()
        for word, pieces in zip(new, self.segment(new)):
            known[word] = self.ids_of(pieces)
        out = []
        for words in split:
            ids = array("i")
            for word in words:
                ids.extend(known[word])
            out.append(ids)
        return out

    def ids_of(self, pieces: list[str]) -> array:
        try:
            return array("i", [self.ids[piece] for piece in pieces])
        except KeyError:  # a character that no piece holds
            ids = array("i")
            for piece in pieces:
                held = self.ids.get(piece)
                ids.extend([self.byte_ids[b] for b in piece.encode()] if held is None else [held])
            return ids

    def decode(self, ids) -> str:
        text = "".join(map(self.shown.__getitem__, ids))
        if BYTE in text:
            text = self.with_bytes(ids)
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def with_bytes(self, ids) -> str:
        """The pieces' texts, runs of bytes decoded together."""
        parts, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            parts += [raw.decode(errors="replace"), self.texts[i]]
            raw.clear()
        return "".join([*parts, raw.decode(errors="replace")])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(path: str, check: bool):
    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), TOGETHER):
                part, known = batch.slice(begin, TOGETHER), vocabulary(path)
                encoded = known.encode(part.column(1).to_pylist())
                flat = array("i")
                for ids in encoded:
                    flat.extend(ids)
                ends = np.cumsum([0, *map(len, encoded)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                columns, names = [part.column(0), lists], ["doc_id", "ids"]
                if check:
                    digests = [sha256(known.decode(ids).encode()).hexdigest() for ids in encoded]
                    columns.append(pa.array(digests, pa.string()))
                    names.append("decoded_sha256")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL,
    check: bool = False,
) -> DataFrame:
    """doc_id and ids of every row; with ``check`` also decoded_sha256, the digest of the text that
    the ids decode to."""
    texts = docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))
    more = ", decoded_sha256 string" if check else ""
    return texts.mapInArrow(_encode(path, check), f"doc_id long, ids array<int>{more}")


def decode(ids: str | Column, path: str = MODEL) -> Column:
    """The text that a list of ids stands for."""

    def run(lists: pa.Array) -> pa.Array:
        known, out = vocabulary(path), []
        for begin in range(0, len(lists), DECODED_TOGETHER):
            out += map(known.decode, lists[begin : begin + DECODED_TOGETHER].to_pylist())
        return pa.array(out, pa.string())

    return F.arrow_udf(run, StringType())(ids)
