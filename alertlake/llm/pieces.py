"""SentencePiece encoding and decoding by Viterbi search with shared prefixes.

A text is cut into marked words, a run of spaces with what follows it; no piece of the vocabulary reaches over such a border,
which is checked when the vocabulary is read. The distinct new words of a batch are sorted, which is the depth-first order
of their trie: forward scores of the common prefix with the word before are reused, only the rest is searched. The best
segmentation maximises the sum of the pieces' scores (the unigram rule); characters that no piece covers become byte pieces.
A vocabulary of merges holds ranks instead of scores, which are taken as Zipf weights.

Decoding joins the bytes of the pieces, so that it returns the text exactly where the vocabulary has byte pieces.

Defined results: a null or empty text has no ids and decodes to the empty text; null ids decode to null. Repeated rows get equal ids.
Other columns are not read; one named like an output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from alertlake.llm.frames import add_columns

SPACE_MARK = "▁"
# A user-defined piece counts as its length in bytes times the best score, less this much.
USER_MARGIN = 0.1
UNKNOWN_MARGIN = 10.0
WORD = re.compile(r" *[^ ]+| +")
# Words whose ids a task remembers; beyond it the memory starts anew and words are searched again.
REMEMBERED = 400_000
TWO = (2,)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by text (spaces unmarked) with id and score; bytes by id; the byte pieces; the unknown id and score."""

    pieces: dict[str, tuple[int, float]]
    texts: list[bytes]
    byte_ids: list[int]
    unknown: int
    unknown_score: float
    longest: int

    @cached_property
    def sizes(self) -> dict[str, tuple[int, ...]]:
        """By the last three characters: the lengths of pieces that end so, the longest first, and two."""
        found: dict[str, set[int]] = {}
        for text in self.pieces:
            if len(text) > 2:
                found.setdefault(text[-3:], set()).add(len(text))
        return {end: (*sorted(lengths, reverse=True), 2) for end, lengths in found.items()}


def read_vocabulary(path: str) -> Vocabulary:
    """Read a model file on the driver. Its pieces, a few ten thousand, travel with the tasks; executors need no file."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    kinds = proto.ModelProto.SentencePiece
    if model.trainer_spec.model_type == proto.TrainerSpec.BPE:
        # Its scores are no probabilities but ranks, from 0 down; by Zipf's law a piece of rank r has about the weight 1 / (2 + r).
        for piece in model.pieces:
            piece.score = -math.log(2 - piece.score) if piece.type == kinds.NORMAL else piece.score
    normal = [piece.score for piece in model.pieces if piece.type == kinds.NORMAL] or [0.0]
    best, worst = max(normal), min(normal)
    pieces, texts, byte_ids, unknown = {}, [], [-1] * 256, 0
    for index, piece in enumerate(model.pieces):
        text = piece.piece.replace(SPACE_MARK, " ")
        texts.append(text.encode())
        if piece.type == kinds.UNKNOWN:
            unknown = index
        elif piece.type == kinds.BYTE:
            value = int(piece.piece[3:5], 16)
            byte_ids[value], texts[-1] = index, bytes([value])
        elif piece.type in (kinds.NORMAL, kinds.USER_DEFINED):
            if " " in text.lstrip(" "):
                raise ValueError(f"piece {index} reaches over a word border")
            user = piece.type == kinds.USER_DEFINED
            pieces[text] = (index, len(piece.piece.encode()) * best - USER_MARGIN if user else piece.score)
        else:
            texts[-1] = b""
    return Vocabulary(pieces, texts, byte_ids if min(byte_ids) >= 0 else [], unknown, worst - UNKNOWN_MARGIN, max(map(len, pieces), default=0))


def segment_words(words: Iterable[str], vocabulary: Vocabulary) -> dict[str, tuple[int, ...]]:
    """Ids of each word. Words are visited in sorted order; ``score[j]`` and ``back[j]`` hold the best way to the first j characters."""
    found: dict[str, tuple[int, ...]] = {}
    get, sizes, unknown_score = vocabulary.pieces.get, vocabulary.sizes.get, vocabulary.unknown_score
    before = ""
    score: list[float] = [0.0]
    back: list[tuple[int, int]] = [(0, -1)]
    for word in sorted(words):
        shared, least = 0, min(len(before), len(word))
        while shared < least and before[shared] == word[shared]:
            shared += 1
        del score[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, way = 0.0, (-1, -1)
            # Only lengths of pieces with this ending are looked up, the longest first, and one character in the end.
            for size in sizes(word[end - 3 : end], TWO) if end > 2 else TWO:
                if size <= end:
                    hit = get(word[end - size : end])
                    if hit is not None:
                        value = score[end - size] + hit[1]
                        if way[0] < 0 or value > best:
                            best, way = value, (end - size, hit[0])
            hit = get(word[end - 1])
            value = score[end - 1] + (unknown_score if hit is None else hit[1])
            if way[0] < 0 or value > best:
                best, way = value, (end - 1, -1 if hit is None else hit[0])
            score.append(best)
            back.append(way)
        before = word
        ids: list[int] = []
        end = len(word)
        while end > 0:
            start, piece = back[end]
            if piece >= 0:
                ids.append(piece)
            elif vocabulary.byte_ids:
                ids += [vocabulary.byte_ids[value] for value in reversed(word[start:end].encode())]
            else:
                ids.append(vocabulary.unknown)
            end = start
        found[word] = tuple(reversed(ids))
    return found


class Encoder:
    """Encodes texts and remembers the words of earlier batches, with their ids as packed 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [array("i", ids).tolist() for ids in self.packed(texts)]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        cut = [WORD.findall(" " + text) if text else [] for text in texts]
        fresh = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = set(chain.from_iterable(cut))
        self.known.update((word, array("i", ids).tobytes()) for word, ids in segment_words(fresh, self.vocabulary).items())
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]


def decode_ids(ids: Iterable[int] | None, vocabulary: Vocabulary) -> str | None:
    if ids is None:
        return None
    text = b"".join(map(vocabulary.texts.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", part: int = 512) -> DataFrame:
    """All columns of the documents, ``ids``, ``n_tokens`` and ``round_trip`` (decoding gives the text again)."""
    state: dict[str, Encoder] = {}

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        encoder = state.setdefault("encoder", Encoder(vocabulary))
        column = batch.column(text_col)
        values: list[bytes] = []
        same: list[bool] = []
        for start in range(0, len(column), part):
            texts = column.slice(start, part).to_pylist()
            for text, ids in zip(texts, encoder.packed(texts), strict=True):
                values.append(ids)
                same.append(decode_ids(array("i", ids), vocabulary) == (text or ""))
        lengths = np.array([len(ids) // 4 for ids in values], dtype=np.int64)
        offsets = np.concatenate([[0], lengths.cumsum()]).astype(np.int32)
        return {
            "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), np.int32))),
            "n_tokens": pa.array(lengths),
            "round_trip": pa.array(same, pa.bool_()),
        }

    return add_columns(docs, [("ids", "array<int>"), ("n_tokens", "bigint"), ("round_trip", "boolean")], columns)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the text of the ids."""

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"decoded": pa.array([decode_ids(ids, vocabulary) for ids in batch.column(ids_col).to_pylist()], pa.string())}

    return add_columns(rows, [("decoded", "string")], columns)
