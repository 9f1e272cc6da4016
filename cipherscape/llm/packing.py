"""Packing into training sequences by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two: as
many of the longest length as fit, then one for each binary digit of the rest.
Pieces of equal length form a bucket and every piece is a sequence of its own, so
no sequence crosses documents, none needs padding, and batches of one bucket
have one shape.  Sequences are numbered bucket by bucket.

Tokenising is the cost: a vocabulary file's ids of a text are those of its words
one after another if nothing in it reaches over white space.  That is tried on the driver, and
another kind of vocabulary is an error.  A task keeps the ids of the words it has met, up to a
bound, and encodes only new ones, many at once, each closed by a token of the vocabulary's own
(one by one from where a word holds that token); nothing is kept from task to task but
the vocabulary itself.

Where the vocabulary's file says that it lowers case, cuts words into letters, digits and other characters, and marks
ends (``Pieces.KNOWN``), new words of ASCII and Latin letters are cut so before, and only new pieces are encoded, as
the same stem comes with other commas and capitals.  Pieces need neither normalizing nor the cutting.  All other words,
and all words of other vocabularies, go as they are.

Edge cases: a null or empty text is one piece, the end mark alone; repeated rows
are packed once each; a null id is packed like any other; a very long text is
read as a whole; ties in the numbering are broken by id, place and checksum; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherscape.llm.common import dense_ids, stage

#: Words whose ids a task keeps; beyond it the task begins anew.
KEPT_WORDS = 1_000_000
#: Bytes of text looked up at a time.
CHUNK_BYTES = 4 << 20

_tokenizers: dict = {}
_pieces: dict = {}


def tokenizer(vocabulary: str):  # noqa: ANN201
    """A process's own tokenizer for a vocabulary file of the ``tokenizers`` library."""
    if vocabulary not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[vocabulary] = Tokenizer.from_file(vocabulary)
    return _tokenizers[vocabulary]


def cuts_at_white_space(vocabulary: str) -> bool:
    """Whether a text's ids are those of its words one after another, tried on words between all kinds of white space."""
    known = tokenizer(vocabulary)
    words = ["The", "cat's", "naïve", "42nd", "(end).", "中文", "don't", "e.g.", "x_y", "--", "A" * 40, "ﬁ"]
    apart = [i for w in words for i in known.encode(w, add_special_tokens=False).ids]
    joints = [" ", "  ", "\t", "\n", "\r\n", "\n\n", " \x0b ", "\x0c"]
    return all(known.encode(a + j.join(words) + b, add_special_tokens=False).ids == apart for j in joints for a, b in (("", ""), (j, ""), ("", j)))


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Runs:
    """Runs of ids in one array, looked up by number."""

    def __init__(self) -> None:
        self.ids, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1, np.int64)

    def append(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        size = int(self.ends[-1])
        self.ends = np.concatenate((self.ends, size + np.cumsum(lengths)))
        if self.ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids[:size], np.empty(int(self.ends[-1]), np.uint32)))
        self.ids[size : self.ends[-1]] = ids

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs numbered ``at``, one after another, and where each begins, with the end of the last."""
        start, length = self.ends[at], self.ends[at + 1] - self.ends[at]
        before = np.concatenate(([0], np.cumsum(length)))
        return self.ids[np.repeat(start - before[:-1], length) + np.arange(before[-1])], before


def _bare(known):  # noqa: ANN001, ANN202
    """(a process's own tokenizer of pieces, by id whether a token ends a piece, the vocabulary's own tokens)."""
    from tokenizers import Tokenizer, pre_tokenizers

    if id(known) not in _pieces:
        text, numbers = known.to_str(), known.get_vocab()
        bare = Tokenizer.from_str(text)
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        closes = np.zeros(max(numbers.values()) + 1, bool)
        suffix = json.loads(text)["model"]["end_of_word_suffix"]
        closes[[number for token, number in numbers.items() if token.endswith(suffix)]] = True
        _pieces[id(known)] = known, (bare, closes, [t.content for t in known.get_added_tokens_decoder().values()])
    return _pieces[id(known)][1]


class Pieces:
    """Words cut as the vocabulary itself cuts them, and the ids of the pieces met.

    Latin letters up to U+017F are left as they are by NFC, and have one lower-case form each, but for U+0130; so of words that hold
    nothing else but visible ASCII, lower case and cuts are those of the vocabulary.
    """

    #: What a vocabulary's file must say of its normalizer and cutting.
    KNOWN = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    )
    LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ſ"
    PLAIN, OTHER = re.compile(f"[!-~{LETTERS}]+"), re.compile(f"[^\n!-~{LETTERS}]")
    CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|\n|[^\n0-9{LETTERS}]+")

    def __init__(self, known):  # noqa: ANN001
        self.tokenizer, self.closes, self.own = _bare(known)
        self.numbers, self.runs = _Numbers(), Runs()

    @classmethod
    def suit(cls, known) -> bool:  # noqa: ANN001
        """Whether a vocabulary is of this kind."""
        if id(known) in _pieces:
            return True
        said = json.loads(known.to_str())
        model = said["model"]
        marked = model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in said["added_tokens"])
        return bool(marked and plain and (said["normalizer"], said["pre_tokenizer"]) == cls.KNOWN)

    def cuttable(self, words: list[str]) -> np.ndarray:
        """Which words are cut as the vocabulary cuts them."""
        whole = "\n".join(words)
        plain = np.fromiter((self.PLAIN.fullmatch(w) is not None for w in words), bool, len(words)) if self.OTHER.search(whole) else np.ones(len(words), bool)
        if any(t in whole for t in self.own):  # the vocabulary finds its own tokens first
            plain &= np.fromiter((not any(t in w for t in self.own) for w in words), bool, len(words))
        return plain

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(length of each word's ids, all ids) of cuttable words."""
        found = self.CUT.findall("\n".join([*words, ""]).lower())
        at = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        new = list(itertools.islice(self.numbers, len(self.runs.ends) - 1, None))
        shown = [p for p in new if p != "\n"]
        some = [" ".join(shown[k : k + 256]) for k in range(0, len(shown), 256)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, np.uint32), *ids])
        lengths = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
        if len(lengths) != len(shown) or lengths.sum() != len(ids):
            raise ValueError("a piece of a word has no end of its own")
        if len(shown) < len(new):  # the mark between words has no ids
            lengths = np.insert(lengths, new.index("\n"), 0)
        self.runs.append(lengths, ids)
        whole, before = self.runs.of(at)
        ends = np.flatnonzero(at == self.numbers["\n"])
        return np.diff(before[ends], prepend=0), whole


class WordIds:
    """The ids of words, kept in one array; a word is looked up by its number."""

    def __init__(self, known):  # noqa: ANN001
        self.tokenizer = known
        own = [(t.content, k) for k, t in known.get_added_tokens_decoder().items() if not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = own[-1] if own else None
        self.forget()

    def forget(self) -> None:
        self.numbers, self.runs = _Numbers(), Runs()
        self.pieces = Pieces(self.tokenizer) if Pieces.suit(self.tokenizer) else None

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.numbers) > KEPT_WORDS:
            self.forget()
        numbers, at, counts = self.numbers, [], []
        for text in texts:
            words = text.split()
            at.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        self._encode([w.decode() for w in itertools.islice(numbers, len(self.runs.ends) - 1, None)])  # those met here first
        ids, before = self.runs.of(np.concatenate([np.empty(0, np.int64), *at]))
        return np.split(ids, before[np.cumsum(counts)][:-1]) if texts else []

    def _encode(self, words: list[str]) -> None:
        """Append the ids of new words."""
        if self.pieces is None:
            self.runs.append(*self._whole(words))
            return
        cut = self.pieces.cuttable(words)
        lengths = np.empty(len(words), np.int64)
        lengths[cut], inside = self.pieces.of(list(itertools.compress(words, cut)))
        lengths[~cut], others = self._whole(list(itertools.compress(words, ~cut)))
        ids, of_cut = np.empty(int(lengths.sum()), np.uint32), np.repeat(cut, lengths)
        ids[of_cut], ids[~of_cut] = inside, others
        self.runs.append(lengths, ids)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(length of each word's ids, all ids) of words as they are."""
        if self.mark is not None and any(self.mark[0] in w for w in texts):
            self.mark = None
        if self.mark is None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(itertools.chain.from_iterable(found), np.uint32)
        closing, number = self.mark  # many words a call, each closed by a token of its own, which no word holds
        some = [closing.join(texts[k : k + 256]) + closing for k in range(0, len(texts), 256)]
        whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        whole = np.concatenate([np.empty(0, np.uint32), *whole])
        closed = np.flatnonzero(whole == number)
        if len(closed) != len(texts):
            raise ValueError("a word holds a token of the vocabulary's own")
        return np.diff(closed, prepend=-1) - 1, whole[whole != number]


def ids_of(column: pa.Array, words: WordIds) -> Iterator[np.ndarray]:
    """The ids of each text, several texts looked up together."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield from words.of(held)
            held, size = [], 0
    yield from words.of(held)


def pieces(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids; longest is a power of two."""
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    rest, size = n - start, longest
    while rest:
        size //= 2
        if rest & size:
            yield start, size
            start += size
            rest -= size


def packed(
    docs: DataFrame, vocabulary: str, longest: int = 2048, end: int = 1, id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    ``with_ids`` adds the piece's token ids as array<int>.
    """
    if not re.fullmatch("10*", f"{longest:b}"):
        raise ValueError("longest must be a power of two")
    if not cuts_at_white_space(vocabulary):
        raise ValueError(f"{vocabulary} has ids that reach over white space")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, words = end.to_bytes(4, "little"), WordIds(tokenizer(vocabulary))
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for k, found in enumerate(ids_of(batch.column(1), words)):
                blob = found.astype("<u4").tobytes() + mark
                n = len(blob) // 4
                for s, m in pieces(n, longest):
                    part = blob[4 * s : 4 * (s + m)]
                    row.append(k)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        ids.append(memoryview(part).cast("I").tolist())
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            names = [id, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id].dataType.simpleString()
    cuts = docs.select(id, F.col(text).cast("binary").alias("t")).mapInArrow(
        cut, f"`{id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    )
    # written first: finding the ranges and dealing the rows out would each read the texts
    numbered = dense_ids(stage(cuts, "pieces"), ["length", id, "start", "ids_crc32"], "sequence_id")
    return numbered.withColumn("offset", F.lit(0).cast("long"))
