"""Token ids of whole texts, for use inside tasks.

The vocabulary's pre-tokenizer never joins characters across ASCII white space, so the ids of a text are the ids of its words one
after the other; and it always cuts between a letter and a following mark other than an apostrophe, so a plain word and the marks
behind it can be looked up apart. Words met before are looked up; only new ones go through the tokenizer.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and pieces of words that a task remembers before it starts afresh; they bound memory only.
MAX_WORDS, MAX_PIECES = 600_000, 700_000
#: A plain word and the marks behind it: letters that lower-case one to one and that normalisation leaves alone.
SPLIT = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,%$&*#!?|;:)]*)$"


class _Index(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class WordIds:
    """Ids of texts under one vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.vocabulary = 1 + max(vocabulary.values())
        self.closes = np.zeros(self.vocabulary, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget_pieces()

    def _forget_pieces(self) -> None:
        self.pieces: dict[str, int] = {"": 0}
        self.piece_ids = _Ragged()
        self.piece_ids.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self._forget_words()

    def _forget_words(self) -> None:
        self.index = _Index()
        self.word_ids = _Ragged()

    def _learn(self) -> None:
        """Splits the new words into a plain word and its marks, or takes them whole, and encodes the pieces not met yet."""
        words = pa.array(self.index.new, pa.string())
        split = pc.extract_regex(words, SPLIT)
        plain = split.is_valid()
        stems = pc.if_else(plain, pc.utf8_lower(pc.struct_field(split, "stem")), words).dictionary_encode()
        marks = pc.if_else(plain, pc.struct_field(split, "marks"), "").dictionary_encode()
        is_plain = np.zeros(len(stems.dictionary), bool)
        is_plain[stems.indices.to_numpy()[plain.to_numpy(zero_copy_only=False)]] = True
        stem_words, mark_words = stems.dictionary.to_pylist(), marks.dictionary.to_pylist()
        pieces = self.pieces
        missing = [i for i, stem in enumerate(stem_words) if stem not in pieces]
        known = {stem_words[i] for i in missing}
        self._encode([stem_words[i] for i in missing if is_plain[i]],
                     [stem_words[i] for i in missing if not is_plain[i]] + [m for m in mark_words if m not in pieces and m not in known])
        stem_at = np.fromiter(map(pieces.__getitem__, stem_words), np.int64, len(stem_words))
        mark_at = np.fromiter(map(pieces.__getitem__, mark_words), np.int64, len(mark_words))
        parts = np.stack([stem_at[stems.indices.to_numpy()], mark_at[marks.indices.to_numpy()]], 1)
        flat, lengths = self.piece_ids.take(parts.ravel())
        self.word_ids.add(flat, lengths.reshape(-1, 2).sum(1))
        self.index.new = []

    def _encode(self, plain: list[str], other: list[str]) -> None:
        ids, lengths = [], []
        if plain:
            joined = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[joined]) + 1
            if len(ends) == len(plain):
                ids, lengths = [joined], [np.diff(ends, prepend=0)]
            else:
                plain, other = [], plain + other
        if other:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
            ids.append(np.array([i for e in each for i in e], np.uint32))
        if lengths:
            self.pieces.update(zip(plain + other, range(len(self.piece_ids), len(self.piece_ids) + len(plain) + len(other)), strict=True))
            self.piece_ids.add(np.concatenate(ids), np.concatenate(lengths))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by end; and the number of ids of each text, end included. Null counts as empty."""
        if len(self.pieces) > MAX_PIECES:
            self._forget_pieces()
        elif len(self.index) > MAX_WORDS:
            self._forget_words()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        place = np.fromiter(map(self.index.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        if self.index.new:
            self._learn()
        flat, each = self.word_ids.take(place[words.indices.to_numpy()])
        sums = np.concatenate([[0], np.cumsum(each)])
        lengths = sums[bounds[1:]] - sums[bounds[:-1]]
        closed = np.full(len(flat) + len(texts), end, np.uint32)
        keep = np.ones(len(closed), bool)
        keep[np.cumsum(lengths + 1) - 1] = False
        closed[keep] = flat
        return closed, lengths + 1


class _Ragged:
    """Rows of ids of different lengths."""

    def __init__(self) -> None:
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after the other, and the length of each."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[rows] - ends + lengths, lengths)], lengths


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def chunks(texts: pa.Array, most_bytes: int = 3_000_000):
    """(first, last) index pairs of runs of texts of bounded size together; a single text may be longer."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield first, last
        first = last
