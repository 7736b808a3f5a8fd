"""Token ids of whole texts, inside Python workers.

The vocabulary's normalizer and splitter never join characters across white space, so a text's ids
are those of its words (runs without ``[\\x20\\x09-\\x0D]``) one after another. Words are encoded once
and remembered with their ids for the life of the worker process; beyond a bound the rarely used
ones are forgotten. A text's ids are gathered from the remembered ones.

A new word of printable Latin-1 characters is split as the vocabulary's splitter does it, and its
parts go straight to the vocabulary's merges; all other words go through the whole encoder.
"""

from __future__ import annotations

import gc
import os
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from procflow.llm.words import pieces

V = TypeVar("V")

#: Remembered words; beyond it those used least are forgotten.
MOST_WORDS = 300_000
#: Remembered parts of words.
MOST_PARTS = 50_000
#: Words handed to the whole encoder at once.
AT_ONCE = 5000

# How the splitter cuts a lower-case word, its letters and digits among Latin-1.
_LETTERS = "a-zªµºß-öø-ÿ"
_DIGITS = "0-9²³¹¼½¾"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
#: Printable Latin-1 without '<', with which the names of special ids begin.
_PLAIN = re.compile(r"[!-;=-~\xa1-\xff]+")


def _byte_letters() -> dict[int, str]:
    """Character -> the letters that stand for its UTF-8 bytes: printable bytes for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in shown}
    letter |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


def kept_by_worker(name: str, build: Callable[[], V]) -> V:
    """``build()`` once per worker process; later tasks of the process get the same object."""
    held = sys.modules.setdefault("_procflow_worker", types.ModuleType("_procflow_worker")).__dict__
    if name not in held:
        held[name] = build()
    return held[name]


def encoder_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary of this name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens(dict):
    """word -> row of the flat table of ids; looking up an unknown word gives it the next row."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters, self.most = _byte_letters(), most
        self.parts: dict[str, list[int]] = {}
        self.new: list[str] = []
        self.flat, self.ends, self.used = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64)

    @classmethod
    def of_worker(cls, path: str) -> WordTokens:
        return kept_by_worker(f"tokens {path}", lambda: cls(path))

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row

    def _of_part(self, part: str) -> list[int]:
        spelled = part if part.isascii() else part.translate(self.letters)
        ids = [t.id for t in self.merges.tokenize(spelled)]
        if len(self.parts) >= MOST_PARTS:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def _of_words(self, words: list[str]) -> list[list[int]]:
        out, odd, parts = [], [], self.parts
        for word in words:
            # Most words are letters, or letters with one mark after them: these need no search.
            last = word[-1]
            stem = word[:-1] if last in ".,;:!?" else word
            if stem.isascii() and stem.isalpha():
                part = stem.lower()
                ids = parts.get(part) or self._of_part(part)
                out.append(ids if stem is word else [*ids, *(parts.get(last) or self._of_part(last))])
            elif _PLAIN.fullmatch(word):
                ids = []
                for part in _PARTS.findall(word.lower()):
                    ids += parts.get(part) or self._of_part(part)
                out.append(ids)
            else:
                odd.append((len(out), word))
                out.append([])
        for low in range(0, len(odd), AT_ONCE):
            some = odd[low : low + AT_ONCE]
            coded = self.tokenizer.encode_batch([text for _, text in some], add_special_tokens=False)
            for (i, _), e in zip(some, coded, strict=True):
                out[i] = e.ids
        return out

    def _learn(self) -> None:
        """Append the ids of the words that were looked up for the first time."""
        if self.new:
            # Hundreds of thousands of new lists make the collector walk all remembered words again and again.
            gc.disable()
            try:
                ids = self._of_words(self.new)
            finally:
                gc.enable()
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            more = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
            self.flat = np.concatenate([self.flat, more])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.used = np.concatenate([self.used, np.zeros(len(ids), np.int64)])
            self.new = []

    def _forget(self) -> None:
        """Keep the more used half of the words, and halve their counts."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        chosen = np.zeros(len(self), bool)
        chosen[keep] = True
        words = [w for w, c in zip(self, chosen.tolist(), strict=True) if c]
        lengths = np.diff(self.ends)
        self.flat = self.flat[np.repeat(chosen, lengths)]
        self.ends = np.concatenate([[0], np.cumsum(lengths[keep])])
        self.used = self.used[keep] // 2
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))

    def _row_of_end(self, end_id: int) -> int:
        """Row of the one id; its key is no word, as it has a blank."""
        key = f"end {end_id}"
        if key not in self:
            self[key] = len(self)
            self.flat = np.append(self.flat, np.uint32(end_id))
            self.ends = np.append(self.ends, self.ends[-1] + 1)
            self.used = np.append(self.used, 0)
        return self[key]

    def encode(
        self, texts: pa.Array | list[bytes], end_id: int | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after another, and the number of ids of each text.

        With ``end_id`` every text ends with that id.
        """
        texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
        # A copy that begins at offset 0: some kernels read slices from the start of their buffers.
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_binary()).cast(pa.large_string())
        # Lower case is what the normalizer makes of A-Z; only names of special ids must stay as they are.
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten()
        some = pc.greater(pc.binary_length(words), 0)
        bounds = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        bounds = bounds[split.offsets.to_numpy() - split.offsets[0].as_py()] if len(split) else bounds
        coded = words.filter(some).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.__getitem__, known), np.int64, len(known))
        self._learn()
        row = rows[coded.indices.to_numpy()]
        if end_id is not None:
            row = np.insert(row, bounds[1:], self._row_of_end(end_id))
            bounds = bounds + np.arange(len(bounds))
        self.used += np.bincount(row, minlength=len(self.used))
        lengths = np.diff(self.ends)[row]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        place = np.int32 if max(total, len(self.flat)) < 2**31 else np.int64
        first = (self.ends[row] - ends + lengths).astype(place)
        ids = self.flat[np.repeat(first, lengths) + np.arange(total, dtype=place)]
        counts = np.diff(np.concatenate([[0], ends])[bounds]) if len(split) else np.empty(0, np.int64)
        if len(self) > self.most:
            self._forget()
        return ids, counts


def encoded_pieces(words: WordTokens, texts: pa.Array, end_id: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of ``texts`` with their ids, ``end_id`` after each text, and the texts' bounds in them."""
    for piece in pieces(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
        ids, counts = words.encode(texts[piece.start : piece.stop], end_id)
        yield piece, ids, np.concatenate([[0], np.cumsum(counts)])
