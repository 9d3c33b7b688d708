"""Token ids of many texts at once, for tokenizers that drop white space.

Such a tokenizer never joins letters across white space, so a batch of texts is cut into
words, equal words are found by Arrow's dictionary, and only words not seen lately are
encoded. Words of letters alone with closing marks are encoded as one long text and cut
after their end-of-word tokens; any other word is encoded for itself. A tokenizer that keeps
white space, or whose words don't end in a suffix, is given whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A letter before one of these marks always ends a word part.
MARKS = ".,;:!?#$%&*|)]}\"-"
CACHE_WORDS = 600_000
CACHED_BYTES = 64
BYTES_AT_ONCE = 8 * 2**20


def drops_blanks(definition: dict) -> bool:
    """Whether white space only parts words: no alternative of the splitting pattern matches any."""
    steps = definition.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = (first.get("pattern") or {}).get("Regex")
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or not pattern:
        return False
    parts = regex.findall(f"(?V1){pattern}", "a 1 \t! \n's  b\r\x0b\x0c-")
    return not any(c.isspace() for part in parts for c in part)


class WordIds:
    """``flat(texts)`` gives the ids of all texts in one array and how many each text has."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        kept = json.loads(definition)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 2**16 else "<u4")
        self.suffix = kept["model"].get("end_of_word_suffix")
        self.by_word = bool(drops_blanks(kept) and not kept.get("truncation") and not kept["model"].get("dropout"))
        self._forget()
        if self.suffix:
            self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith(self.suffix) for k in range(self.size)])

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Null texts have no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        ids, counts, at = [], [], 0
        while at < len(texts):
            reach = (ends[at - 1] if at else 0) + BYTES_AT_ONCE
            to = max(int(np.searchsorted(ends, reach, side="right")), at + 1)
            part = texts.slice(at, to - at)
            found = self._by_word(part) if self.by_word else self._whole(part.to_pylist())
            ids.append(found[0])
            counts.append(found[1])
            at = to
        if not ids:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.concatenate([np.array(x, self.dtype) for x in lists] or [np.zeros(0, self.dtype)]), counts

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        lower = pc.ascii_lower(coded.dictionary).dictionary_encode()
        pool, lengths = self._pool(lower.dictionary)
        codes = lower.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
        n = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        bounds = upto[np.concatenate([[0], np.cumsum(per_text)])]
        return _stretches(pool, (np.cumsum(lengths) - lengths)[codes], n), np.diff(bounds)

    def _pool(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and their number for each word."""
        stems = pc.ascii_rtrim(words, characters=MARKS)
        plain = _letters_only(stems) if self.suffix else pa.array(np.zeros(len(words), bool))
        heads = pc.if_else(plain, stems, words)
        coded = pa.concat_arrays([heads, _after(words, heads)]).dictionary_encode()
        starts, lengths = self._places(coded.dictionary)
        # head and closing marks of a word stand side by side
        parts = coded.indices.to_numpy(zero_copy_only=False).reshape(2, len(words)).T.ravel()
        n = lengths[parts]
        return _stretches(self.pool, starts[parts], n), n.reshape(-1, 2).sum(axis=1)

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct words start in ``pool``, and their number; unknown words are encoded first."""
        self._drop_long()
        if len(self.known) > CACHE_WORDS:
            self._forget()
        at = pc.index_in(words, value_set=self.known)
        missing, before = at.is_null(), len(self.known)
        new = words.filter(missing)
        if len(new):
            brief = pc.less_equal(pc.binary_length(new), CACHED_BYTES)
            self.kept = self._add(new.filter(brief))
            self._add(new.filter(pc.invert(brief)))
            found = pc.index_in(new, value_set=self.known.slice(before))
            at = pc.replace_with_mask(at, missing, pc.add(found, pa.scalar(before, pa.int32())))
        at = at.to_numpy(zero_copy_only=False)
        return self.starts[at], self.lengths[at]

    def _forget(self) -> None:
        """Only the empty word stays, which has no ids."""
        self.known, self.kept = pa.array([""], pa.large_string()), 1
        self.pool, self.starts, self.lengths = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _drop_long(self) -> None:
        """Long words stand last and serve one batch only."""
        if self.kept < len(self.known):
            end = int(self.starts[self.kept])
            self.known, self.pool = self.known.slice(0, self.kept), self.pool[:end]
            self.starts, self.lengths = self.starts[: self.kept], self.lengths[: self.kept]

    def _add(self, words: pa.Array) -> int:
        """Encode words and put them behind the known ones; gives the number known then."""
        if len(words):
            letters = _letters_only(words) if self.suffix else pa.array(np.zeros(len(words), bool))
            sorts = words.filter(letters), words.filter(pc.invert(letters))
            found = [self._of_letters(sorts[0].to_pylist()), self._whole(sorts[1].to_pylist())]
            self.known = pa.concat_arrays([self.known, *sorts])
            self.pool = np.concatenate([self.pool, *[ids for ids, _ in found]])
            self.lengths = np.concatenate([self.lengths, *[n for _, n in found]])
            self.starts = np.cumsum(self.lengths) - self.lengths
        return len(self.known)

    def _of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words of letters as one text; each must end in one end-of-word token, else halves are tried."""
        if len(words) < 2:
            return self._whole(words)
        (e,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(e.ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            half = len(words) // 2
            parts = self._of_letters(words[:half]), self._of_letters(words[half:])
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])
        return ids, np.diff(cuts, prepend=0)


def with_closing(encoder: WordIds, texts: pa.Array, closing: int, about: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(ids, counts, first row) of stretches of rows; every text ends in ``closing``; a stretch has about ``about`` ids."""
    lengths = np.cumsum(np.array([0 if t is None else t for t in pc.binary_length(texts).to_pylist()], np.int64) + 1)
    at = 0
    while at < len(texts):
        # about as many bytes as make that many ids
        to = max(int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + 2 * about, side="right")), at + 1)
        ids, counts = encoder.flat(texts.slice(at, to - at))
        upto = np.cumsum(counts)
        yield np.insert(ids, upto, encoder.dtype.type(closing)), counts + 1, at
        at = to


def _letters_only(words: pa.Array) -> pa.Array:
    # İ is the one letter whose lower case ends in a mark, which would join those after it
    return pc.and_not(pc.utf8_is_alpha(words), pc.match_substring(words, "İ"))


def _after(words: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows the head in every word."""
    sizes = [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, heads)]
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words)]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    n = sizes[0] - sizes[1]
    held = [pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int64)), pa.py_buffer(_stretches(data, offsets + sizes[1], n))]
    return pa.LargeStringArray.from_buffers(len(words), *held)


def _stretches(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start : start + length]`` of every entry, one after the other."""
    upto = np.cumsum(lengths)
    total = int(upto[-1]) if len(upto) else 0
    return values[np.repeat(starts - (upto - lengths), lengths) + np.arange(total)]
