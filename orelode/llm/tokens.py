"""Fast whole-text token ids: the tokenizers library behind a table of words.

Byte-level BPE splits a text into pre-tokens first, and a single line feed or a single space
between two visible characters always starts a new pre-token. A text whose white space is only
such single spaces and one or two line feeds is therefore cut there, each distinct word is encoded
once by the library, in batches, and its ids are reused. Words are cut, looked up and written out by
numpy, many texts at once; the table is keyed by a word's bytes, not by a hash. Where the pre-tokenizer
parts letters from the ASCII punctuation after them (it is asked), a new word's ids are those of its
stem and of its end. Any other text goes to the library whole, so the ids are the library's in every case.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_U = np.uint64
#: Words and ids that a worker keeps before it starts anew (bounded memory: about 80 MB).
MOST_WORDS, MOST_IDS, SLOT_BITS = 1_000_000, 1 << 23, 21
#: Bytes of the words that numpy looks up, two numbers each; longer ones are looked up in a dictionary.
SHORT = 15
#: White space inside a piece of a cut text: the text then goes to the library whole.
_ODD = re.compile(r"[^\S \n\0]|[\x1c-\x1f\x85]")
#: ASCII punctuation that ends a word; letters before it that every Unicode version knows as such.
_ENDS, _LETTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", frozenset(c for c in map(chr, range(0x250)) if c.isalpha())
#: The first n bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _whole(text: str) -> bool:
    """Whether lone spaces and line feeds don't part the text."""
    return "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or "\0" in text or text[0].isspace() or text[-1].isspace()


class WordTable:
    """Ids of words. A word of up to SHORT bytes is found by its bytes as two numbers, by open addressing."""

    def __init__(self, dtype: str):
        self.lo, self.hi, self.word = (np.zeros(1 << SLOT_BITS, t) for t in (np.uint64, np.uint64, np.int32))
        self.long: dict[bytes, int] = {}
        self.start, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)  # word 0: unknown, no ids
        self.ids, self.words, self.filled = np.zeros(1 << 18, dtype), 1, 0

    def full(self) -> bool:
        return self.words > MOST_WORDS or self.filled > MOST_IDS

    @staticmethod
    def _slot(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (lo ^ (hi * _U(0x9E3779B97F4A7C15)) ^ (lo >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> _U(32))) * _U(0x94D049BB133111EB) >> _U(64 - SLOT_BITS)).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The word of each key, 0 if unknown."""
        at = self._slot(lo, hi)
        out = self.word[at]
        on = np.flatnonzero((out != 0) & ((self.lo[at] != lo) | (self.hi[at] != hi)))
        while len(on):
            here = at[on] + 1 & (1 << SLOT_BITS) - 1
            at[on] = here
            out[on] = self.word[here]
            on = on[(out[on] != 0) & ((self.lo[here] != lo[on]) | (self.hi[here] != hi[on]))]
        return out

    def add(self, codes: list[bytes]) -> np.ndarray:
        """New words with these id bytes."""
        size = self.ids.itemsize
        counts = np.array([len(x) // size for x in codes], np.int32)
        made = np.arange(self.words, self.words + len(codes), dtype=np.int32)
        grown, filled = self.words + len(codes), self.filled + int(counts.sum())
        if grown > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros(max(len(x), grown - len(x)), np.int32)]) for x in (self.start, self.count))
        if filled > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), filled - len(self.ids)), self.ids.dtype)])
        self.ids[self.filled : filled] = np.frombuffer(b"".join(codes), self.ids.dtype)
        self.start[made], self.count[made] = self.filled + np.cumsum(counts) - counts, counts
        self.words, self.filled = grown, filled
        return made

    def place(self, lo: np.ndarray, hi: np.ndarray, words: np.ndarray) -> None:
        """Put keys that aren't in the table (each once) into it."""
        at, on = self._slot(lo, hi), np.arange(len(lo))
        while len(on):
            free = on[self.word[at[on]] == 0]
            self.word[at[free]] = words[free]  # of several, the last stays
            won = free[self.word[at[free]] == words[free]]
            self.lo[at[won]], self.hi[at[won]] = lo[won], hi[won]
            on = on[self.word[at[on]] != words[on]]
            at[on] = at[on] + 1 & (1 << SLOT_BITS) - 1


class Encoder:
    """Token ids of whole texts as little-endian unsigned bytes, 4 an id or 2 where they fit."""

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_truncation()
        self.tok.no_padding()
        self.code, self.dtype = {2: "H", 4: "I"}[np.dtype(dtype).itemsize], dtype
        self.feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.parts, self.table = self._parts_punctuation(), WordTable(dtype)
        self.ends: dict[str, bytes] = {}

    def _parts_punctuation(self) -> bool:
        """Whether the pre-tokenizer cuts between letters and the ASCII punctuation after them, and nowhere else in either."""
        part, probes = self.tok.pre_tokenizer, [f"{space}{x}" for space in ("", " ") for x in ("a", "Zb", "\xe9t\xe9")]
        return part is not None and self.tok.normalizer is None and all(len(part.pre_tokenize_str(x + y)) == 2 for x in probes for y in (*_ENDS, _ENDS))

    def _library(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, x.ids).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words (a space before each at most): joined by line feeds, whose id then parts them again."""
        if len(self.feed) != 1 or "\n" in words:
            return self._library(words)
        texts = ["\n".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        out, width = [], array(self.code).itemsize
        for got in self.tok.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(got.ids, self.code)
            data, ends = ids.tobytes(), (np.flatnonzero(ids == self.feed[0]) * width).tolist()
            out += [data[x:y] for x, y in zip([0, *(e + width for e in ends)], [*ends, len(data)], strict=True)]
        return out

    def _new_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that aren't known, each from its stem and the punctuation at its end where those are pre-tokens."""
        if not self.parts:
            return self._words(words)
        stems, ends = [], []
        for word in words:
            stem = word.rstrip(_ENDS)
            cut = len(stem) < len(word) and stem[-1:] in _LETTERS
            stems.append(stem if cut else word)
            ends.append(word[len(stem) :] if cut else "")
        new = [x for x in set(ends) if x not in self.ends]
        if len(self.ends) + len(new) > 50_000:
            self.ends, new = {}, list(set(ends))
        self.ends.update(zip(new, self._library(new), strict=True))
        distinct = list(dict.fromkeys(stems))
        coded = dict(zip(distinct, self._words(distinct), strict=True))
        return [coded[x] + self.ends[y] for x, y in zip(stems, ends, strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Id bytes of each whole text; null and empty texts have none."""
        out, cut = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if text:
                if _whole(text):
                    out[i] = self._library([text])[0]
                else:
                    cut.append(i)
        if cut:
            for i, ids in zip(cut, self._cut_texts([texts[i] for i in cut]), strict=True):
                out[i] = ids
        return out

    def _cut_texts(self, texts: list[str]) -> list[bytes]:
        if self.table.full():
            self.table = WordTable(self.dtype)
        table = self.table
        raw = "\0".join([*texts, ""]).encode()
        data = np.frombuffer(raw + b"\0" * 16, np.uint8)
        zero, feed = data[: len(raw)] == 0, data[: len(raw)] == 10
        # a space starts a word, a line feed is one, and a zero ends a text (a word without ids)
        alone = zero | feed
        begins = alone | (data[: len(raw)] == 32)
        begins[1:] |= alone[:-1]
        begins[0] = True
        start = np.flatnonzero(begins)
        size = np.diff(start, append=len(raw))
        numbers = np.lib.stride_tricks.as_strided(data.view(), (len(raw) + 8, 8), (1, 1))
        first = numbers[start].view(np.uint64).ravel() & _FIRST[np.minimum(size, 8)]
        second = np.zeros(len(start), np.uint64)
        more = np.flatnonzero(size > 8)
        second[more] = numbers[start[more] + 8].view(np.uint64).ravel() & _FIRST[np.minimum(size[more] - 8, 8)]
        word = table.find(first, second)
        long = np.flatnonzero(size > SHORT)
        keys = [raw[a : a + n] for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
        word[long] = [table.long.get(x, 0) for x in keys]
        odd = self._learn(raw, start, size, first, second, word, long, keys)
        at, n = table.start[word], table.count[word].astype(np.int64)
        total = np.cumsum(n)
        ids = table.ids[np.repeat(at - (total - n), n) + np.arange(total[-1])]
        ends = np.flatnonzero(zero[start])
        cuts, view = np.concatenate([[0], total[ends]]) * ids.itemsize, ids.tobytes()
        out = [view[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i in np.unique(np.searchsorted(ends, odd)).tolist():
            out[i] = self._library([texts[i]])[0]
        return out

    def _learn(self, raw: bytes, start: np.ndarray, size: np.ndarray, first: np.ndarray, second: np.ndarray, word: np.ndarray, long: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """Fill in the words that the table doesn't know; places of words that hold white space of their own, which stay unknown."""
        table = self.table
        short = np.flatnonzero((word == 0) & (first != 0) & (size <= SHORT))
        pairs = np.empty(len(short), [("lo", "<u8"), ("hi", "<u8")])
        pairs["lo"], pairs["hi"] = first[short], second[short]
        order = np.lexsort((pairs["hi"], pairs["lo"]))
        pairs = pairs[order]
        heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
        which = short[order[heads]]
        new_long = list(dict.fromkeys(x for x, w in zip(keys, word[long].tolist(), strict=True) if not w))
        names = [raw[a : a + n].decode() for a, n in zip(start[which].tolist(), size[which].tolist(), strict=True)] + [x.decode() for x in new_long]
        if not names:
            return np.empty(0, np.int64)
        # each is one run without white space, else some have white space that str.split() sees and the cut didn't
        odd = np.zeros(len(names), bool)
        if len("\0".join(names).replace("\0", " ").split()) != len(names):
            odd[:] = [x != "\n" and _ODD.search(x) is not None for x in names]
        plain = np.flatnonzero(~odd)
        made = np.zeros(len(names), np.int32)
        made[plain] = table.add(self._new_words([names[i] for i in plain.tolist()]))
        fresh = plain[plain < len(heads)]
        table.place(pairs["lo"][heads[fresh]], pairs["hi"][heads[fresh]], made[fresh])
        word[short[order]] = np.repeat(made[: len(heads)], np.diff(heads, append=len(pairs)))
        told = dict(zip(new_long, made[len(heads) :].tolist(), strict=True))
        table.long.update((x, w) for x, w in told.items() if w)
        word[long] = [w or told[x] for x, w in zip(keys, word[long].tolist(), strict=True)]
        return np.flatnonzero((word == 0) & (first != 0))


_HELD: dict[str, dict] = {}


def held(kind: str) -> dict:
    """What this worker process keeps between tasks for one kind of operator; workers are reused, so other kinds' caches go."""
    for other in [k for k in _HELD if k != kind]:
        del _HELD[other]
    return _HELD.setdefault(kind, {})


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder per worker process, vocabulary and width."""
    kept, key = held("encoder"), (path, dtype)
    if key not in kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept.clear()
        kept[key] = Encoder(*key)
    return kept[key]


def chunks(batch, size: int = 2 << 20):
    """Slices of an Arrow batch whose text column (the last) has about so many bytes: bounded working memory."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // size
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
        yield batch.slice(a, b - a)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    """One more than the largest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1
