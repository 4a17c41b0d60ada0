"""Token ids of many texts: the tokenizers library encodes each distinct chunk once, numpy puts the ids of the texts together.

A text is cut only where the pre-tokenizer cuts it too, so that the chunks' ids are the text's ids. For the byte-level
vocabulary those places are: before a single space or newline between two characters that are no white space, and between
a letter and the full stops and commas that end a chunk. For the word vocabulary white space always separates.
"""

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that every version of the Unicode tables calls letters.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTERS = "".join(c for c in map(chr, range(256)) if re.fullmatch(f"[{_LETTER}]", c))
_PLAIN = re.compile(" ?[A-Za-z]+")
#: White space other than space and newline, by any definition.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_RARE_CUTS = re.compile(r"(?<=\S)(?= \S)")
_WORD = rf"^[ \n]?[{_LETTER}]+$"
#: Starts a chunk that stands for itself; other chunks of byte-level texts follow a space. Texts that hold it are cut by _RARE_CUTS.
_SELF = "\r"


def _byte_spaced(text: str) -> str | None:
    """The text with its chunks between single spaces, _SELF before the first; None if it must be cut by _RARE_CUTS."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _RARE.search(text):
        return None
    return _SELF + text.replace("\n", " \n")


def _byte_rare(text: str) -> list[str]:
    return [_SELF + c for c in _RARE_CUTS.split(text)] if text else []


def _word_spaced(text: str) -> str:
    return text.replace("\n", " ")


def _byte_texts(chunks: pa.Array) -> pa.Array:
    """What the chunks stand for in a text."""
    alone = pc.starts_with(chunks, _SELF)
    spaced = pc.if_else(pc.starts_with(chunks, "\n"), chunks, pc.binary_join_element_wise(_text(" "), chunks, _text("")))
    return pc.if_else(alone, pc.utf8_slice_codeunits(chunks, 1), spaced)


def _byte_word(word: str) -> str:
    """A word of plain letters as the byte-level model writes it: a fixed sign stands for the space before it."""
    return "\u0120" + word[1:] if word[0] == " " else word


def _same(chunks: pa.Array) -> pa.Array:
    return chunks


def _text(s: str) -> pa.Scalar:
    return pa.scalar(s, pa.large_string())


class _Known:
    """Strings by number: the order in which they were met."""

    def __init__(self, first: list[str] = []):
        self.strings = pa.array(first, pa.large_string())

    def __len__(self) -> int:
        return len(self.strings)

    def numbers(self, strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The strings' numbers, and the strings that were not known, each once: these get the next numbers."""
        found = pc.index_in(strings, value_set=self.strings)
        if not found.null_count:
            return found.to_numpy().astype(np.int64), self.strings[:0]
        odd = pc.is_null(found)
        new = strings.filter(odd).dictionary_encode()
        out = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        out[odd.to_numpy(zero_copy_only=False)] = len(self.strings) + new.indices.to_numpy().astype(np.int64)
        self.strings = pa.concat_arrays([self.strings, new.dictionary])
        return out, new.dictionary

    def cut(self, n: int) -> None:
        if n < len(self.strings):
            self.strings = pa.concat_arrays([self.strings[:n]])


class _Ids:
    """Ids of numbered chunks, one after the other, in arrays that grow."""

    def __init__(self):
        self.ids, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(flat)
        if n > len(self.starts):
            more = np.zeros(n + n // 2 - self.n, np.int64)
            self.starts, self.lengths = np.concatenate([self.starts[: self.n], more]), np.concatenate([self.lengths[: self.n], more])
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(used + used // 2 - self.used, np.uint32)])
        self.ids[self.used : used] = flat
        self.starts[self.n : n], self.lengths[self.n : n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = n, used

    def cut(self, n: int) -> None:
        """Forgets all chunks from number n on."""
        if n < self.n:
            self.n, self.used = n, int(self.starts[n])

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the chunks, one after the other."""
        sizes = self.lengths[numbers]
        take = np.repeat(self.starts[numbers] - (np.cumsum(sizes) - sizes), sizes)
        take += np.arange(len(take))
        return self.ids[take]


class Encoder:
    """Encodes lists of texts with a tokenizers file.

    keep: about so many chunks are remembered from list to list. That changes the speed alone, never the ids.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaced, self.text_of, self.to_model = (_word_spaced, _same, str.lower) if self.library.normalizer is not None else (_byte_spaced, _byte_texts, _byte_word)
        self.between = next(((n, t.content) for n, t in sorted(self.library.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        #: Chunks and their two parts, and the places of their ids. Part 0 is empty.
        self.chunks, self.parts = _Known(), _Known([""])
        self.chunk_ids, self.part_ids = _Ids(), _Ids()
        self.part_ids.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each chunk of all texts, and the number of chunks of each text. Arrow cuts the texts and looks the chunks up."""
        if len(self.chunks) > self.keep:
            self._forget()
        spaced = list(map(self.spaced, texts))
        plain = [t for t in spaced if t is not None]
        counts, is_plain = np.zeros(len(texts), np.int64), np.fromiter((t is not None for t in spaced), bool, len(spaced))
        pieces = pa.array([], pa.large_string())
        if plain:
            pieces = pc.split_pattern(pa.array([" ".join(plain)], pa.large_string()), " ").flatten()
            n = np.fromiter((t.count(" ") for t in plain), np.int64, len(plain)) + 1
            some = pc.greater(pc.binary_length(pieces), 0)
            if not pc.all(some).as_py():
                n = np.add.reduceat(some.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n) - n)
                pieces = pieces.filter(some)
            counts[is_plain] = n
        if len(plain) < len(texts):
            cut = [_byte_rare(t) for t, s in zip(texts, spaced) if s is None]
            counts[~is_plain] = np.fromiter(map(len, cut), np.int64, len(cut))
            pieces = pa.concat_arrays([pieces, pa.array(list(chain.from_iterable(cut)), pa.large_string())])
        numbers, new = self.chunks.numbers(pieces)
        if len(new):
            self._learn(new)
        if 0 < len(plain) < len(texts):  # back into the order of the texts
            at, whole = np.repeat(is_plain, counts), np.zeros(len(numbers), np.int64)
            edge = int(at.sum())
            whole[at], whole[~at] = numbers[:edge], numbers[edge:]
            numbers = whole
        self.fresh, self.seen = len(new), len(numbers)
        return numbers, counts

    def _forget(self) -> None:
        """Chunks met last go; all go where a quarter of the last list's were new, or the parts are many."""
        if 4 * self.fresh > self.seen or len(self.parts) > 2 * self.keep:
            self._clear()
        else:
            self.chunks.cut(self.keep)
            self.chunk_ids.cut(self.keep)

    def _library_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and their counts.

        A word of plain letters is one piece to the pre-tokenizer, so the library's model takes it at once; other texts go
        through the whole library, a hundred at a time, a special token between.
        """
        got: list[list[int]] = [[]] * len(texts)
        tokens, word, odd = self.library.model.tokenize, _PLAIN.fullmatch, []
        for i, t in enumerate(texts):
            if word(t):
                got[i] = [x.id for x in tokens(self.to_model(t))]
            else:
                odd.append(i)
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            got[i] = ids
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _whole(self, texts: list[str]) -> list:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        if self.between is None or any(self.between[1] in t for t in texts):
            return [e.ids for e in encode(texts, add_special_tokens=False)]
        joined = [self.between[1].join(texts[i : i + 100]) + self.between[1] for i in range(0, len(texts), 100)]
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in encode(joined, add_special_tokens=False))])
        ends = np.flatnonzero(flat == self.between[0])
        return [x[:-1].tolist() for x in np.split(flat, ends + 1)[:-1]]

    def _learn(self, new: pa.Array) -> None:
        """Ids of new chunks. Full stops and commas behind a word are a part of their own, so that the library sees a word once."""
        chunks = self.text_of(new)
        words = pc.utf8_rtrim(chunks, ",.")
        whole, size = pc.binary_length(chunks), pc.binary_length(words)
        split = pc.and_(pc.less(size, whole), pc.match_substring_regex(words, _WORD))
        words = pc.if_else(split, words, chunks)
        at = np.flatnonzero(split.to_numpy(zero_copy_only=False))
        ends = chunks.take(pa.array(at))
        ends = pc.utf8_ltrim(ends, f" \n{_LETTERS}")
        numbers, todo = self.parts.numbers(pa.concat_arrays([words, ends]))
        if len(todo):
            self.part_ids.add(*self._library_ids(todo.to_pylist()))
        pairs = np.zeros((len(new), 2), np.int64)
        pairs[:, 0], pairs[at, 1] = numbers[: len(new)], numbers[len(new) :]
        self.chunk_ids.add(self.part_ids.of(pairs.ravel()), self.part_ids.lengths[pairs].sum(1))

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        numbers, chunks = self._look_up(texts)
        ends = np.concatenate([[0], np.cumsum(self.chunk_ids.lengths[numbers])])
        edges = np.concatenate([[0], np.cumsum(chunks)])
        return ends[edges[1:]] - ends[edges[:-1]]

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by end_id, and each text's count (with that id)."""
        numbers, chunks = self._look_up(texts)
        flat = self.chunk_ids.of(numbers)
        ends = np.concatenate([[0], np.cumsum(self.chunk_ids.lengths[numbers])])
        edges = np.concatenate([[0], np.cumsum(chunks)])
        counts = ends[edges[1:]] - ends[edges[:-1]]
        out = np.full(len(flat) + len(texts), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts + 1) - 1] = False
        out[keep] = flat
        return out, counts + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file; it stays for the worker's next tasks."""
    return Encoder(path)
