"""Repetition coverage (operator 5): rolling hashes of several n-gram lengths measure what share of a text repeats itself."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, no_null, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
#: Lengths of n-grams, and the largest share of characters, and of words, inside those that occurred before in the text.
ORDERS, NGRAMS_LIMIT = (5, 6, 7, 8, 9, 10), 0.20
#: The same for characters inside repeated lines, for repeated lines among lines, and for symbols beside words. All limits are
#: shares, and hold at every size: a line that stands at the top and at the end of a short text of three lines is below them.
LINE_CHARS_LIMIT, LINES_LIMIT, SYMBOLS_LIMIT = 0.20, 0.40, 0.10
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "struct<" + ", ".join(f"{f}: bigint" for f in FIELDS) + ", ngram_chars: array<double>, ngram_words: array<bigint>, line_chars: double, lines: double>"


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    return n[at] > 1


def _again(values: np.ndarray) -> np.ndarray:
    """Which values occurred before."""
    out = np.ones(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = False
    return out


def _covered(repeated: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a repeated window of n words."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, np.flatnonzero(repeated), 1)
    np.add.at(edge, np.flatnonzero(repeated) + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _rolled(ids: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, a hash of each n words in a row), by rising n: h(i, n) = h(i, n - 1) * base + word(i + n - 1), mixed once more for use."""
    word = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    word ^= word >> np.uint64(29)
    h, n = word.copy(), 1
    for order in sorted(orders):
        while n < order and len(h):
            h = h[:-1] * _BASE + word[n:]
            n += 1
        if n == order:
            mixed = h * _MIX
            yield order, mixed ^ mixed >> np.uint64(31)


def measure(text: str, orders: tuple[int, ...] = ORDERS) -> tuple:
    """The FIELDS; for each order the share of characters, and the words, in n-grams that occurred before; the share of characters in repeated lines, and that of repeated lines."""
    words = WORD.findall(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    symbols = len(_SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if WORD.search(x)] if "\n" in text else []
    seen, repeats, repeat_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            repeats += 1
            repeat_chars += len(x)
        seen.add(x)
    line_chars = repeat_chars / sum(map(len, lines)) if repeats else 0.0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    # Three-word windows by exact numbers: a pair's rank, then that rank with the third word.
    in_repeats = 0
    shares, inside = [0.0] * len(orders), [0] * len(orders)
    if n > 3:
        rank = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        found = _repeated(rank[:-1] * len(number) + ids[2:])
        if found.any():
            in_repeats = int(_covered(found, 3, n).sum())
            for order, h in _rolled(ids, orders):
                # A longer window can repeat only where its first three words do.
                start = np.flatnonzero(found[: len(h)]) if order >= 3 else np.arange(len(h))
                start = start[_again(h[start])]
                if len(start):
                    hit = np.zeros(len(h), bool)
                    hit[start] = True
                    covered = _covered(hit, order, n)
                    k = orders.index(order)
                    shares[k], inside[k] = float(lengths[covered].sum() / chars), int(covered.sum())
    return n, chars, symbols, repeats, in_repeats, shares, inside, line_chars, repeats / len(lines) if lines else 0.0


def repetition_rules(docs: DataFrame, text_col: str = "text", name: str = "repetition", ngrams_limit: float = NGRAMS_LIMIT, line_chars_limit: float = LINE_CHARS_LIMIT, lines_limit: float = LINES_LIMIT, symbols_limit: float = SYMBOLS_LIMIT) -> DataFrame:
    """docs with a struct column of that name added: FIELDS, shares of repetition, base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in three-word windows that occur twice or more.
    kept: not base_failed, and no share above its limit (symbols at most symbols_limit of the words). ngram_words holds how
    many words each order's repeats cover. Each row is measured alone and whole: no shuffle, all rows kept, memory bound by
    one text. Null texts have no words: base_failed. Repeated rows get equal results; an empty table gives an empty one. name must not be a column of docs, in any case of letters; all its columns stay.
    """
    free_names(docs, name)

    @F.arrow_udf(SCHEMA)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [measure(t) for part in text_slices(texts) for t in part]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.list_(pa.float64())), pa.array(cols[6], pa.list_(pa.int64())), pa.array(cols[7], pa.float64()), pa.array(cols[8], pa.float64())], [*FIELDS, "ngram_chars", "ngram_words", "line_chars", "lines"])

    m = F.col(name)
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    over = (m["line_chars"] > line_chars_limit) | (m["lines"] > lines_limit) | (m["n_symbols"] > symbols_limit * m["n_words"])
    over = over | (F.array_max(m["ngram_chars"]) > ngrams_limit) | (F.array_max(m["ngram_words"]) > ngrams_limit * m["n_words"])
    fields = [m[f].alias(f) for f in (*FIELDS, "ngram_chars", "ngram_words", "line_chars", "lines")]
    return docs.withColumn(name, measured.asNondeterministic()(no_null(text_col))).withColumn(name, F.struct(*fields, failed.alias("base_failed"), (~failed & ~over).alias("kept")))
