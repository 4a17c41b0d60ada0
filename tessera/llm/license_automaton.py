"""Licence scans with a generalised suffix automaton (operator 10).

The automaton holds every run of words of every template. A text streams through it once, which gives for each place the
longest run that ends there and lies in a template (matching statistics). Long runs are chained where they follow one
another in a template, so that a template that is wrapped, cut short or slightly changed still gives one covered span.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import no_null, text_slices
from tessera.llm.licence_notices import TEMPLATES

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases whose words in a row name a licence.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: A run counts from so many words; runs of a chain lie at most GAP words apart; a chain names its template when it covers COVER of it.
#: A span's share is what is covered of the template or of the span, whichever is longer.
#: Of spans that share over half of the shorter one the one of the largest share stays (of equal shares the longest, then all).
RUN, GAP, COVER = 5, 12, 0.8


class SuffixAutomaton:
    """Of several word sequences. ends[s]: for each template that holds the state's runs, the place where the run first ends.

    held[s] adds those that hold only a shorter end of the state's runs: template to (its longest, the place where it first ends).
    """

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [{}]
        for t, words in enumerate(sequences):
            last = 0
            marks = []
            for i, w in enumerate(words):
                last = self._extend(last, w)
                marks.append((last, i))
            for state, i in marks:
                while state > 0 and t not in self.ends[state]:
                    self.ends[state][t] = i
                    state = self.link[state]
        self.held: list[dict] = [{}] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):  # links are shorter
            self.held[s] = self.held[self.link[s]] | {t: (self.length[s], i) for t, i in self.ends[s].items()}

    def _new(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state of its own for the runs of q that are no longer than p's and w."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.ends[clone] = dict(self.ends[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the longest run that ends there, and its state."""
        state = size = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            yield size, state


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class LicenceScan:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        cut = lambda s: _WORD.findall(s.encode("utf-8", "replace").lower())
        self.number = _Numbers()
        flat = [(label, text) for label, texts in templates.items() for text in texts]
        for s in (*phrases, *(text for _, text in flat)):
            for w in cut(s):
                self.number.setdefault(w, len(self.number))
        self.phrases = [(np.array([self.number[w] for w in cut(s)]), label) for s, label in phrases.items()]
        self.labels = [label for label, _ in flat]
        sequences = [[self.number[w] for w in cut(text)] for _, text in flat]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score, and the spans (label, first_word, last_word, share)."""
        words = _WORD.findall(text.encode("utf-8", "replace").lower())
        n = len(words)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int32, n)
        starts, base = [], set()
        for phrase, label in self.phrases:
            at = np.flatnonzero(ids[: n - len(phrase) + 1] == phrase[0]) if n >= len(phrase) else ids[:0]
            for j in range(1, len(phrase)):
                at = at[ids[at + j] == phrase[j]]
            if len(at):
                base.add(label)
                starts += at.tolist()
        spans = self._spans(ids)
        labels = base | {s[0] for s in spans}
        score = 1.0 if base else min(1.0, max((s[3] for s in spans), default=0.0))
        return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans

    def _spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        # A run lies within neighbouring words that templates know: where none is long enough, the automaton has nothing to do.
        known = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]])))
        begins, ends = known[::2], known[1::2]
        long = ends - begins >= RUN
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for b, e in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            going: dict[int, tuple[int, int]] = {}  # of each template the run that ends here, and where it ends there
            for i, (size, state) in enumerate([*self.automaton.statistics(ids[b:e].tolist()), (0, 0)]):
                now = {t: (min(n, size), end) for t, (n, end) in self.automaton.held[state].items() if min(n, size) >= RUN} if size >= RUN else {}
                for t, (n, end) in going.items():
                    if now.get(t, (0,))[0] != n + 1:
                        runs.setdefault(t, []).append((b + i - n, n, end + 1 - n))
                going = now
        out = []
        for t, found in runs.items():
            chains: list[list[int]] = []  # first place, place behind it, place behind it in the template, covered
            for at, size, there in sorted(found):
                for c in chains:
                    if at <= c[1] + GAP and there + size > c[2] and there >= c[2] - GAP:
                        new = min(size, at + size - c[1], there + size - c[2])
                        if new > 0:
                            c[1], c[2], c[3] = at + size, there + size, c[3] + new
                            break
                else:
                    chains.append([at, at + size, there + size, size])
            out += [(self.labels[t], c[0], c[1] - 1, c[3] / max(self.sizes[t], c[1] - c[0])) for c in chains if c[3] >= COVER * self.sizes[t]]
        return sorted((s for s in set(out) if not any(_beats(o, s) for o in out)), key=lambda s: (s[1], s[0], s[2]))


def _beats(a: tuple, b: tuple) -> bool:
    """Whether span a makes span b needless."""
    shared = min(a[2], b[2]) - max(a[1], b[1]) + 1
    long_a, long_b = a[2] - a[1], b[2] - b[1]
    return 2 * shared > min(long_a, long_b) + 1 and (a[3], long_a) > (b[3], long_b)


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
SCHEMA = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double, spans: array<struct<label: string, first_word: bigint, last_word: bigint, share: double>>>"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of docs.

    Words are those of _WORD after A-Z are lower-cased, and are counted from 0. n_base counts all places of all phrases,
    first_word and last_word are the smallest and the largest start (null if none). labels adds the templates that a
    chain covers to the share COVER (of spans over the same words the best covered); score is 1 if a phrase was found, else the best chain's share, else 0. Each text is
    scanned alone and whole: no shuffle. Null texts are empty: no words, empty labels, score 0. Repeated rows get equal
    results; an empty table gives none; other columns are not read. templates: texts by label, see licence_notices.
    """

    @F.arrow_udf(SCHEMA)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = LicenceScan(phrases, templates).scan
        for texts in batches:
            rows = [scan(t) for part in text_slices(texts) for t in part]
            cols = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
            spans = [[dict(zip(("label", "first_word", "last_word", "share"), s, strict=True)) for s in x] for x in cols[-1]]
            yield pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip([*cols[:-1], spans], _FIELDS, strict=True)], [f for f, _ in _FIELDS])

    out = docs.select(F.col(id_col), scanned.asNondeterministic()(no_null(text_col)).alias("__s"))
    return out.select(id_col, *(F.col("__s")[f].alias(f) for f, _ in _FIELDS))
