"""Token counts of whole texts, without keeping the ids (operator 7)."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, no_null, text_slices
from tessera.llm.encoding import encoder


#: Texts of more characters are cut for the sentencepiece library, into pieces of about so many.
LONG = 1 << 16
#: Where every word piece ends: one space between plain letters.
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class PieceCounts:
    """Counts by a sentencepiece file, without begin and end pieces. Long texts are cut at single spaces between plain letters.

    A cut leaves the space out, as a model puts one before each text that it is given. Models that do otherwise, or whose
    pieces reach over spaces, are found by a trial, and no text is cut for them.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        across = any("\u2581" in self.model.id_to_piece(i).lstrip("\u2581") for i in range(self.model.get_piece_size()))
        self.safe = not across and self.model.encode("of the word of") == [x for t in ("of", "the", "word", "of") for x in self.model.encode(t)]

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LONG or not self.safe:
            return [text]
        out, at = [], 0
        while len(text) - at > LONG and (cut := _CUT.search(text, at + LONG)):
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def counts(self, texts: list[str]) -> np.ndarray:
        pieces = [self.pieces(t) for t in texts]
        sizes = np.fromiter((len(ids) for ids in self.model.encode([p for t in pieces for p in t], num_threads=1)), np.int64)
        ends = np.cumsum([0, *map(len, pieces)])
        total = np.concatenate([[0], np.cumsum(sizes)])
        return total[ends[1:]] - total[ends[:-1]]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    tokenizer: path of a tokenizers .json or a sentencepiece .model file, at the same place on every executor.
    Texts go to the library in batches of a few MB, balanced by bytes. Texts are cut at places where the tokenizer cuts
    them as well (see encoding.py and PieceCounts), so that the sum over the pieces is the whole text's count, whatever its length.
    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows, an empty table none; other columns
    of docs, whatever their names, are not read.
    """

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = (PieceCounts(tokenizer) if tokenizer.endswith(".model") else encoder(tokenizer)).counts
        for texts in batches:
            yield pa.array(np.concatenate([[], *(counts(t) for t in text_slices(texts, 2 * SLICE_BYTES))]).astype(np.int64), pa.int64())

    rows = docs.select(F.col(id_col), no_null(text_col).alias("__text"))
    return rows.select(id_col, F.octet_length("__text").cast("long").alias("n_bytes"), lengths.asNondeterministic()("__text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
