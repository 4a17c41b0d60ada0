"""Counts by both libraries, over texts short and long."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import token_counts as module
from tessera.llm.common import text_slices
from tessera.llm.queries import BYTE_BPE, op7_token_counts
from tessera.llm.token_counts import PieceCounts, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  two  spaces ", "of the word", "line\nline\t tab", "<s> in text </s>", "é ü 漢字 \U0001f600", "x" * 500, "no.cut,here 1 2 3"]


def test_piece_model_counts_whole_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    words = "of the and word, other. New 12 a é \n  漢字".split(" ")
    texts = [*TEXTS, " ".join(rng.choice(words) for _ in range(60_000)), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(rows, MODEL).collect()} == want


def test_pieces_are_cut(monkeypatch):
    monkeypatch.setattr(module, "LONG", 20)
    counts = PieceCounts(MODEL)
    assert counts.safe
    text = "some words that go on. and on, then 12 more words to the end of it"
    assert len(counts.pieces(text)) > 2
    assert counts.counts([text, "", text]).tolist() == [len(counts.model.encode(t)) for t in (text, "", text)]


def test_lists_are_balanced_by_bytes():
    texts = pa.array(["é" * 10, None, "a" * 10, "b" * 50, "c"])
    assert list(text_slices(texts, 30)) == [["é" * 10, "", "a" * 10], ["b" * 50], ["c"]]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_counts_the_table(spark, sf):
    library = Tokenizer.from_file(BYTE_BPE)
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs}
    got = op7_token_counts(spark, f"/root/testdata/{sf}").collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got} == want and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
