"""The registered queries themselves, with production parameters, over a whole table: against SQL or plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import compare
from test_operators import brute_dedup, brute_print
from test_pipeline import brute_pieces
from tokenizers import Tokenizer

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None


def test_token_files(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for i, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op2_token_files(spark, SF).collect())) == want


def test_simhash(spark, docs):
    prints = {i: brute_print(t) for i, t in docs}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(map(tuple, queries.op3_gray_simhash(spark, SF).collect())) == [(i, f"{p:016x}", top(i)) for i, p in sorted(prints.items())]


def test_packing(spark, docs):
    rows = queries.op4_binary_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == brute_pieces(docs)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] == 1 << r["bucket"] for r in rows)
    total = defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_line_chunks(spark, docs):
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in queries.op9_line_chunks(spark, SF).collect()), key=repr)
    assert got == brute_dedup(docs)
