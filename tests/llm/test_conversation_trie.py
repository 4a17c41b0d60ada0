"""The trie against plain Python: the whole table, odd rows, and many small random ones in blocks of a few places."""

import random

import pytest
from brute_trie import brute_rebuilt, brute_trie

from tessera.llm import queries
from tessera.llm.conversation_trie import conversation_trie, prefix_trie, rebuilt

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, place string, seq int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_prefix_trie(spark, SF)) == sorted(brute_trie(brute_rebuilt(rows)), key=repr)


def test_rebuilt(spark):
    rows = [(c, t, "u" if (t or 0) % 2 else None, f"text {c} {t}" if (t or 1) % 3 else None) for c in range(13) if c % 7 for t in (None, *range(c % 11))]
    got = {r["id"]: len(r["seq"]) for r in rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {c: len(s) for c, s in brute_rebuilt(rows).items()}


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", ""), (1, 0, "u", ""), (2, 5, "u:1", "x"), (3, 5, "u", ":1x"), (None, 1, "u", "lost"), (5, 1, "u", "long " * 50_000), (6, 2, "ü", "ß"), (11, 1, "u", "a"), (11, 1, "u", "a")]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA).repartition(3)
    assert rows_of(conversation_trie(df)) == sorted(brute_trie(brute_rebuilt(rows)), key=repr)
    assert conversation_trie(df.limit(0)).collect() == []


@pytest.mark.parametrize(("size", "n", "letters", "seed"), [(1, 30, 2, 1), (2, 60, 2, 2), (3, 120, 3, 3), (7, 200, 2, 4), (64, 300, 2, 5), (5, 40, 1, 6)])
def test_blocks(spark, size, n, letters, seed):
    rng = random.Random(seed)
    convs = {i: [("u", "ab" * rng.randrange(letters)) for _ in range(rng.choice([0, 1, 2, 3, 6, 9]))] for i in rng.sample(range(10_000), n)}
    rows = [(c, k, r, t) for c, s in convs.items() for k, (r, t) in enumerate(s)]
    given = spark.createDataFrame([(c, [(r.encode() + b":" + t.encode(), len(t)) for r, t in s]) for c, s in convs.items()], "id long, seq array<struct<key binary, bytes long>>")
    assert rows and rows_of(prefix_trie(given, size)) == sorted(brute_trie(convs), key=repr)
