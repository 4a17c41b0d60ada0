"""Substring dedup against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tessera.llm import queries
from tessera.llm.suffix_trees import drop_repeated_windows, repeated_spans

SF = "/root/testdata/sf0.001"


def brute(texts, window=35):
    """[(kept text, words, removed words)] of each text, in order."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((" ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    return out


def rows_of(df):
    return sorted(((r["doc_id"], *r["substrings"]) for r in df.collect()), key=repr)


def wanted(rows, window=35):
    return sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], window), strict=True)), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, kept, n, gone in wanted(rows))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op13_suffix_trees(spark, SF).collect()) == want
    assert sum(w[2] for w in want) > 1000


def odd_rows():
    rng = random.Random(1)
    word = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    shared, short = word(35), word(34)
    rows = [(1, f"{word(20)} {shared} {word(9)}"), (2, f"{shared}\n\t{word(3)}"), (3, f"{word(50)}  {shared.replace(' ', chr(11))}"), (4, f"{short} a"), (5, f"b {short}"), (6, None), (7, ""), (8, " \n "), (9, "é café\xa0x 　y " * 30), (10, "ha " * 3000), (11, "ha " * 35), (12, "ab cd " * 40), (13, word(60)), (14, word(30_000)), (None, word(40)), (None, None)]
    rows += [(20, rows[0][1]), (20, rows[0][1]), (21, rows[12][1]), (22, rows[12][1] + " tail"), (23, short), (23, short), (24, " ".join([shared] * 3)), (25, f"{word(10)} {shared} {shared} {word(5)}")]
    return rows


@pytest.mark.parametrize(("gram", "group", "held"), [(8, 1 << 17, 1 << 15), (1, 1 << 17, 7), (8, 3, 100), (20, 0, 100), (35, 1 << 17, 1)])
def test_odd_rows(spark, gram, group, held):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "t", 3) for r in rows], "doc_id long, text string, aid long, t0 string, gram int").repartition(4)
    out = drop_repeated_windows(df, gram=gram, group=group, held=held)
    assert rows_of(out) == wanted(rows) and out.columns == [*df.columns, "substrings"]


def test_empty_and_names(spark):
    df = spark.createDataFrame([(1, "a " * 100)], "doc_id long, text string")
    assert drop_repeated_windows(df.limit(0)).collect() == [] and repeated_spans(df.limit(0)).collect() == []
    for bad in ({"name": "TEXT"}, {"gram": 0}, {"gram": 36}):
        with pytest.raises(ValueError, match="has"):
            drop_repeated_windows(df, **bad)


@pytest.mark.parametrize(("window", "letters", "seed"), [(1, 3, 1), (2, 2, 2), (5, 2, 3), (12, 2, 4), (12, 5, 5)])
def test_small_alphabets(spark, window, letters, seed):
    """Few different words: windows repeat within texts and across them, periods and all."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abcde"[:letters]) for _ in range(rng.randrange(3 * window + 8)))) for i in range(25)]
    out = drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), window=window, gram=max(1, window // 4), held=50)
    assert rows_of(out) == wanted(rows, window)
