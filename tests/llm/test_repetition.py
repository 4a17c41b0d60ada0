"""Repetition measures against plain Python, on odd texts and on the given table."""

import random
from collections import Counter

import pytest

from tessera.llm.queries import op5_repetition
from tessera.llm.repetition import measure, repetition_rules

SPACE = " \t\n\x0b\x0c\r"
ORDERS = (5, 6, 7, 8, 9, 10)


def words_of(text):
    out, held = [], ""
    for c in text + " ":
        if c in SPACE:
            out += [held] * bool(held)
            held = ""
        else:
            held += c
    return out


def brute(text):
    w = words_of(text)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    symbols = sum(c in "#*$%&|<>" for c in text)
    shares, covers = {}, {}
    for n in ORDERS:
        seen, hit = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                hit |= set(range(i, i + n))
            seen.add(g)
        shares[n], covers[n] = sum(len(w[i]) for i in hit) / max(1, sum(map(len, w))), len(hit)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    over = symbols > 0.1 * len(w) or bool(again) and (sum(map(len, again)) > 0.2 * sum(map(len, lines)) or len(again) > 0.4 * len(lines))
    over = over or any(shares[n] > 0.2 or covers[n] > 0.2 * len(w) for n in ORDERS)
    return (len(w), sum(map(len, w)), symbols, len(again), len(inside)), shares, covers, failed, not failed and not over


def texts():
    rng = random.Random(9)
    say = lambda k, of=5000: [f"w{rng.randrange(of)}" for _ in range(k)]
    passage = say(20)
    out = [*(" ".join([*say(35), *passage, *say(35), *passage]) for _ in range(3)), " ".join(say(400, 6)), "\n".join([" ".join(say(9))] * 12), "", " \n\t", "a b c d", "# $ % & " * 30]
    for _ in range(25):
        w = say(rng.randrange(60, 300), rng.choice([8, 60, 4000]))
        at = rng.randrange(len(w))
        out.append(" ".join(w + w[at : at + rng.randrange(70)] + say(rng.randrange(40))))
    out += ["\n".join(rng.choice(x.split(" ")[:9]) + " " + x for x in out[:5]), "é 漢字 \xa0x " * 40, "same text " * 2000]
    return out


def test_measures_against_brute_force(spark):
    rows = [*enumerate(texts()), (900, None), (900, None), (None, texts()[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __m string").repartition(4)
    got = repetition_rules(df, name="r")
    assert got.columns == ["doc_id", "text", "__m", "r"]
    for row in got.collect():
        base, shares, covers, failed, kept = brute(row["text"] or "")
        r = row["r"]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["ngram_chars"] == pytest.approx(list(shares.values())) and r["ngram_words"] == list(covers.values())
        assert (r["base_failed"], r["kept"]) == (failed, kept)


def test_a_short_repeat_is_measured():
    rng = random.Random(1)
    say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    p = say(20)
    assert measure(" ".join([*say(35), *p, *say(35), *p]))[6] == [20] * 6


def test_query_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op5_repetition(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        base, _, _, failed, kept = brute(docs[r["doc_id"]] or "")
        assert tuple(r)[1:] == (*base, failed, kept)


def test_name_in_use(spark):
    with pytest.raises(ValueError):
        repetition_rules(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, REPETITION int"))
