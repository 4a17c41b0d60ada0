"""Passages of 50 words and more at random places, by a rule of their own: not by chunks()."""

import random

from tessera.llm.line_chunks import drop_repeated_chunks

SHAPES = [(2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (12, 5), (2, 25)]


def test_planted_passages_go_whole(spark):
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(n) for _ in range(k)] for k, n in SHAPES for _ in range(4)] + [[line(3), "", line(49), line(4), "", line(1)], [line(5), line(70), line(1)]]
    rows, planted = [], {}
    for number, passage in enumerate(passages):
        for copy in range(10):
            lines = [line(rng.randrange(1, 15)) for _ in range(rng.randrange(0, 20))]
            at = rng.randrange(len(lines) + 1)
            i = 1000 * copy + number
            planted[i] = (passage, lines[:at], lines[at:])
            rows.append((i, "\n".join([*lines[:at], *passage, *lines[at:]])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for r in drop_repeated_chunks(df).collect():
        passage, before, after = planted[r["doc_id"]]
        want = [*before, *(passage if r["doc_id"] < 1000 else []), *after]
        assert r["dedup"]["text"] == "\n".join(want)
        assert r["dedup"]["n_removed"] == (0 if r["doc_id"] < 1000 else len(passage)) and r["dedup"]["n_lines"] == len(passage) + len(before) + len(after)


def test_a_line_over_and_over_stays_once(spark):
    text = "\n".join(["one line of eight words stands here again"] * 30)
    got = drop_repeated_chunks(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dedup"]["text"] for r in got}[1].startswith("one line") and {r["doc_id"]: r["dedup"]["text"] for r in got}[2] == ""
