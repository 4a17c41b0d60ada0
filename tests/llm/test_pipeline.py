"""run() and its stages against plain Python, stage by stage, on the given table and on odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from brute_near import brute_near
from test_operators import brute_chunks
from test_repetition import brute as brute_rules
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    """rows (id, text), by id: texts without the chunks that stood before."""
    seen, out = set(), []
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for first, n in brute_chunks(text):
            c = "\n".join(lines[first : first + n])
            gone |= set(range(first, first + n)) if c in seen else set()
            seen.add(c)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def brute_clean(rows, items):
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    shingles = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    wanted = [(k, shingles(w, k)) for w in map(words, items) if (k := min(5, len(w)))]
    out = []
    for i, t in rows:
        own = {k: shingles(words(t), k) for k in {k for k, _ in wanted}}
        if not any(len(s & own[k]) >= 0.8 * len(s) - 1e-9 for k, s in wanted):
            out.append((i, t))
    return out


def brute_pieces(rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 1], 0
        while at < len(ids):
            n = min(2048, 1 << (len(ids) - at).bit_length() - 1)
            out.append((i, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n]))))
            at += n
    return sorted(out)


def packed(df):
    return sorted((r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in df.collect())


def test_run_against_plain_python(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t or "") for i, t in docs if brute_rules(t or "")[4]]
    rows = brute_clean(brute_near(brute_lines(rows)), items)
    assert 50 < len(rows) < len(docs)
    assert packed(corpus_pipeline.run(spark, SF)) == brute_pieces(rows)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    say = lambda k: " ".join(f"w{rng.randrange(10**5)}" for _ in range(k))
    a, b, passage = say(80), "\n".join(say(12) for _ in range(9)), "\n".join(say(15) for _ in range(5))
    rows = [(1, a), (1, a), (2, a), (3, b), (4, f"{say(60)}\n{passage}\n{say(9)}"), (5, f"{say(70)}\n{passage}\n{say(7)}"), (6, None), (None, say(90)), (None, None), (7, ""), (8, "x " * 400), (9, say(200_000)), (10, f"{say(60)} {a}")]
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "p", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __rules string, __dedup int").repartition(3)


def test_stages_on_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF), "odd")
        assert out.columns == odd.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
        if name == "quality rules":
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter([1, 1, 2, 3, 4, 5, None, 9, 10])
        if name == "line dedup":
            by = defaultdict(list)
            for r in docs.collect():
                by[r["doc_id"]].append(r["text"])
                assert r["n_chars"] == len(r["text"])
            assert by[2] == [""] and len(by[1]) == 2 and all(by[1]) and len(by[4][0].split("\n")) == 7 and len(by[5][0].split("\n")) == 2
        if name == "SimHash near-dedup":
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter([1, 2, 3, 4, 5, None, 9, 10])
    last = corpus_pipeline.packing(spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.count() and corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0


