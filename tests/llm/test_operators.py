"""Each operator against a brute-force version, on small tables with nulls, ties, repeated rows, odd texts and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from brute_near import Sets, brute_near, shingles, similarity
from tokenizers import Tokenizer

from tessera.llm.binary_packing import binary_lengths, pack_binary, write_buckets
from tessera.llm.containment import contained_items
from tessera.llm.encoding import Encoder
from tessera.llm.gray_simhash import GrayIndex, components, near_duplicates
from tessera.llm.license_automaton import SuffixAutomaton, scan_licences
from tessera.llm.line_chunks import drop_repeated_chunks
from tessera.llm.near_copies import alike, keep_one
from tessera.llm.queries import BYTE_BPE, WORD_BPE
from tessera.llm.range_coder import decode_block, encode_block
from tessera.llm.repetition import repetition_rules
from tessera.llm.site_style import extract_text, main_text
from tessera.llm.token_counts import token_counts
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.llm.warc_shards import read_warc, write_warc

LONG = "some long words and more of them, again. " * 4000
ODD = ["", " ", "a  b", " lead and trail ", "tab\tand\n\n lines", "x<|endoftext|>y <|endoftext|> z", "don't, 's ..., a.b,c", "é café, \xa0x 　y", "\x1c a\x1c b", "²³ x² ³y 12,000.5", "A" * 300, "foo <|startoftext|>bar", "İI ΣΑΣ ΑΣ, ß", "a\r\nb \r\n c", " \n a", "%%%. ###, a&&&.", "\rabc", LONG, "été, café", "same text here", "same text here"]
SCHEMA = "doc_id long, text string, n_tokens string, fingerprint int, length string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, None) for i, t in enumerate(ODD)] + [(100, None, None, None, None), (100, None, None, None, None), (None, "no id", "y", 2, "z"), (7, "same id again", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=repr)


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encoder_is_the_library(path):
    enc = Encoder(path, keep=20)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)]
    for _ in range(3):
        assert enc.counts(ODD).tolist() == [len(w) for w in want]
        ids, counts = enc.encode(ODD, 9)
        assert ids.tolist() == [x for w in want for x in [*w, 9]]
        assert counts.tolist() == [len(w) + 1 for w in want]


def test_token_counts(docs, none):
    library = Tokenizer.from_file(BYTE_BPE)
    want = sorted(((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in texts(docs)), key=repr)
    assert sorted(map(tuple, token_counts(docs, BYTE_BPE).collect()), key=repr) == want
    assert token_counts(none, BYTE_BPE).count() == 0


def test_packing(docs, none, tmp_path):
    library = Tokenizer.from_file(WORD_BPE)
    got = pack_binary(docs, WORD_BPE, 1, 64)
    rows = got.collect()
    by = defaultdict(list)
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"]
        by[r["doc_id"], r["sequence_id"] >> 40].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert sum(r["length"] for r in rows) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts(docs))
    want = Counter((i, tuple([*library.encode(t, add_special_tokens=False).ids, 1])) for i, t in texts(docs))
    made, parts = Counter(), []
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        if r["start"] == 0:
            parts = []
        assert r["start"] == len(parts)
        parts += np.frombuffer(r["ids"], "<u4").tolist()
        if len(parts) == r["doc_tokens"]:
            made[r["doc_id"], tuple(parts)] += 1
    assert made == want
    assert binary_lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]
    buckets = write_buckets(got, str(tmp_path / "b"))
    key = lambda df: Counter((r["doc_id"], r["start"], r["bucket"], bytes(r["ids"])) for r in df.collect())
    assert key(buckets) == key(got) and all(r["length"] == 1 << r["bucket"] for r in buckets.collect())
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} == {f"bucket={r['bucket']}" for r in rows}
    assert pack_binary(none, WORD_BPE, 1).count() == 0
    with pytest.raises(ValueError):
        pack_binary(docs, WORD_BPE, 1, 100)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 9000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.zipf(1.3, n) % 50257, np.full(n, 7), np.tile(rng.integers(0, 50257, 40), n // 40 + 1)[:n]):
        data = encode_block(ids.astype(np.uint32), 50257)
        assert (decode_block(data, 50257) == ids).all()
        if n > 2:
            with pytest.raises(ValueError):
                decode_block(data[:-1] + bytes([data[-1] ^ 1]), 50257)


@pytest.mark.parametrize("vocabulary", [1, 2, 300, 1 << 20])
def test_range_coder_vocabularies(vocabulary):
    for ids in (np.random.default_rng(1).integers(0, vocabulary, 5000), np.full(5000, vocabulary - 1)):
        assert (decode_block(encode_block(ids.astype(np.uint32), vocabulary), vocabulary) == ids).all()
    with pytest.raises(ValueError):
        encode_block(np.zeros(1, np.uint32), (1 << 20) + 1)


def test_repeated_ids_compress():
    ids = np.tile(np.arange(500), 200).astype(np.uint32)
    assert len(encode_block(ids, 50257)) < len(ids) // 2


def test_token_files(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(BYTE_BPE)
    write_token_files(docs, f"file://{tmp_path}/a", BYTE_BPE, 0)
    rows = read_token_files(spark, f"file://{tmp_path}/a").collect()
    want = Counter((i, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in texts(docs))
    assert Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in rows) == want
    rows.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(len(rows))]
    write_token_files(none, f"file://{tmp_path}/b", BYTE_BPE, 0)
    assert read_token_files(spark, f"file://{tmp_path}/b").count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, docs, none):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = texts(docs)
    for i in range(200, 320):
        t = [rng.choice(words) for _ in range(400)]
        rows.append((i, " ".join(t)))
        for k in range(rng.choice([0, 0, 1, 3])):
            t[rng.randrange(400)] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    prints = {(i, t): brute_print(t) for i, t in rows}
    distinct = sorted(set(prints.values()))
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    links = 0
    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 3:
                links += 1
                root[top(b)] = top(a)
    assert links > 10
    least = {}
    for (i, t), p in prints.items():
        if i is not None:
            least[top(p)] = min(least.get(top(p), i), i)
    want = sorted(((i, f"{prints[i, t]:016x}", least.get(top(prints[i, t]))) for i, t in rows), key=repr)
    assert sorted(map(tuple, near_duplicates(df).collect()), key=repr) == want
    assert near_duplicates(none).count() == 0


def test_keep_one(spark, docs, none):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = texts(docs)
    for i in range(200, 250):
        t = [rng.choice(words) for _ in range(300)]
        rows.append((i, " ".join(t)))
        for k in range(rng.choice([0, 1, 1, 2, 4])):
            for _ in range(rng.choice([1, 3, 6, 9])):
                t[rng.randrange(300)] = "changed"
            rows.append((1000 + 10 * i - k, " ".join(t)))
    want = sorted((i is None, i or 0) for i, _ in brute_near(rows))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, __own string, of int").repartition(5)
    # Small parts: hot clusters are split, and every two parts meet.
    for options in ({}, {"split": 2}, {"shingles": 400}):
        kept = keep_one(df, **options)
        got = kept.collect()
        assert kept.columns == df.columns and all(r["__own"] == "x" for r in got)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == want
    assert len(rows) - len(want) > 30
    assert keep_one(docs).columns == docs.columns and keep_one(none).count() == 0


def test_near_copies_found_by_similarity(spark):
    """Of random texts with changed words: nearly all pairs of a similarity of 0.8 and more in each band, and none below."""
    rng, rows, similar = random.Random(15), [], {}
    for i in range(700):
        t = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        u = list(t)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 16])):
            u[rng.randrange(300)] = "changed"
        similar[i] = similarity(set(shingles(" ".join(t))), set(shingles(" ".join(u))))
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(u))]
    kept = {r["doc_id"] for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(2 * i in kept for i in range(700))
    share = lambda low, high: (lambda of: sum(2 * i + 1 not in kept for i in of) / len(of))([i for i, s in similar.items() if low <= s < high])
    found = {(lo, hi): round(share(lo, hi), 3) for lo, hi in ((0.0, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01))}
    print("recall by similarity", found)
    assert found.pop((0.0, 0.8)) == 0 and min(found.values()) >= 0.95


def test_sets_alike():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(120)]
    sets += [s[rng.random(len(s)) < 0.9] for s in sets]
    got = Sets(range(len(sets)))
    for a, b in zip(*alike(sets, 0.8), strict=True):
        got.join(int(a), int(b))
    want = Sets(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if similarity(set(x.tolist()), set(y.tolist())) >= 0.8:
                want.join(i, j)
    groups = lambda s: {frozenset(i for i in range(len(sets)) if s.top(i) == r) for r in map(s.top, range(len(sets)))}
    assert groups(got) == groups(want) and 1 < len(groups(want)) < len(sets)


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12))]))
    group = rng.integers(0, 3, len(prints))
    index = GrayIndex(group, prints)
    got = {frozenset((int(index.prints[a]), int(index.prints[b]))) for x, y in index.pairs() for a, b in zip(x, y, strict=True)}
    want = {frozenset((int(a), int(b))) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and group[i] == group[j] and int(a ^ b).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (5, 5)], "a long, b long")
    got = dict(components(edges).collect())
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[300] == 100
    assert components(edges.limit(0)).count() == 0


def test_repetition(spark, docs, none):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    out = repetition_rules(docs, name="r").collect()
    for row in out:
        t, r = row["text"] or "", row["r"]
        w = word.findall(t)
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if g[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert len(out) == docs.count() and repetition_rules(none).count() == 0
    rng = random.Random(2)
    clean = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
    passage = " ".join(f"p{i}" for i in range(40))
    got = {r["doc_id"]: r["r"]["kept"] for r in repetition_rules(spark.createDataFrame([(1, clean), (2, f"{clean} {passage} {passage} {passage} {passage}"), (3, None)], "doc_id long, text string"), name="r").collect()}
    assert got == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_containment(spark, none, monkeypatch, block):
    from tessera.llm import containment

    monkeypatch.setattr(containment, "BLOCK_BYTES", block)  # 60: items are joined
    words_of = lambda t: re.findall(r"[^\W_]+", t.lower())
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 12, 20, 33, 64, 90, 200])] + [(50, "Two Words"), (51, ""), (52, None), (53, "one")]
    rows = []
    for d in range(120):
        t = [word() for _ in range(rng.choice([3, 50, 400, 3000]))]
        if d % 3 == 0:
            part = (items[d % len(items)][1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(t))
            t[at:at] = part
        rows.append((d, " ".join(t)))
    rows += [(500, None), (501, ""), (502, "TWO, words."), (None, items[3][1]), (7, items[3][1]), (7, items[3][1])]
    want = []
    for d, t in rows:
        for i, s in items:
            w, v = words_of(s or ""), words_of(t or "")
            k = min(5, len(w))
            a, b = ({tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if k else set() for x in (w, v))
            if a and len(a & b) >= 0.8 * len(a) - 1e-9:
                want.append((d, i, len(a & b), len(a), len(a & b) / len(a)))
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 15
    assert sorted(map(tuple, contained_items(df, bench).collect()), key=repr) == sorted(want, key=repr)
    assert contained_items(none, bench).count() == 0 and contained_items(df, bench.limit(0)).count() == 0


def test_no_items_come_to_the_driver_beyond_a_block(spark, monkeypatch):
    from tessera.llm import containment

    monkeypatch.setattr(containment, "BLOCK_BYTES", 60)
    collected = []
    monkeypatch.setattr(containment, "_search", lambda ids, *_: collected.append(ids))
    bench = spark.createDataFrame([(i, f"alpha{i} beta gamma{i} delta epsilon{i} zeta") for i in range(9)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"before alpha{i} beta gamma{i} delta epsilon{i} zeta after") for i in range(9)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contained_items(df, bench).collect()) == [(i, i) for i in range(9)] and not collected


def brute_chunks(text, chunk_words=10, long_words=50):
    """Every chunk by the rule as the docstrings state it: a boundary after a line where the hash of two lines says so, and the shortest runs of 50 words."""
    lines = text.split("\n")
    words = [len(x.split()) for x in lines]
    h = [xxhash.xxh64(x.encode()).intdigest() for x in lines]
    out, first = set(), 0
    for i in range(len(lines) + 1):
        if i == len(lines) or words[i] >= long_words:
            if i - first > 1 and sum(words[first:i]) >= chunk_words:
                out.add((first, i - first))
            if i < len(lines):
                out.add((i, 1))
            first = i + 1
        elif i > first and (i + 1 - first >= 64 or (h[i - 1] * 0x9E3779B97F4A7C15 + h[i]) % (1 << 64) >> 32 & 1 == 0):
            if sum(words[first : i + 1]) >= chunk_words:
                out.add((first, i + 1 - first))
            first = i + 1
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            if sum(words[i:j]) >= long_words:
                if j == i + 1 or sum(words[i : j - 1]) < long_words:  # shortest from its first line
                    out.add((i, j - i))
                if j == i + 1 or sum(words[i + 1 : j]) < long_words:  # shortest to its last line
                    out.add((i, j - i))
    return sorted(out)


def brute_dedup(rows):
    seen, gone = {}, defaultdict(set)
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        lines = t.split("\n")
        for first, n in brute_chunks(t):
            chunk = "\n".join(lines[first : first + n])
            if chunk in seen:
                gone[i, t].update(range(first, first + n))
            seen[chunk] = True
    return sorted(((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]), len(gone[i, t])) for i, t in rows), key=repr)


def test_line_dedup(spark, none):
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    shared = [[line(8) for _ in range(12)], [line(70)], [line(30), line(30)]]
    rows = []
    for d in range(60):
        lines = [line(rng.randrange(1, 15)) for _ in range(rng.randrange(1, 20))]
        for s in shared:
            if rng.random() < 0.4:
                at = rng.randrange(len(lines) + 1)
                lines[at:at] = s
        rows.append((d, "\n".join(lines)))
    rows += [(1000 + i, t) for i, t in rows[:5]] + [(3, rows[3][1]), (2000, ""), (2001, "\n\n\n"), (None, "\n".join(shared[0]))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash string").repartition(4)
    got = drop_repeated_chunks(df)
    assert got.columns == ["doc_id", "text", "hash", "dedup"]
    assert sorted(((r["doc_id"], r["dedup"]["text"], r["dedup"]["n_removed"]) for r in got.collect()), key=repr) == brute_dedup(rows)
    assert sum(r[2] for r in brute_dedup(rows)) > 100
    one = drop_repeated_chunks(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (one["dedup"]["text"], one["dedup"]["n_lines"], one["dedup"]["n_removed"]) == (None, 0, 0)
    assert drop_repeated_chunks(none).count() == 0
    few = spark.createDataFrame([(i, "a b c d e\nf g h i j", 1, 2) for i in range(3)], "doc_id long, text string, __sum int, __gone int")
    assert sorted((r["doc_id"], r["dedup"]["text"], r["__sum"], r["__gone"]) for r in drop_repeated_chunks(few).collect()) == [(0, "a b c d e\nf g h i j", 1, 2), (1, "", 1, 2), (2, "", 1, 2)]
    with pytest.raises(ValueError):
        drop_repeated_chunks(few.withColumnRenamed("__sum", "Dedup"))
    # One long shared line goes wherever it stands, and the first document keeps it.
    assert len({r["doc_id"] for r in got.collect() if shared[1][0] in r["dedup"]["text"]}) == 1


def test_licences(spark, docs, none):
    long = "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the software without restriction"
    rows = [(1, "Released under the MIT License."), (2, "x Apache License, Version 2.0 y CC BY-NC z under the mit license"), (3, long.upper()), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "this work is licensed under a song"), (6, None), (7, "the of and to a")]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["base_labels"] for i in range(1, 8)] == ["mit", "apache-2,cc-by-nc,mit", "", "", "", "", ""]
    assert [got[i]["labels"] for i in range(1, 8)] == ["mit", "apache-2,cc-by-nc,mit", "mit", "gpl-3", "", "", ""]
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[6]["n_words"], got[6]["first_word"]) == (3, 1, 11, 0, None)
    assert got[1]["score"] == 1 and got[7]["score"] == 0 and got[3]["spans"][0]["first_word"] == 0
    assert scan_licences(docs).count() == docs.count() and scan_licences(none).count() == 0
    for r in scan_licences(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        if r["doc_id"] not in (7, 100):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
            assert r["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def test_suffix_automaton():
    rng = random.Random(6)
    sequences = [[rng.randrange(4) for _ in range(30)] for _ in range(4)]
    automaton = SuffixAutomaton(sequences)
    runs = {tuple(s[i:j]): None for s in sequences for i in range(30) for j in range(i + 1, 31)}
    words = [rng.randrange(5) for _ in range(400)]
    for i, (size, state) in enumerate(automaton.statistics(words)):
        assert size == max((n for n in range(31) if n <= i + 1 and tuple(words[i + 1 - n : i + 1]) in runs), default=0)
        for t, end in automaton.ends[state].items():
            assert sequences[t][end + 1 - size : end + 1] == words[i + 1 - size : i + 1]
        assert not size or set(automaton.ends[state]) == {t for t, s in enumerate(sequences) if any(s[k : k + size] == words[i + 1 - size : i + 1] for k in range(30))}


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First  part\n here<br><p>Second &lt;b&gt; &eacute;</p></article><div class="comments"><p>Great!</p></div><footer>&copy; x</footer></body></html>'


def test_main_text():
    assert main_text(PAGE) == "Head & line\nFirst part here\nSecond <b> é"
    assert main_text("") == main_text("<p>") == "" and main_text("plain &amp; text") == "plain & text"
    assert main_text("<div>a<p>b<div>c</div></div>") == "a\nb\nc"
    assert main_text("<table><tr><td>1<td>2<tr><td>3</table><form>no</form><p>y") == "1\n2\n3\ny"
    assert main_text("<div " * 3000) is not None and main_text("<div>" * 34_000 + "deep" + "</i>" * 34_000) == "deep"
    assert main_text('<p>a <i>b</i>c</p><aside>s</aside><p hidden>h</p><header>top</header><main><p>m</p><header>h</header></main>').endswith("m\nh")


def test_site_style_removes_what_pages_share(spark):
    rng = random.Random(7)
    body = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(20))
    texts = [[body(), body()] for _ in range(30)]
    html = [f'<body><div class="x1"><p>Same on all pages</p></div><div class="x2"><p>{a}</p><p>{b}</p></div></body>' for a, b in texts]
    rows = [(i, "http://a.example/p", h) for i, h in enumerate(html)] + [(90, "http://b.example/", html[0]), (91, None, None), (91, None, None), (None, "::", PAGE)]
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r for r in extract_text(df).collect()}
    assert [got[i, "http://a.example/p"]["text"] for i in range(30)] == ["\n".join(t) for t in texts]
    assert got[90, "http://b.example/"]["text"].startswith("Same on all pages") and got[91, None]["text"] == "" and got[91, None]["n_chars"] == 0
    assert extract_text(df).count() == len(rows) and extract_text(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    import base64
    import hashlib

    rows = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, "http://b", "same"), (2, "http://c", "ünï"), (4, None, None), (8, "http://d\r\nx", None), (9, "u", "x" * 200_000), (2, "http://c", "ünï")]
    df = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, payload int").repartition(3)
    for at, kind in (("a", {}), ("b", {"roll_bytes": 100})):
        folder = f"file://{tmp_path}/{at}"
        files = write_warc(df, folder, **kind)
        got = read_warc(spark, folder).collect()
        assert len(got) == len(rows)
        for r in got:
            html = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
        assert {r["page_id"]: r["refers_to"] for r in got} == {1: 5, 3: 5, 5: None, 2: None, 4: 8, 8: None, 9: None}
        assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)
        assert files.agg({"records": "sum"}).first()[0] == len(rows)
        assert len({r["record_id"] for r in got}) == len(rows)
        assert {r["page_id"]: r["url"] for r in got} == {1: "http://a/1", 5: "http://a/5", 3: "http://b", 2: "http://c", 4: None, 8: "http://d%0D%0Ax", 9: "u"}
    again = write_warc(df.repartition(5), f"file://{tmp_path}/c", roll_bytes=100)
    key = lambda f: sorted((r["shard"], r["number"], r["file"], r["sha1"]) for r in f.collect())
    assert key(again) == key(files) and len({r["file"] for r in files.collect()}) == files.count()
    many = spark.range(3000).selectExpr("(id * 7919) % 3001 page_id", "concat('http://x/', id) url", "repeat(string(id), 1 + id % 50) html")
    one, two = (write_warc(many.repartition(n), f"file://{tmp_path}/m{n}") for n in (2, 7))
    assert key(one) == key(two) and one.count() == 8 and max(r["records"] for r in one.collect()) < 1000
    ids = [[x["page_id"] for x in read_warc(spark, f"file://{tmp_path}/m2").collect()]]
    assert sorted(ids[0]) == sorted(r["page_id"] for r in many.collect())
    write_warc(df.limit(0), f"file://{tmp_path}/d")
    assert read_warc(spark, f"file://{tmp_path}/d").count() == 0
