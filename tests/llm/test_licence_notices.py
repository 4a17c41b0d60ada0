"""Licence scans against a scan by hand: every place against every place of every template."""

import os
import random
from collections import Counter

import pytest

from tessera.llm.licence_notices import TEMPLATES, read_templates
from tessera.llm.license_automaton import COVER, GAP, PHRASES, RUN, LicenceScan, scan_licences
from tessera.llm.queries import op10_licences

WORD_SIGNS = "0123456789abcdefghijklmnopqrstuvwxyz"


def cut(text):
    out, held = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in WORD_SIGNS or ord(c) > 127:
            held += c
        elif held:
            out.append(held)
            held = ""
    return out


def brute(text, templates=TEMPLATES):
    w = cut(text)
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        p = cut(phrase)
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    spans = []
    for label, texts in templates.items():
        for t in texts:
            t = cut(t)
            place = {}
            for j, x in enumerate(t):
                place.setdefault(x, []).append(j)
            longest, first = [0] * (len(w) + 1), {}
            ends = [0] * len(t)  # lengths of the runs that end at each place of t, for the last word
            for i, x in enumerate(w):
                now = [0] * len(t)
                for j in place.get(x, ()):
                    now[j] = 1 + (ends[j - 1] if j else 0)
                    if now[j] > longest[i]:
                        longest[i], first[i] = now[j], j
                ends = now
            runs = sorted((i + 1 - longest[i], longest[i], first[i] + 1 - longest[i]) for i in range(len(w)) if longest[i] >= RUN and longest[i + 1] != longest[i] + 1)
            chains = []
            for at, size, there in runs:
                for c in chains:
                    new = min(size, at + size - c[1], there + size - c[2])
                    if at <= c[1] + GAP and there + size > c[2] and there >= c[2] - GAP and new > 0:
                        c[1:] = [at + size, there + size, c[3] + new]
                        break
                else:
                    chains.append([at, at + size, there + size, size])
            spans += [(label, c[0], c[1] - 1, c[3] / max(len(t), c[1] - c[0])) for c in chains if c[3] >= COVER * len(t)]
    best = set()
    for s in spans:
        if not any(2 * (min(o[2], s[2]) - max(o[1], s[1]) + 1) > min(o[2] - o[1], s[2] - s[1]) + 1 and (o[3], o[2] - o[1]) > (s[3], s[2] - s[1]) for o in spans):
            best.add(s)
    score = 1.0 if base else max((s[3] for s in best), default=0.0)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in best})), min(1.0, score), sorted(best, key=lambda s: (s[1], s[0], s[2]))


def texts():
    rng = random.Random(12)
    notices = [t for texts in TEMPLATES.values() for t in texts]
    out = [None, "", "Under the MIT License, under the mit license", "a cc by-nc b", *notices]
    for _ in range(60):
        w = rng.choice(notices).split()
        for _ in range(rng.randrange(8)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(4)] = [rng.choice(["changed", "the", "of", "license", "3.0"])] * rng.randrange(3)
        more = " ".join(rng.choice(rng.choice(notices).split()) for _ in range(rng.randrange(60)))
        out.append(f"{more} {' '.join(w)} {more} {rng.choice(notices) if rng.random() < 0.3 else ''}")
    return out


def test_scan_against_brute_force(spark):
    rows = [*enumerate(texts()), (3, "x y"), (3, "x y"), (None, "under the mit license")]
    got = scan_licences(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)).collect()
    plain = lambda r: (r["doc_id"], *tuple(r)[1:7], pytest.approx(r["score"]), [(s["label"], s["first_word"], s["last_word"]) for s in r["spans"]])
    want = [(i, *(b := brute(t))[:7], [s[:3] for s in b[7]]) for i, t in rows]
    assert sorted(map(repr, [(r[0], *r[1:7], r[8]) for r in map(plain, got)])) == sorted(repr((w[0], *w[1:7], w[8])) for w in want)
    assert Counter(round(r["score"], 9) for r in got) == Counter(round(w[7], 9) for w in want)


def test_query_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op10_licences(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:7] == brute(docs[r["doc_id"]])[:6]


def test_each_notice_names_its_licence():
    scan = LicenceScan().scan
    for label, notices in TEMPLATES.items():
        for t in notices:
            assert label in scan(t)[5].split(",")
    assert scan(TEMPLATES["gpl-3"][0])[5] == "gpl-3" and scan(TEMPLATES["cc-by-nc-sa"][0])[5] == "cc-by-nc-sa" and scan(TEMPLATES["bsd-3"][0])[5] == "bsd-3"
    assert scan(TEMPLATES["cc-by-nd"][0].replace("International", "Intl"))[5] == "cc-by-nd"


def test_whole_texts_from_files(tmp_path):
    rng = random.Random(2)
    whole = " ".join(f"term{rng.randrange(900)}" for _ in range(3000))
    (tmp_path / "x").write_text(whole)
    scan = LicenceScan(templates=read_templates({"own-1": str(tmp_path / "x")})).scan
    assert scan(f"before {whole} after")[5] == "own-1" and scan(" ".join(whole.split()[:2000]))[5] == ""
    if os.path.exists(gpl := "/usr/share/common-licenses/GPL-3"):
        scan = LicenceScan(templates=read_templates({"gpl-3-text": gpl})).scan
        assert "gpl-3-text" in scan(open(gpl).read())[5]


def test_statements_in_an_authors_own_words():
    scan = LicenceScan(PHRASES, TEMPLATES).scan
    for text, label in {
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2", "Licensed under the GNU GPL version 2 only": "gpl-2", "It is licensed under the GNU GPL, version 3 or later.": "gpl-3", "Released under the terms of the GNU Lesser General Public License version 2.1": "lgpl-2.1",
        "distributed under the terms of the GNU AGPL version 3": "agpl-3", "licensed under the GNU Affero General Public License version 3 or later": "agpl-3",
    }.items():
        assert scan(f"some words before. {text} and some words behind")[5] == label, text
    assert all(scan(t)[5] == "" for t in ("licensed under a song", "the terms of the agreement", "released under the terms of the contract version 2"))
