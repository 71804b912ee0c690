"""op7 on real licence files and headers, and its cosines against a plain computation."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowscore.llm import op7_license_scan as op
from flowscore.llm.licences import TEMPLATES

MIT = "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + TEMPLATES["MIT"][2].replace("\n", " ").replace(". ", ".\n")
CODE = "\n".join(f"def work{i}(a, b):\n    return a + b * {i}\n" for i in range(40))
APACHE = "\n".join("# " + x for x in TEMPLATES["Apache-2.0"][1].split("\n"))


def files():
    return [(1, "a/LICENSE", MIT), (2, "a/b/x.py", CODE), (3, "a/b/y.py", "# SPDX-License-Identifier: Apache-2.0\n" + CODE),
            (4, "c/z.py", "# Copyright Acme. Licensed under the Apache License, Version 2.0.\n" + CODE), (5, "c/w.py", CODE), (None, "a/b/v.py", None),
            (7, None, ""), (8, "d/e.c", f"/* some words before {' '.join(TEMPLATES['GPL-2.0'][0].split())} and after */\n" + CODE),
            (9, "d/f.py", APACHE + "\n" + CODE), (10, "e/COPYING", "\n\n".join(TEMPLATES["BSD-3-Clause"][1].split("\n"))), (10, "e/deep/g.py", CODE),
            (11, "f/README.md", "We talk about the license of things, and permission to copy, but grant none.\nSee the software notice."),
            (12, "g/h.py", "// SPDX-License-Identifier:\n" + CODE), (13, "g/i.py", "license " * 3000), (1, "a/LICENSE", MIT)]


def frame(spark, rows):
    return spark.createDataFrame([(i, p, t, "clash", "clash") for i, p, t in rows], "doc_id long, p string, text string, license string, tag string").repartition(3)


def test_licence_files_and_headers(spark):
    got = Counter((r.path, r.license, r.license_from, r.directory) for r in op.scan(frame(spark, files()), F.col("p")).collect())
    assert got == Counter([("a/LICENSE", "MIT", "header", None), ("a/LICENSE", "MIT", "header", None), ("a/b/x.py", "MIT", "directory", "a"),
                           ("a/b/y.py", "Apache-2.0", "header", None), ("c/z.py", "Apache-2.0", "header", None), ("c/w.py", None, None, None),
                           ("a/b/v.py", "MIT", "directory", "a"), (None, None, None, None), ("d/e.c", "GPL-2.0", "header", None),
                           ("d/f.py", "Apache-2.0", "header", None), ("e/COPYING", "BSD-3-Clause", "header", None),
                           ("e/deep/g.py", "BSD-3-Clause", "directory", "e"), ("f/README.md", None, None, None), ("g/h.py", None, None, None),
                           ("g/i.py", None, None, None)])


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_form_is_known_by_its_own_name(spark, name):
    rows = [(k, f"r/{k}.c", f"/* {CODE[:200]} */ x {' '.join(t.split())} y\n" + CODE) for k, t in enumerate(TEMPLATES[name])]
    assert {r.license for r in op.scan(frame(spark, rows), F.col("p")).collect()} == {name}


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_cosines_are_the_plain_ones(spark):
    rows = files()
    texts = [t or "" for *_, t in rows]
    forms = [words(t) for n in sorted(TEMPLATES) for t in TEMPLATES[n]]
    vocab = {w for f in forms for w in f}
    lines = [set(words(x)) for t in texts for x in t.split("\n") if words(x)]
    df = Counter(w for x in lines for w in x if w in vocab)
    idf = {w: math.log((1 + len(lines)) / (1 + df[w])) + 1 for w in vocab}
    other = math.log(1 + len(lines)) + 1

    def vector(ws):
        return {w: n * idf.get(w, other) for w, n in Counter(ws).items()}

    def cosine(a, b):
        return sum(v * b.get(w, 0) for w, v in a.items()) / max(1e-12, math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())))

    vectors = [vector(f) for f in forms]
    rare = [sorted({w for w in f if df[w]}, key=lambda w: df[w]) for f in forms]

    def best(text):
        units = [words(x) for x in text.split("\n")] + [words(x) for x in re.split(r"\n[ \t]*\n", text)] + [words(text)]
        ws = units[-1]
        for f, r in zip(forms, rare):
            edge = df[r[min(len(r), op.ANCHORS) - 1]] if r else -1
            for w in (w for w in r if df[w] <= edge):  # ties at the edge: any of them may be an anchor
                o = f.index(w)
                units += [ws[max(0, p - o): max(0, p - o + len(f))] for p, x in enumerate(ws) if x == w]
        return max((cosine(vector(u), v) for u in units if u for v in vectors), default=0.0)

    got = {(r.path, r.doc_id): r.cosine for r in op.scan(frame(spark, rows), F.col("p")).collect()}
    for (i, p, t) in rows:
        if p != "g/i.py":  # its windows are thousands of the same
            assert got[p, i] <= best(t or "") + 1e-8
            if got[p, i] < op.COSINE:
                continue
            assert got[p, i] == pytest.approx(best(t or ""), abs=1e-3)  # of cosines equal to three digits the longer template


def test_empty_table(spark):
    assert op.scan(frame(spark, []), F.col("p")).count() == 0
