"""License scans: TF-IDF cosine to templates, then inheritance along the path.

The templates (``licences.py``) are full texts, notices and short statements,
several per licence. The vector space is spanned by their words (letters and
digits, lower-cased); a word outside them weighs as one that no line has.
Inverse frequencies are counted over the lines of all files. Compared with
every template, by the cosine of their sparse vectors, are a file's lines, its
blocks between blank ones, the whole file, and windows of a template's length:
wherever one of the ``ANCHORS`` rarest words of a template stands, the words
around it that the template would cover. So a text is found inside a longer
comment, behind a copyright line or among code. An SPDX tag names its licence
itself and goes before all others.

The best match is the file's header licence; ``cosine`` is 0 for a file in which
no part can reach the threshold. A file that is as a whole like a
template, or is named like a licence file and holds one, is the licence file of
its directory. A file without a licence of its own takes that of the nearest
directory above it (its own included) that has one, by an equi-join of its
ancestor directories.

Defined results: null and empty texts have no licence of their own and may
inherit; a null path has no directory; of equal cosines (to three digits) the
longer template wins, then the earlier name;
several licence files in a directory: the most similar, then the smallest
name; very long texts are compared whole (windows a million words at a time);
repeated rows, null and repeated ids are each judged by their own text and
path; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.llm import textnum as T
from flowscore.llm.common import written
from flowscore.llm.licences import TEMPLATES

COSINE = 0.85
ANCHORS = 3
WINDOW_WORDS = 1 << 20
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)"


def _words(col):
    buf, offs = T.text_buffer(col)
    buf = T.ascii_lower(buf)
    inside = (buf >= 0x80) | ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57))
    s, e, row = T.spans(buf, offs, inside)
    line = np.concatenate([[0], np.cumsum(buf == 10)])  # line breaks before each byte
    blank = _blanks(buf, offs)
    return T.span_hashes(buf, s, e), row, line[s], blank[s]


def _blanks(buf, offs):
    """Number of blank lines before each byte (a block ends at a blank line)."""
    ends = np.flatnonzero(buf == 10)
    full = np.concatenate([[0], np.cumsum(~T.is_space(buf))])
    starts = np.concatenate([[0], ends + 1])[: len(ends)]
    empty = full[ends] == full[starts] if len(ends) else np.zeros(0, bool)
    out = np.zeros(len(buf) + 1, np.int64)
    out[ends[empty] + 1] = 1
    return np.cumsum(out)


def _vocabulary(templates):
    """(name of each template, its words in order as places in the vocabulary, vocabulary, term counts)."""
    pairs = [(n, t) for n in sorted(templates) for t in ([templates[n]] if isinstance(templates[n], str) else templates[n])]
    h, row, _, _ = _words(pa.array([t for _, t in pairs]))
    vocab, at = np.unique(h, return_inverse=True)
    tf = np.zeros((len(pairs), len(vocab)))
    np.add.at(tf, (row, at), 1)
    return [n for n, _ in pairs], [at[row == i] for i in range(len(pairs))], vocab, tf


def _anchors(orders, df) -> dict[int, list[tuple[int, int]]]:
    """Word -> (its place in a template, length of that template), for the rarest words of each that occur at all."""
    out: dict[int, list] = {}
    for order in orders:
        first = {int(w): i for i, w in reversed(list(enumerate(order)))}
        for w in sorted((w for w in first if df[w]), key=lambda w: (df[w], first[w]))[:ANCHORS]:
            out.setdefault(w, []).append((first[w], len(order)))
    return out


def _windows(k, hit, row, anchors):
    """(first word, end) of the distinct windows around anchors, cut to their text."""
    at = np.flatnonzero(hit)
    at = at[np.isin(k[at], list(anchors))] if anchors else at[:0]
    spans = []
    for w, places in anchors.items():
        here = at[k[at] == w]
        for place, size in places:
            spans.append(np.stack([here - place, here - place + size, row[here]]))
    if not spans:
        return np.zeros((2, 0), np.int64)
    first, end, doc = np.concatenate(spans, axis=1)
    lo, hi = np.searchsorted(row, doc, "left"), np.searchsorted(row, doc, "right")
    return np.unique(np.stack([np.maximum(first, lo), np.minimum(end, hi)]), axis=1)


def _line_counts(vocab):
    """Per batch: in how many lines each template word stands, and how many lines have a word."""
    def run(batches):
        for b in T.slices(batches, "text"):
            h, row, line, _ = _words(b.column("text"))
            unit = _units(row, line)
            k = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            hit = vocab[k] == h
            pairs = np.unique(unit[hit] * len(vocab) + k[hit])
            df = np.bincount(pairs % len(vocab), minlength=len(vocab))
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], unit[-1] + 1 if len(unit) else 0).astype(np.int64))],
                                             names=["term", "n"])
    return run


def _units(row, part):
    if not len(row):
        return row
    return np.cumsum(np.append(0, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))


def cosines(h, unit, vocab, weights, other, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(units that may reach ``least``, their cosines with every template).

    A cosine is at most the share of the unit's vector that lies in the space
    of the templates' words (Cauchy and Schwarz), so other units are left out."""
    idf, vectors = weights
    n = int(unit[-1]) + 1 if len(unit) else 0
    k = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    hit = vocab[k] == h
    # term frequencies by unit: words inside and outside the templates
    order = np.lexsort((h, unit))
    u, w = unit[order], h[order]
    new = np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])) if len(u) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(u)))
    u, inside, term = u[first], hit[order][first], k[order][first]
    x = tf * np.where(inside, idf[term], other)
    norm = np.bincount(u, x * x, n)
    u, x, term = u[inside], x[inside], term[inside]
    may = np.bincount(u, x * x, n) >= (least * least - 1e-9) * norm
    may &= norm > 0
    place = np.cumsum(may) - 1
    u, x, term = place[u[may[u]]], x[may[u]], term[may[u]]
    n = int(may.sum())
    dots = np.stack([np.bincount(u, x * v[term], n) for v in vectors])
    return np.flatnonzero(may), dots / np.sqrt(norm[may])


def _matches(names, sizes, vocab, weights, other, least, anchors):
    prefer = np.array(sizes) * 1e-7 - np.arange(len(names)) * 1e-10

    def run(batches):
        for b in T.slices(batches, "text"):
            h, row, line, blank = _words(b.column("text"))
            best, score, which = np.zeros(b.num_rows), np.zeros(b.num_rows), np.full(b.num_rows, -1)
            whole_at = np.full(b.num_rows, -1)

            def judge(words, unit, doc):
                """Take the best template of every unit over to its file; returns the cosine and template of the unit that won."""
                may, c = cosines(words, unit, vocab, weights, other, least)
                doc = doc[may]
                rank = np.round(c, 3) + prefer[:, None]  # equally alike: the longer template, then the earlier name
                at = rank.argmax(0)
                top, cos = rank.max(0), c[at, np.arange(c.shape[1])]
                order = np.argsort(top, kind="stable")  # the best comes last
                win, won, won_at = np.zeros(b.num_rows), np.zeros(b.num_rows), np.full(b.num_rows, -1)
                win[doc[order]], won[doc[order]], won_at[doc[order]] = top[order], cos[order], at[order]
                better = win > score
                best[better], score[better], which[better] = won[better], win[better], won_at[better]
                return won, won_at

            for part in (line, blank, np.zeros(len(row), np.int64)):
                unit = _units(row, part)
                if len(unit):
                    win, at = judge(h, unit, row[np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))])
                    whole_at = np.where(win >= least, at, -1)  # of the last part, the whole file
            k = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            first, end = _windows(k, vocab[k] == h if len(h) else np.zeros(0, bool), row, anchors)
            total = np.append(0, np.cumsum(end - first))
            lo = 0
            while lo < len(first):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + WINDOW_WORDS, "right")) - 1)
                size = (end - first)[lo:hi]
                unit = np.repeat(np.arange(hi - lo), size)
                place = first[lo:hi][unit] + np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
                judge(h[place], unit, row[first[lo:hi]])
                lo = hi
            own = [names[w] if s >= least else None for w, s in zip(which, best)]
            file = [names[w] if w >= 0 else None for w in whole_at]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), pa.array(own, pa.string()), pa.array(best),
                                              pa.array(file, pa.string()), b.column("tag")], names=["doc_id", "path", "own", "cosine", "whole", "tag"])
    return run


def scan(docs: DataFrame, path: Column, templates: dict | None = None, *, cosine: float = COSINE) -> DataFrame:
    """doc_id, path, license, cosine, license_from ("header", "directory" or null), directory.

    ``templates``: name -> text or texts."""
    spark = docs.sparkSession
    names, orders, vocab, tf = _vocabulary(templates or TEMPLATES)
    tag = F.when(F.contains("text", F.lit("SPDX-License-Identifier:")), F.nullif(F.regexp_extract("text", SPDX, 1), F.lit("")))
    base = docs.select("doc_id", "text", path.alias("path"), tag.alias("tag"))
    kind = base.schema["doc_id"].dataType.simpleString()
    # at most one number per template word comes back
    counts = {r["term"]: r["n"] for r in base.select("text").mapInArrow(_line_counts(vocab), "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()}
    lines = counts.get(-1, 0)
    df = np.array([counts.get(i, 0) for i in range(len(vocab))])
    idf = np.log((1 + lines) / (1 + df)) + 1
    vectors = tf * idf
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    found = base.mapInArrow(_matches(names, [len(o) for o in orders], vocab, (idf, vectors), float(np.log(1 + lines) + 1), cosine, _anchors(orders, df)),
                            f"doc_id {kind}, path string, own string, cosine double, whole string, tag string")
    found = written(found.withColumn("own", F.coalesce("tag", "own")).drop("tag"), "license-own")
    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.col("whole").isNotNull() | (F.col("own").isNotNull() & name.rlike(LICENSE_FILE))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), ""))
    files = written(found.filter(is_file).select(folder.alias("dir"), F.struct((-F.col("cosine")).alias("c"), F.coalesce("whole", "own").alias("name")).alias("x"))
                    .filter("dir is not null").groupBy("dir").agg(F.min("x")["name"].alias("license")), "license-dirs")
    bare = found.filter("own is null and path is not null").select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    near = written(bare.select("folder", F.inline(above)).join(files, "dir").groupBy("folder").agg(
        F.max(F.struct("depth", "dir", "license")).alias("n")), "license-near")
    out = found.withColumn("folder", F.when(F.col("own").isNull(), folder)).join(near, "folder", "left")
    return out.select("doc_id", "path", F.coalesce("own", "n.license").alias("license"), F.round("cosine", 9).alias("cosine"),
                      F.when(F.col("own").isNotNull(), "header").when(F.col("n").isNotNull(), "directory").alias("license_from"),
                      F.when(F.col("own").isNull(), F.col("n.dir")).alias("directory"))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    from flowscore.llm.common import table
    return scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
