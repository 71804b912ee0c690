"""Line dedup by winnowing over line hashes.

The units of a text are its ``\\n``-split lines that hold a word. A window is
``run_lines`` consecutive units, or one unit of at least ``long_line`` words.
Result: every unit that lies in a window whose content already occurs at an
earlier place (smaller doc_id, or the same document and an earlier line) is
deleted, i.e. the later copies of repeated runs go and the first copy stays.

How: each window selects its minimal line hash (the last one on ties), and only
the selected positions are kept, as fingerprints; equal windows select the same
line of theirs, so two copies of a run are certain to share fingerprints. A
position carries how its windows extend from it: how many lines to the left,
and a 128-bit hash of the neighbouring lines on both sides. Positions are
joined by fingerprint; those that share theirs with another position are
extended: a match is two positions of one fingerprint whose neighbours agree
both ways, and every position but the first of those that agree deletes the
lines it extends over. Every window of a longer run has a fingerprint, so the
matches of neighbouring positions add up to the maximal run.

A line that a third of all documents hold is one row per key and task in the
two aggregates (partial aggregation), and the joins probe a written table, so
both sides are plain exchanges that AQE splits. No pair of documents is made.

Defined results: a null or empty text stays as it is (no units, nothing
removed); lines without a word are never units and never removed; a document
with fewer units than ``run_lines`` only has its long lines as windows; very
long texts and lines are whole; rows are told apart by a key of id and text, so
rows that repeat an id with another text are documents of their own (in the
order of their keys), and rows with a null doc_id come after all others; equal
rows are one place and keep the same lines; extra columns stay, and those named
like a result column of ``line_dedup`` give way to it; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.llm.common import KEY, has_word, keyed, let, pick, words, written

RUN_LINES, LONG_LINE = 2, 50
COUNTS = ("n_lines", "n_removed", "n_runs")


def _units(text: Column) -> Column:
    """array<struct<h, g, n>>: two hashes and word count of each unit."""
    return F.transform(F.filter(F.split(text, "\n"), has_word), lambda x: F.struct(
        F.xxhash64(x).alias("h"), F.xxhash64(F.lit("second"), x).alias("g"), F.size(words(x)).alias("n")))


def _positions(u: Column, run: int, long_line: int) -> Column:
    """array<struct<at, fp, ways>> of the units that some window selects.

    ways: array<struct<l, k, h, g>>, one per window that selects the unit: it
    starts ``l`` units to the left, has ``k`` units, and (h, g) is the content
    of its other units.
    """
    n = F.size(u)

    def unit(p):
        return F.get(u, p)

    def ways(p):
        out = []
        for left in range(run):  # the window that starts ``left`` units before p
            around = [unit(p + d) for d in range(-left, run - left) if d]
            least = [x["h"] >= unit(p)["h"] for x in around[:left]] + [x["h"] > unit(p)["h"] for x in around[left:]]
            picked = (p >= left) & (p + (run - left) <= n)
            for c in least:
                picked = picked & c
            out.append(F.when(picked, _way(left, run, *([x[c] for x in around] for c in "hg"))))
        out.append(F.when(unit(p)["n"] >= long_line, _way(0, 1, [], [unit(p)["g"]])))
        return F.filter(F.array(*out), lambda w: w.isNotNull())

    found = F.transform(u, lambda x, p: F.struct(p.alias("at"), x["h"].alias("fp"), ways(p).alias("ways")))
    return F.filter(found, lambda s: F.size(s["ways"]) > 0)


def _way(left: int, size: int, h: list[Column], g: list[Column]) -> Column:
    return F.struct(F.lit(left).alias("l"), F.lit(size).alias("k"), F.xxhash64(F.lit("h"), *h).alias("h"), F.xxhash64(F.lit("g"), *g).alias("g"))


def positions(rows: DataFrame, run_lines: int, long_line: int) -> DataFrame:
    """One row per selected position of ``keyed`` rows: ``doc`` (orders the documents), at, fp, ways."""
    doc = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY).alias("doc")
    return pick(rows, "doc_id", "text", *KEY).filter("text is not null").select(
        doc, F.inline(let(_units(F.col("text")), lambda u: _positions(u, run_lines, long_line))))


def removed_units(rows: DataFrame, run_lines: int, long_line: int) -> DataFrame:
    """Per ``keyed`` row with something to delete: its key and ``gone`` (array of unit numbers)."""
    pos = written(positions(rows, run_lines, long_line), "line-positions")
    place = F.struct("doc", "at")
    prints = pos.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    shared = prints.filter("lo <> hi").select("fp")
    near = written(pos.join(shared, "fp").select("doc", "at", "fp", F.inline("ways")), "line-matches")
    same = ["fp", "l", "k", "h", "g"]  # one fingerprint, and neighbours that agree on both sides
    first = written(near.groupBy(*same).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select(
        *same, F.col("lo").alias("first")), "line-first")
    later = near.join(first, same).filter(place != F.col("first"))
    start = F.col("at") - F.col("l")
    return later.groupBy(*[F.col(f"doc.{c}").alias(c) for c in KEY]).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(
        F.sequence(start, start + F.col("k") - 1))))).alias("gone"))


def rewritten(docs: DataFrame, *, run_lines: int = RUN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """``docs`` with the text after deletion and a struct ``__lines`` of n_lines, n_removed, n_runs.

    n_lines counts the units, n_removed the deleted ones and n_runs the maximal
    deleted runs; all other columns of ``docs`` stay as they are.
    """
    rows = keyed(docs)
    gone = removed_units(rows, run_lines, long_line).withColumnRenamed("gone", "__gone")
    marked = rows.join(gone, [*KEY], "left")

    def rebuilt(lines):  # the line numbers of the units, those of the deleted units, then the lines of all others
        at = F.filter(F.transform(lines, lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull())
        return let(let(at, lambda at: F.transform(F.col("__gone"), lambda k: at[k])), lambda dead: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dead), lambda i: lines[i]), "\n"))

    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(let(F.split(F.col("text"), "\n"), rebuilt))
    units = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), has_word))
    runs = F.size(F.filter(F.col("__gone"), lambda k, j: (j == 0) | (F.col("__gone")[F.greatest(j - 1, F.lit(0))] != k - 1)))
    none = F.col("__gone").isNull()
    counts = (units, F.when(none, 0).otherwise(F.size("__gone")), F.when(none, 0).otherwise(runs))
    lines = F.struct(*[c.cast("long").alias(name) for name, c in zip(COUNTS, counts)])
    return marked.withColumns({"__lines": lines, "text": text}).drop("__gone", *KEY)


def line_dedup(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with the text after deletion and n_lines, n_removed, n_runs; parameters as in ``rewritten``."""
    out = rewritten(docs, **params)
    return out.withColumns({c: F.col(f"__lines.{c}") for c in COUNTS}).drop("__lines")


def query(spark, sf_dir: str) -> DataFrame:
    from flowscore.llm.common import table
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = f"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
units as (
  select doc_id, pos, x, row_number() over (partition by doc_id order by pos) - 1 as i,
    len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0B\\x0C\\r]+'), lambda w: w <> '')) as n
  from lines where regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]')),
win as (
  select doc_id, i, 2 as k, x || chr(10) || lead(x) over (partition by doc_id order by i) as c from units
  union all select doc_id, i, 1, x from units where n >= {LONG_LINE}),
ranked as (
  select doc_id, i, k, row_number() over (partition by k, c order by doc_id, i) as r from win where c is not null),
gone as (
  select distinct doc_id, i + j as i from (select doc_id, i, unnest(range(k)) as j from ranked where r > 1)),
runs as (
  select doc_id, count(*) as n_removed, sum(case when prev is null or prev <> i - 1 then 1 else 0 end) as n_runs
  from (select doc_id, i, lag(i) over (partition by doc_id order by i) as prev from gone) group by doc_id),
kept as (
  select l.doc_id, string_agg(l.x, chr(10) order by l.pos) as t
  from lines l left join units u on l.doc_id = u.doc_id and l.pos = u.pos left join gone g on g.doc_id = u.doc_id and g.i = u.i
  where g.i is null group by l.doc_id),
counts as (select doc_id, count(*) as n_lines from units group by doc_id)
select d.doc_id, coalesce(c.n_lines, 0)::bigint as n_lines, coalesce(r.n_removed, 0)::bigint as n_removed,
  coalesce(r.n_runs, 0)::bigint as n_runs,
  case when d.text is null then null else sha256(coalesce(k.t, '')) end as kept_sha256
from documents d left join counts c on c.doc_id = d.doc_id left join runs r on r.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""
