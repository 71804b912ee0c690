"""Temperature mixing of sources to target weights.

Each source's share p of all words becomes the weight p**a / sum(p**a). The
exponent a in [0, 1] is bisected: the largest one whose weights reach the
target entropy (a share of the largest possible, ln(number of sources)), then
raised if that is needed to keep every source within ``max_repeat`` passes
over its own words. Totals per source stay in Spark; one bisection step
evaluates 15 inner points in one aggregate.

The weights are realised as budgeted block permutations: the rows of a source
fall into ``blocks`` hash blocks; every pass over the source visits the blocks
in a new order (a hash of block and pass), whole passes first, and the last
pass takes blocks in its order until the source's word budget is met, cutting
the block on the boundary row by row in hash order. The cut block's rows are
summed by the leading ``DIGITS`` hex digits of that order first, and only the
part on the boundary is put in order row by row: 1 of 16**DIGITS x ``blocks``
parts of a source. Sizes are summed before any window, so a window holds at
most ``blocks`` or 16**DIGITS rows, or the rows of that part.

The rows themselves go through: a row joins the plan by source and block, never
by its id, so each drawn copy is the row it was.

Defined results: rows with a null or empty text count 0 words and are drawn
with their block; very long texts are counted whole; a null source is a source
of its own; a source without any word has weight 0 and is not drawn; a null
doc_id is replaced by a hash of the text in all orders, rows that repeat an id
share a block, and equal rows are drawn as often as they stand there (on the
boundary in any order, they are alike); an empty table gives an empty mix;
extra columns are ignored by ``mix_sources`` and kept by ``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscore.llm.common import pick, written

ENTROPY_SHARE, MAX_REPEAT, BLOCKS, SEED = 0.95, 4.0, 256, 7
STEPS, INNER = 8, 15
DIGITS = 4


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _id(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}doc_id").cast("string"), F.md5(F.coalesce(F.col(f"{prefix}text"), F.lit("")).cast("binary")))


def _words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _block(row_id: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.conv(F.substring(_hash(seed, row_id), 1, 7), 16, 10).cast("long"), F.lit(blocks))


def exponent(totals: DataFrame, entropy_share: float, max_repeat: float, budget: int | None) -> tuple[float, float, int, int]:
    """(a, sum of p**a, all words, budget) for per-source ``totals`` (source, words > 0)."""
    base = totals.agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"), F.min("words").alias("least")).first()
    if not base["n"]:
        return 1.0, 1.0, 0, 0
    all_words, least = int(base["w"]), base["least"] / base["w"]
    budget = all_words if budget is None else int(budget)
    if budget > max_repeat * all_words:
        raise ValueError("the budget exceeds max_repeat passes over all words")
    p = F.col("words") / F.lit(float(all_words))

    def at(points):
        got = totals.agg(*[F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(points)],
                         *[F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}") for i, a in enumerate(points)]).first()
        return [(got[f"z{i}"], got[f"l{i}"]) for i in range(len(points))]

    def entropy_met(a, z, lp):
        return _ln(z) - a * lp / z >= entropy_share * _ln(base["n"]) - 1e-12

    def repeat_met(a, z, lp):
        return least ** (a - 1) / z * budget / all_words <= max_repeat + 1e-12

    def bisect(met, rising):
        """Edge of the region where ``met`` holds: its top when it holds for small a, else its foot."""
        lo, hi = 0.0, 1.0
        (z0, l0), (z1, l1) = at([0.0, 1.0])
        if met(1.0, z1, l1) and not rising:
            return 1.0
        if met(0.0, z0, l0) and rising:
            return 0.0
        if not rising and not met(0.0, z0, l0):
            return 0.0
        for _ in range(STEPS):
            points = [lo + (hi - lo) * (i + 1) / (INNER + 1) for i in range(INNER)]
            held = [met(a, *zl) for a, zl in zip(points, at(points))]
            first = next((i for i, x in enumerate(held) if x == rising), INNER)
            edges = [lo, *points, hi]
            lo, hi = edges[first], edges[first + 1]
        return hi if rising else lo

    a = max(bisect(entropy_met, False), bisect(repeat_met, True))
    a = round(a, 9)
    return a, at([a])[0][0], all_words, budget


def _ln(x: float) -> float:
    import math
    return math.log(x)


def planned(per_block: DataFrame, *, entropy_share: float = ENTROPY_SHARE, max_repeat: float = MAX_REPEAT, seed: int = SEED,
            budget: int | None = None) -> DataFrame:
    """The blocks to draw, from their sizes (source, block, words), written.

    Columns: s, b (source and block), copy, source_budget, rest (words of the
    last pass), inside (words of the pass before this block), words_before
    (words of the source's schedule before it), cut (whether only its first
    rows are drawn).
    """
    per_block = written(per_block, "mix-blocks")
    totals = written(per_block.groupBy("source").agg(F.sum("words").alias("words")).filter("words > 0"), "mix-sources")
    a, z, all_words, budget = exponent(totals, entropy_share, max_repeat, budget)
    share = F.col("words") / F.lit(float(max(1, all_words)))
    goal = totals.select(F.col("source").alias("s"), F.col("words").alias("source_words"),
                         F.round(F.pow(share, F.lit(a)) / F.lit(z) * F.lit(budget)).cast("long").alias("source_budget"))
    goal = goal.withColumn("passes", F.expr("source_budget div source_words")).withColumn(
        "rest", F.expr("source_budget - passes * source_words"))
    plan = per_block.join(goal, per_block["source"].eqNullSafe(F.col("s"))).select(
        "source", "block", "words", "source_words", "source_budget", "passes", "rest",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("copy"))
    order = Window.partitionBy("source", "copy").orderBy(_hash(seed, F.col("source"), F.col("block"), F.col("copy")), "block")
    plan = plan.withColumn("inside", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = plan.filter("copy < passes or inside < rest").select(
        F.col("source").alias("s"), F.col("block").alias("b"), "copy", "source_budget", "rest", "inside",
        (F.col("copy") * F.col("source_words") + F.col("inside")).alias("words_before"),
        ((F.col("copy") == F.col("passes")) & (F.col("inside") + F.col("words") > F.col("rest"))).alias("cut"))
    return written(plan, "mix-plan")


def mixed_rows(docs: DataFrame, *, blocks: int = BLOCKS, seed: int = SEED, digits: int = DIGITS, **params) -> DataFrame:
    """Every drawn copy of a row of ``docs``, with a struct ``__mix`` of copy, block, words_before, source_budget.

    ``copy`` counts passes over the source from 0; ``words_before`` is the
    number of words of the source's schedule before the row's block, so
    ``words_before / source_budget`` orders the blocks of all sources evenly.
    """
    rows = docs.select(F.struct("*").alias("__row")).withColumn("__source", F.col("__row.source")).withColumn(
        "__block", _block(_id("__row."), blocks, seed))
    sizes = rows.groupBy(F.col("__source").alias("source"), F.col("__block").alias("block")).agg(F.sum(_words(F.col("__row.text"))).alias("words"))
    plan = planned(sizes, seed=seed, **params)
    on = F.col("__source").eqNullSafe(F.col("s")) & (F.col("__block") == F.col("b"))
    out = [F.col("__row.*"), F.struct("copy", F.col("__block").alias("block"), "words_before", "source_budget").alias("__mix")]
    whole = rows.join(plan.filter("not cut"), on).select(*out)

    # the rows of cut blocks, in hash order; ``part`` are the leading digits of that order
    cut = rows.join(plan.filter("cut"), on).withColumn("__order", _hash(seed, F.col("copy"), _id("__row.")))
    cut = cut.withColumn("__part", F.substring("__order", 1, digits))
    part_of = ["s", "b", "copy", "__part"]
    upto = Window.partitionBy("s", "b", "copy").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*part_of, "rest", "inside").agg(F.sum(_words(F.col("__row.text"))).alias("words")).withColumn(
        "before", F.col("inside") + F.coalesce(F.sum("words").over(upto), F.lit(0))).filter("before < rest")
    parts = written(parts.select(*[F.col(c).alias(f"p_{c}") for c in part_of], "before", (F.col("before") + F.col("words") > F.col("rest")).alias("edge")),
                    "mix-parts")
    here = F.col("s").eqNullSafe(F.col("p_s")) & (F.col("b") == F.col("p_b")) & (F.col("copy") == F.col("p_copy")) & (F.col("__part") == F.col("p___part"))
    inner = cut.join(parts.filter("not edge"), here).select(*out)
    n = _words(F.col("__row.text"))
    row = Window.partitionBy(*part_of).orderBy("__order", _id("__row."), n).rowsBetween(Window.unboundedPreceding, -1)
    edge = cut.join(parts.filter("edge"), here).withColumn("__sofar", F.coalesce(F.sum(n).over(row), F.lit(0)))
    return whole.unionByName(inner).unionByName(edge.filter("before + __sofar < rest").select(*out))


def mix_sources(docs: DataFrame, **params) -> DataFrame:
    """doc_id, source, copy, block, words_before, source_budget of every drawn copy; parameters as in ``mixed_rows`` and ``planned``."""
    return mixed_rows(pick(docs, "doc_id", "source", "text"), **params).select("doc_id", "source", "__mix.*")


def query(spark, sf_dir: str) -> DataFrame:
    from flowscore.llm.common import table
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = f"""
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\x0C\\r]+'))::bigint as n_words,
    (('0x' || substr(md5('{SEED}|' || doc_id), 1, 7))::bigint % {BLOCKS}) as block from documents),
blocks as (select source, block, sum(n_words)::bigint as words from docs group by all),
totals as (select source, sum(words)::bigint as words from blocks group by source having sum(words) > 0),
shares as (select source, words, words / (select sum(words) from totals)::double as p from totals),
search as (
  select 0 as step, 0.0::double as lo, 1.0::double as hi
  union all
  select step + 1, case when ok then (lo + hi) / 2 else lo end, case when ok then hi else (lo + hi) / 2 end
  from (select step, lo, hi, (select ln(sum(p ** ((lo + hi) / 2))) - (lo + hi) / 2 * sum(p ** ((lo + hi) / 2) * ln(p)) / sum(p ** ((lo + hi) / 2))
        from shares) >= {ENTROPY_SHARE} * ln((select count(*) from shares)) as ok from search where step < 50)),
chosen as (
  select round(case when (select -sum(p * ln(p)) from shares) >= {ENTROPY_SHARE} * ln((select count(*) from shares)) then 1 else max(lo) end, 9) as a
  from search where step = 50),
goal as (
  select source as s, words as source_words, source_budget, (source_budget // words)::bigint as passes, source_budget % words as rest
  from (select source, words, round(p ** a / (select sum(p ** a) from shares) * (select sum(words) from totals))::bigint as source_budget
        from shares, chosen)),
plan as (
  select source, block, words, source_words, source_budget, passes, rest, unnest(range(passes + 1)) as copy
  from blocks join goal on source is not distinct from s),
ordered as (
  select *, coalesce(sum(words) over (partition by source, copy order by md5('{SEED}|' || coalesce(source, '-') || '|' || block || '|' || copy), block
    rows between unbounded preceding and 1 preceding), 0)::bigint as inside from plan),
taken as (select * from ordered where copy < passes or inside < rest),
drawn as (
  select d.doc_id, d.source, t.copy::bigint as copy, d.block, (t.copy * t.source_words + t.inside)::bigint as words_before, t.source_budget,
    t.passes, t.rest, t.inside, coalesce(sum(d.n_words) over (partition by d.source, d.block, t.copy
      order by md5('{SEED}|' || t.copy || '|' || d.doc_id), d.doc_id, d.n_words rows between unbounded preceding and 1 preceding), 0) as sofar
  from docs d join taken t on d.source is not distinct from t.source and d.block = t.block)
select doc_id, source, copy, block, words_before, source_budget from drawn where copy < passes or inside + sofar < rest
"""
