"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target number of words. The mix takes every document ``floor(target / size of
the source)`` times and, for the rest of the target, the documents whose hash lies below the
source's threshold once more. The threshold is found without sorting documents: words are summed
by source and hash bucket, the bucket in which the sum passes the budget is found, and only that
bucket is summed again by the next bits of the hash, until it holds one document or no bits are
left. The document at the threshold is taken if that brings the source nearer its target.

Everything is DataFrame expressions. Null texts have size 0; null sources are a source of their
own, the last; rows with equal ids and sizes are told apart by their place in the table, so a
repeated row can be taken more often than its copy (that place is read once and written); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import keep_rows, n_words, pick, read, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: No document is taken more often than this.
MOST = 3
#: Sources up to which their plan is broadcast; beyond, the join shuffles, and no source can hold many of the rows.
FEW = 100_000
#: Bits of the hash used at each refinement, and refinements: 48 bits of the row's values, then 24 of its place.
BITS, LEVELS = 12, 6


def targets(sizes: DataFrame) -> DataFrame:
    """src, source_size -> with weight and target. Shares are proportional to weight; a source
    above ``MOST`` times its size stops there and the others share the excess by weight until none
    is above. That is one level L with sum(min(MOST * size, L * weight)) = total, found from
    running sums over the sources, which are few."""
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("ratio", MOST * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    all_rows, earlier = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - MOST * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )
    # the first source in order that the level leaves below its limit: all before it stop at theirs
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(all_rows)
    out = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order)).withColumn("level", first["level"])
    return out.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))).select("src", "source_size", "weight", "target")


def _bucket(level: int):
    per = 48 // BITS
    key, at = ("u", 48 - BITS * (level + 1)) if level < per else ("v", 24 - BITS * (level - per + 1))
    return F.shiftright(F.col(key), at).bitwiseAND(F.lit((1 << BITS) - 1)).cast("long")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """src, and (tu, tv): rows with (u, v) below it are taken. ``rows``: src, size, u, v."""
    state = written(budgets.select("src", "budget", F.lit(0).cast("long").alias("tu"), F.lit(0).cast("long").alias("tv"), F.lit(True).alias("open")), "mix-state")
    sized = rows.where("size > 0")
    for level in range(LEVELS):
        first = level < 48 // BITS
        at = 48 - BITS * (level + 1) if first else 24 - BITS * (level - 48 // BITS + 1)
        live = state.where("open").select(F.col("src").alias("s"), "budget", "tu", "tv")
        inside = F.col("src").eqNullSafe(F.col("s"))
        if level:
            inside &= F.shiftright("u", at + BITS if first else 0) == F.shiftright("tu", at + BITS if first else 0)
            if not first:
                inside &= F.shiftright("v", at + BITS) == F.shiftright("tv", at + BITS)
        histogram = sized.join(live, inside).groupBy("s", "budget", "tu", "tv", _bucket(level).alias("b")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = histogram.withColumn("sum", F.sum("words").over(upto))
        edge = summed.where("sum > budget").groupBy("s", "budget", "tu", "tv").agg(F.min(F.struct("b", "sum", "words", "n")).alias("e"))
        one = (F.col("e.n") == 1) | F.lit(level == LEVELS - 1)
        left = F.col("budget") - (F.col("e.sum") - F.col("e.words"))
        step = F.shiftleft(F.col("e.b") + F.when(one & (2 * left > F.col("e.words")), 1).otherwise(0), at)
        tu, tv = (F.col("tu") + step, F.col("tv")) if first else (F.col("tu"), F.col("tv") + step)
        found = edge.select(F.col("s").alias("src"), left.alias("budget"), tu.alias("tu"), tv.alias("tv"), (~one).alias("open"))
        passed = state.where("open").join(found.select(F.col("src").alias("s")), F.col("src").eqNullSafe(F.col("s")), "left_anti")
        # a source whose rows in the bucket all fit takes the whole bucket
        whole = passed.select("src", "budget", (F.col("tu") + F.lit(1 << (at + BITS) if first else 0)).alias("tu"), (F.col("tv") + F.lit(0 if first else 1 << (at + BITS))).alias("tv"), F.lit(False).alias("open"))
        state = written(state.where("NOT open").unionByName(found).unionByName(whole), "mix-state")
        if not state.where("open").head(1):
            break
    return state.select("src", "tu", "tv")


def _plan(rows: DataFrame) -> DataFrame:
    """For each source of ``rows`` (src, size, u, v), as s: source_size, target, the copies taken of
    every document (rate) and the threshold below which one more is."""
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("long")
    plan = written(targets(sizes).withColumn("rate", rate).withColumn("budget", F.col("target") - F.col("rate") * F.col("source_size")), "mix-plan")
    cuts = thresholds(rows, plan.where(F.col("rate") < MOST))
    return plan.join(cuts.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")), "left").select(F.col("src").alias("s"), "source_size", "target", "rate", "tu", "tv")


def _keyed(df: DataFrame, doc_id, source, text) -> DataFrame:
    """``df`` with src, size and the hash: u of the row's values, v of its place in the table."""
    out = df.withColumn("src", source).withColumn("size", n_words(text))
    named = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.col("size").cast("string"))
    out = out.withColumn("u", F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("long"))
    return out.withColumn("v", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 40))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``times``, the number of copies that the mix takes. A plan of ``FEW`` sources or
    fewer is sent to the tasks, so a source with a third of all rows fills no task."""
    plan = written(plan, "mix-cuts")
    if plan.count() <= FEW:
        plan = F.broadcast(plan)
    more = (F.col("u") < F.col("tu")) | ((F.col("u") == F.col("tu")) & (F.col("v") < F.col("tv")))
    times = F.least(F.col("rate") + F.when(more, 1).otherwise(0), F.lit(MOST)).cast("int")
    return rows.join(plan, F.col("src").eqNullSafe(F.col("s"))).withColumn("times", times)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``."""
    slim = _keyed(pick(docs, "doc_id", "text", "source"), F.col("doc_id"), F.col("source"), F.col("text"))
    slim = written(slim.select("doc_id", "src", "size", "u", "v"), "mix")
    return _taken(slim, _plan(slim)).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""

    def decide(plain: DataFrame, old) -> DataFrame:
        # the place in the table is taken once and written, as another scan may split the table differently
        keyed = written(_keyed(plain, old("doc_id"), old("source"), old("text")), "mix")
        taken = _taken(keyed, _plan(keyed.select("src", "size", "u", "v"))).where("times > 0")
        return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))

    return keep_rows(docs, decide)


def op4(spark, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"))


#: The same in DuckDB's SQL; documents are sorted by hash there, which gives the same threshold.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))), 1, 12) AS BIGINT) AS u FROM d),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM h GROUP BY src),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM s),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, src NULLS LAST) AS place, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER e, 0) AS DOUBLE)
               / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level
      FROM r WINDOW e AS (ORDER BY ratio, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM l WHERE level <= ratio ORDER BY place LIMIT 1) * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS rate FROM t),
c AS (SELECT h.doc_id, h.size, p.source_size, p.target, p.rate, p.target - p.rate * p.source_size AS budget,
             sum(h.size) OVER (PARTITION BY h.src ORDER BY h.u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM h JOIN p ON h.src IS NOT DISTINCT FROM p.src)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, rate + CASE WHEN rate < 3 AND (upto <= budget OR (upto - size <= budget AND 2 * (budget - (upto - size)) > size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
