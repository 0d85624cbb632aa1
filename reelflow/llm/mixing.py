"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share by weight of ``factor`` times all words, at most ``cap`` times its
own words, the excess being shared again by weight. Whole epochs are taken first; the rest comes
from the documents with the smallest keys -ln(u) / quality, u being uniform from a hash of the id.

No source is sorted in one task: keys fall into ranges of about ``PER_BUCKET`` documents, sums per source and
range are combined before the shuffle, their prefix sums find the range in which the budget ends, and only
that range is sorted. The result is a cut (key and tie-breakers) per source; the verdict on each
document is then a row-wise comparison. The document at the cut gives the words still missing.

Nulls and ties: a null text has size 0; a null source is the last source; a null id hashes as the
empty string. Equal keys are ordered by id, size and hash of the text; rows that agree in all of
these share what is left equally, rounded down. Same rows, same result, in any order or partitioning.
An empty table gives an empty result; a text of any length is one row; columns of the caller are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.llm.common import SPACE_WORD, fresh, null_safe, small, stage

WEIGHTS = (5, 2, 1)
#: Words wanted, as a multiple of all words: numerator and denominator.
FACTOR = (3, 2)
CAP = 2
SEED = "mix-1"
#: Documents of a range of keys, about, and ranges at least and at most. They change no result.
PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 12, 1 << 22
#: Sources whose plan is broadcast; beyond it the join is left to Spark.
FEW_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, size: Column, symbols: Column, seed: str = SEED) -> Column:
    """-ln(u) / quality, with quality = size / (size + symbols): prose near 1, junk far below."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return F.when(size > 0, -F.log(u) * (size + symbols) / size).otherwise(F.lit(0.0))


def measured(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` plus ``mix``: struct<source, size, doc, tie, key>. Narrow; reads each text once."""
    size, symbols = size_of(F.col("text")), F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")
    df = docs.withColumn("mix", F.struct(F.col("source").alias("source"), size.alias("size"), symbols.alias("symbols"), F.col("doc_id").cast("string").alias("doc"), F.xxhash64("text").alias("tie")))
    m = F.col("mix")
    return df.withColumn("mix", m.withField("key", sampling_key(m["doc"], m["size"], m["symbols"], seed)).dropFields("symbols"))


def in_buckets(keys: DataFrame) -> DataFrame:
    """``keys`` (the fields of ``mix``) with ``bucket``, the range of each key."""
    n = min(MOST_BUCKETS, max(LEAST_BUCKETS, keys.count() // PER_BUCKET))
    return keys.withColumn("bucket", F.least(F.lit(n - 1), F.floor(n * (1 - F.exp(-F.col("key"))))).cast("int"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: tuple[int, int] = FACTOR, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling under the caps, in one division.

    Sources are few (a row each). With sources in order of cap / weight, those that are capped come first.
    """
    if factor[0] > cap * factor[1]:
        raise ValueError("the factor exceeds the cap: the targets cannot be met")
    num, den = factor
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    one = totals.withColumn("w", w.cast("long"))
    every = Window.partitionBy()
    rising = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    one = one.select("*", F.sum("source_size").over(every).alias("all"), F.sum("w").over(every).alias("w_all"), F.coalesce(F.sum("source_size").over(rising), F.lit(0)).alias("s_before"), F.coalesce(F.sum("w").over(rising), F.lit(0)).alias("w_before"))
    rest, width = num * F.col("all") - den * cap * F.col("s_before"), F.col("w_all") - F.col("w_before")
    one = one.withColumn("capped", den * cap * F.col("source_size") * width <= rest * F.col("w"))
    full, heavy = (F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(every), F.lit(0)) for c in ("source_size", "w"))
    one = one.withColumn("s_full", full).withColumn("w_full", heavy)
    share = ((num * F.col("all") - den * cap * F.col("s_full")) * F.col("w")).cast("double") / (den * (F.col("w_all") - F.col("w_full"))).cast("double")
    return one.select("source", "source_size", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def plan(keys: DataFrame, **how) -> DataFrame:
    """A row per source: source, source_size, target, epochs, cut (null: no more than the epochs), part.

    ``keys`` has the fields of ``mix`` as columns. Documents before ``cut`` are taken once more, those at it
    give ``part`` words.
    """
    sums = stage(keys.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), **how)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = stage(goal.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "goal")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    ends = null_safe(sums.withColumn("upto", upto), small(goal.select("source", "rest"), FEW_SOURCES), ["source"], "inner")
    ends = ends.where("rest > 0 and upto > rest and upto - words <= rest").select("source", "bucket", "rest", (F.col("upto") - F.col("words")).alias("base"))
    ends = stage(ends, "ends")
    rows = null_safe(keys, small(ends, FEW_SOURCES), ["source", "bucket"], "inner")
    units = rows.groupBy("source", "base", "rest", F.struct("key", "doc", "size", "tie").alias("cut")).agg(F.count("*").alias("copies"))
    last = F.sum(F.col("copies") * F.col("cut.size")).over(Window.partitionBy("source").orderBy("cut"))
    units = units.withColumn("upto", F.col("base") + last).withColumn("before", F.col("upto") - F.col("copies") * F.col("cut.size"))
    cuts = units.where("upto > rest and before <= rest").select("source", "cut", F.floor((F.col("rest") - F.col("before")) / F.col("copies")).cast("long").alias("part"))
    return stage(null_safe(goal.drop("rest"), cuts, ["source"]), "plan")


def taken(mix: Column, epochs: Column, cut: Column, part: Column) -> Column:
    mine = F.struct(mix["key"].alias("key"), mix["doc"].alias("doc"), mix["size"].alias("size"), mix["tie"].alias("tie"))
    return epochs * mix["size"] + F.when(cut.isNull() | (mine > cut), F.lit(0)).when(mine < cut, mix["size"]).otherwise(part).cast("long")


def mix(docs: DataFrame, seed: str = SEED, keep_text: bool = True, **how) -> DataFrame:
    """``docs`` with ``mixed``: struct<size, source_size, target, taken>. ``how``: weights, factor, cap.

    Each text is read once. Without ``keep_text`` the result has doc_id and ``mixed`` only.
    """
    name, mixed = fresh(docs, "mix"), fresh(docs, "mixed")
    rows = _with_mix(docs, seed, name) if keep_text else measured(docs.select("doc_id", "source", "text"), seed).select("doc_id", F.col("mix").alias(name))
    rows = stage(rows, "measured")
    m = F.col(name)
    by_source = plan(in_buckets(rows.select(f"{name}.*")), **how)
    key, plan_name = fresh(rows, "mix_source"), fresh(rows, "mix_plan")
    table = by_source.select(F.col("source").alias(key), F.struct("source_size", "target", "epochs", "cut", "part").alias(plan_name))
    table = small(table, FEW_SOURCES)
    p = F.col(plan_name)
    joined = rows.join(table, m["source"].eqNullSafe(table[key]), "left")
    made = F.struct(m["size"].alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), taken(m, p["epochs"], p["cut"], p["part"]).alias("taken"))
    return joined.select(*([F.col(f"`{c}`") for c in docs.columns] if keep_text else ["doc_id"]), made.alias(mixed))


def _with_mix(docs: DataFrame, seed: str, name: str) -> DataFrame:
    """``docs`` with its ``mix`` under a free name."""
    if name == "mix":
        return measured(docs, seed)
    held = docs.columns
    return measured(docs.withColumnRenamed("mix", name + "_own"), seed).withColumnRenamed("mix", name).withColumnRenamed(name + "_own", "mix").select(*[f"`{c}`" for c in held], name)
