"""Quality rules whose cutoffs are certified on labelled documents.

Every rule rejects a document whose signal exceeds a cutoff. The cutoffs of a stratum
(a language with ``LEAST_HOLDOUT`` labelled good documents or more, ``MOST_STRATA`` at most) are chosen on labelled
good documents, each label and each text counting once, as repeats are no independent trials: a cutoff is certified if, were the true
share of good documents that it rejects above ``alpha / rules``, so few rejections would be
seen with probability ``delta / (strata * rules)`` at most (exact binomial tail). Within a
rule cutoffs are tested from the mildest on, stopping at the first that fails, so that the
order of tests needs no correction; across rules and strata the correction is Bonferroni's.
With probability 1 - delta, no stratum then loses more than ``alpha`` of its good documents.

All of it is DataFrame expressions: windows of words are sorted inside the row, so no word
is shuffled; a text may be as long as a row can be.

Nulls: a null text has no words; a null language, or one with few labels, belongs to stratum ``other``;
a document without labels is only judged. Several labels of one id count as good if one does; of texts with
the same id, that with the smallest MD5 is the labelled one. Repeated rows are each judged and each returned.
An empty table gives an empty result, empty labels reject nothing more. Columns of the caller are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.llm.common import SPACE_WORD, fresh, let, stage

#: Labelled good documents that a language needs for cutoffs of its own, and languages that get them at most
#: (those with the most, ties by name); all others share ``other``.
LEAST_HOLDOUT, MOST_STRATA = 100, 64
#: Signals and their cutoffs, mildest first. Parameters, not fitted to data.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "marks_per_word": (2.0, 1.5, 1.0, 0.7, 0.5, 0.3),
    "dup_line_share": (0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_share": (0.48, 0.45, 0.4, 0.35, 0.3),
}
ALPHA, DELTA = 0.02, 0.05


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more."""

    def covered(grams: Column) -> Column:
        twin = lambda x, i: F.coalesce(x["g"] == F.get(grams, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(grams, i + 1)["g"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(grams, twin), lambda x: x["p"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p")))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(grams(w)), covered)))


def features(text: Column) -> Column:
    """Struct of counts of one text: words, characters, symbols, repeated lines and words."""
    t = F.coalesce(text, F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("long")

    words = F.regexp_extract_all(t, F.lit(SPACE_WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(SPACE_WORD))
    return F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r"))).alias("w"),
        (F.length(t).cast("long") - count(r"[\x20\x09-\x0D]")).alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        count(r"[A-Z]").alias("n_upper"),
        count(r"[!?*]").alias("n_marks"),
    )


def rate(docs: DataFrame, text: str = "text", into: str = "quality_counts") -> DataFrame:
    """``docs`` with one more column: the counts of each text and whether it fails the fixed rules. Narrow."""
    raw = fresh(docs, "quality_raw")
    f = F.col(raw)
    n, r = f["w"]["n"], f["w"]["r"]
    return docs.withColumn(raw, features(F.col(text))).withColumn(
        into,
        F.struct(
            n.alias("n_words"),
            f["word_chars"].alias("word_chars"),
            f["n_symbols"].alias("n_symbols"),
            f["l"]["dup"].alias("n_dup_lines"),
            r.alias("n_repeat_words"),
            ((n < 50) | (100 * r > 50 * n)).alias("base_failed"),
            f["l"]["n"].alias("n_lines"),
            f["n_upper"].alias("n_upper"),
            f["n_marks"].alias("n_marks"),
            F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_md5"),
        ),
    ).drop(raw)


def signals(q: Column) -> dict[str, Column]:
    """The rules' signals; more is worse. Zero where there is nothing to divide by."""
    share = lambda a, b: F.when(q[b] > 0, q[a] / q[b]).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def stratum(lang: Column, strata: list[str]) -> Column:
    """The language if it is one of ``strata``, else null: the stratum of all others."""
    return F.when(lang.isin(*strata), lang) if strata else F.lit(None).cast("string")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exact; 1 where k exceeds the mean, as no such k is ever certified.

    Terms grow up to the mean, so the last one is kept as logarithm and the sum relative to it.
    """
    odds = p / (1 - p)
    zero = F.struct((n * F.log(F.lit(1 - p))).alias("lt"), F.lit(1.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        up = F.log((n - i + 1) / i * odds)
        return F.struct((a["lt"] + up).alias("lt"), (a["s"] * F.exp(-up) + 1.0).alias("s"))

    sums = F.aggregate(F.sequence(F.lit(1).cast("long"), k), zero, step, lambda a: F.exp(a["lt"]) * a["s"])
    return F.when(k > n * p, F.lit(1.0)).when(k < 1, F.exp(n * F.log(F.lit(1 - p)))).otherwise(sums)


def holdout(rated: DataFrame, labels: DataFrame, doc_id: str = "doc_id", lang: str = "lang", counts: str = "quality_counts") -> DataFrame:
    """(lang, q) of the labelled good documents that the fixed rules leave: a row per label and text."""
    good = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q")).where("q = 1").select("id")
    q = F.col("q")
    own = rated.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(counts).alias("q")).where(~q["base_failed"])
    first = F.min(F.struct(q["text_md5"].alias("text_md5"), "lang", "q")).alias("x")
    once = own.join(good, "id").groupBy("id").agg(first)
    return once.groupBy("x.lang", "x.text_md5").agg(F.min("x.q").alias("q")).select("lang", "q")


def strata_of(held: DataFrame) -> list[str]:
    """Languages with cutoffs of their own, at most ``MOST_STRATA``."""
    many = held.where("lang is not null").groupBy("lang").count().where(F.col("count") >= LEAST_HOLDOUT)
    return sorted(r["lang"] for r in many.orderBy(F.desc("count"), "lang").limit(MOST_STRATA).collect())


def calibrate(
    rated: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    lang: str = "lang",
    counts: str = "quality_counts",
    alpha: float = ALPHA,
    delta: float = DELTA,
    cutoffs: dict[str, tuple[float, ...]] | None = None,
) -> DataFrame:
    """One row per stratum (null: all other languages) and rule that has a certified cutoff: stratum, rule, cutoff, holdout, rejected, p_value.

    At most (MOST_STRATA + 1) * len(cutoffs) rows, whatever the size of the inputs.
    """
    rules = CUTOFFS if cutoffs is None else cutoffs
    held = stage(holdout(rated, labels, doc_id, lang, counts), "holdout")
    strata = strata_of(held)
    level = [F.struct(F.lit(name).alias("rule"), sum((s > c).cast("int") for c in rules[name]).alias("level")) for name, s in signals(F.col("q")).items() if name in rules]
    seen = held.select(stratum(F.col("lang"), strata).alias("stratum"), F.explode(F.array(*level)).alias("x")).groupBy("stratum", "x.rule", "x.level").count()
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.lit(i + 1).alias("step")) for r, cs in rules.items() for i, c in enumerate(cs)])
    totals = seen.groupBy("stratum", "rule").agg(F.collect_list(F.struct("level", "count")).alias("levels"))
    each = totals.select("stratum", "rule", "levels", F.explode(F.filter(grid, lambda g: g["rule"] == F.col("rule"))).alias("g"))
    # cutoffs fall, so a text over j of them is over the j strictest: it exceeds cutoff number `step` if j > width - step
    size = len({*rules})
    k = F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + F.when(x["level"] > F.col("width") - F.col("step"), x["count"]).otherwise(F.lit(0).cast("long")))
    n = F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    width = F.element_at(F.create_map(*[y for r, cs in rules.items() for y in (F.lit(r), F.lit(len(cs)))]), F.col("rule"))
    tested = each.select("stratum", "rule", "levels", "g.cutoff", "g.step", width.alias("width"))
    tested = tested.select("stratum", "rule", "cutoff", "step", n.alias("holdout"), k.alias("rejected"))
    tested = tested.withColumn("p_value", binomial_tail(F.col("holdout"), F.col("rejected"), alpha / size))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    passed = tested.withColumn("ok", F.min((F.col("p_value") <= delta / (size * (len(strata) + 1))).cast("int")).over(order))
    best = F.max_by(F.struct("cutoff", "holdout", "rejected", "p_value"), "step").alias("b")
    out = passed.where("ok = 1").groupBy("stratum", "rule").agg(best).select("stratum", "rule", "b.*")
    # every stratum has a row, so that a language without certified cutoffs is not taken for one of the others
    own = held.select(stratum(F.col("lang"), strata).alias("stratum")).distinct().where("stratum is not null")
    return out.unionByName(own.withColumn("rule", F.lit("none")), allowMissingColumns=True)


def decide(rated: DataFrame, cutoffs: DataFrame, lang: str = "lang", counts: str = "quality_counts", into: str = "kept") -> DataFrame:
    """``rated`` with ``into``: false if the fixed rules or a certified cutoff of the stratum reject the text.

    ``cutoffs`` has ``MOST_STRATA`` + 1 strata at most, so its map per stratum is broadcast.
    """
    name, key = fresh(rated, "quality_cutoffs"), fresh(rated, "quality_stratum")
    pairs = F.map_from_entries(F.collect_list(F.struct("rule", "cutoff")))
    table = stage(cutoffs.groupBy(F.col("stratum").alias(key)).agg(pairs.alias(name)), "cutoffs")
    strata = [r[key] for r in table.select(key).where(F.col(key).isNotNull()).collect()]
    q = F.col(counts)
    bad = F.lit(False)
    for rule, s in signals(q).items():
        bad = bad | F.coalesce(s > F.try_element_at(F.col(name), F.lit(rule)), F.lit(False))
    own = stratum(F.col(lang), strata).eqNullSafe(table[key])
    return rated.join(F.broadcast(table), own, "left").withColumn(into, ~q["base_failed"] & ~bad).drop(name, key)


def judge(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` and, last, ``quality_counts`` and ``kept`` (or free names like these). The counts are made once and staged with the rows.

    Without ``keep_text`` doc_id and lang are all that is kept of ``docs``.
    """
    if not keep_text:
        docs = docs.select("doc_id", "lang", "text")
    counts, kept = fresh(docs, "quality_counts"), fresh(docs, "kept")
    rated = stage(rate(docs, into=counts).drop(*([] if keep_text else ["text"])), "rated")
    return decide(rated, calibrate(rated, labels, counts=counts), counts=counts, into=kept)
