"""Faithfulness of explanations: word scores, probes with words removed or kept, and their effect.

Words are rows (key, w, start, end, word, gap, head) as ``evidence.word_spans`` gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, raw_tokens, stem
from ..functions.vectors import let, uniform
from .evidence import bare_word, touching

# fixed values: the shares of words that probes remove or keep
FRACTIONS = (0.01, 0.05, 0.1, 0.2, 0.5)


def word_scores(words: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """Words with score: the highest of the tokens (key, start, end, score) that touch the word, zero without one."""
    hit = touching(words, tokens.select(*key, "start", "end", "score"), key).groupBy(*key, "w").agg(F.max("score").alias("score"))
    return words.join(hit, [*key, "w"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def control_scores(words: DataFrame, key: list[str], salt: str = "control", lexicon: DataFrame | None = None) -> DataFrame:
    """Words with the score of a control: a keyed draw, or with ``lexicon`` (token, rate) the rate of the bare lower-cased word, zero outside it."""
    if lexicon is None:
        return words.withColumn("score", uniform(F.concat_ws("|", *key, "w"), salt))
    known = words.withColumn("_t", bare_word("word")).join(lexicon.select(F.col("token").alias("_t"), F.col("rate").alias("_rate")), "_t", "left")
    return known.withColumn("score", F.coalesce("_rate", F.lit(0.0))).drop("_t", "_rate")


def lexical_evidence(words: DataFrame, questions: DataFrame, key: list[str]) -> DataFrame:
    """Words, but for stop words, whose stem occurs in the text of their question (key, text)."""
    asked = questions.select(*key, F.explode(raw_tokens(F.col("text"))).alias("_t")).select(*key, stem(F.col("_t")).alias("_k")).distinct()
    bare = F.regexp_replace(F.lower("word"), "[^a-z0-9]", "")
    told = words.withColumn("_b", bare).where((F.length("_b") >= 2) & ~F.col("_b").isin(STOPWORDS))
    return told.withColumn("_k", stem(F.col("_b"))).drop("_b").join(asked, [*key, "_k"], "left_semi").drop("_k")


def top_words(scored: DataFrame, key: list[str], fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """(key, fraction, w): the top share of a case's words, at least one; ties by a keyed draw."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), uniform(F.concat_ws("|", *key, "w"), "tie"), "w")
    ranked = scored.select(*key, "w", F.row_number().over(order).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("_n"))
    each = ranked.select("*", F.explode(F.array(*[F.lit(f) for f in fractions])).alias("fraction"))
    return each.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("_n") - 1e-9))).select(*key, "fraction", "w")


def probes(words: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """(key, fraction, way, text): a case's text without the chosen words (remove) and with them alone (keep).

    A kept word keeps the white space that follows it, but for the last one; the text's head and tail stay. Words and choices
    are dealt by case once; a case's probes are cut from one array of its words, as long as its text, and stay where they are."""
    told = words.select(*key, "w", "word", "gap", "head", F.lit(None).cast(dict(chosen.dtypes)["fraction"]).alias("fraction"))
    both = told.unionByName(chosen.select(*key, "fraction", "w"), allowMissingColumns=True).repartition(*key)
    each = both.groupBy(*key, "w").agg(*[F.max(c).alias(c) for c in ("word", "gap", "head")], F.collect_set("fraction").alias("in"))
    cases = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("w", "word", "gap", "head", "in"))).alias("_p"))
    asked = F.array_distinct(F.flatten(F.transform("_p", lambda s: s["in"])))
    ways = F.flatten(F.transform(asked, lambda f: F.array(*[F.struct(f.alias("fraction"), F.lit(way).alias("way")) for way in ("keep", "remove")])))
    here = F.filter("_p", lambda s: F.array_contains(s["in"], F.col("_x.fraction")) == (F.col("_x.way") == "keep"))
    body = let(here, lambda p: F.when(F.size(p) == 0, "").otherwise(F.concat(F.array_join(F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda s: F.concat(s["word"], s["gap"])), ""), F.try_element_at(p, F.lit(-1))["word"])))
    text = F.concat(F.element_at("_p", 1)["head"], body, F.element_at("_p", -1)["gap"])
    return cases.select(*key, "_p", F.explode(ways).alias("_x")).select(*key, "_x.fraction", "_x.way", text.alias("text"))


def distinct_probes(probed: DataFrame, key: list[str]) -> DataFrame:
    """The texts to score: each once for its case."""
    return probed.select(*key, "text").distinct()


def faithfulness(probed: DataFrame, full: DataFrame, key: list[str]) -> DataFrame:
    """probed (key, fraction, way, p), full (key, p) to (key, comprehensiveness, sufficiency): mean drops over the fractions."""
    drop = probed.join(full.select(*key, F.col("p").alias("_full")), key).withColumn("_d", F.col("_full") - F.col("p"))
    return drop.groupBy(*key).agg(*[F.avg(F.when(F.col("way") == way, F.col("_d"))).alias(name) for way, name in (("remove", "comprehensiveness"), ("keep", "sufficiency"))])


def completeness(attributions: DataFrame, deltas: DataFrame, key: list[str], least: float = 0.01) -> DataFrame:
    """One row: cases, median, 90 % point and largest of how far a case's attributions miss its change, relative to it."""
    sums = attributions.groupBy(*key).agg(F.sum("score").alias("_a"))
    rel = sums.join(deltas.where(F.abs("delta") >= least), key).select(F.round(F.abs(F.col("_a") - F.col("delta")) / F.abs("delta"), 9).alias("rel"))
    pct = [F.expr(f"percentile_disc({q}) within group (order by rel)").alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"))]
    return rel.agg(F.count(F.lit(1)).alias("n"), *pct, F.max("rel").alias("worst"))


def plausibility(prf: DataFrame, words: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over the cases with a human mark, one row or one for each of ``by``; words have gold and predicted."""
    share = words.groupBy(*key).agg(F.avg(F.col("predicted").cast("double")).alias("highlighted"), F.avg(F.col("gold").cast("double")).alias("human")).where("human > 0")
    return prf.join(share, key).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "highlighted", "human")])
