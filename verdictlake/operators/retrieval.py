"""Lexical scoring, BM25 and vector shortlists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import token_counts
from ..functions.vectors import let, uniform
from ..sources.shared import stage

K1, B = 1.2, 0.75


def piece_counts(df: DataFrame, text: str, least: int = 2, pattern: str = r"\w+|[^\w\s]+") -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def hash_collisions(pieces: DataFrame, piece: str, buckets: int) -> DataFrame:
    """One row: distinct pieces, and the share that meets another in a bucket."""
    one = pieces.select(piece).distinct().withColumn("bucket", F.floor(uniform(piece, "bucket") * buckets))
    full = one.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return full.agg(F.sum("n").alias("pieces"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("collided"))


def lexical_scores(states: DataFrame, members: DataFrame) -> DataFrame:
    """states (case_id, text), members (idx, text) to (case_id, idx, score) for pairs that share a token."""
    # a case may come in several rows
    seen = token_counts(states, "text", ["case_id"]).groupBy("case_id", "token").agg(F.sum("n").alias("count"))
    own = token_counts(members, "text", ["idx"]).select("idx", "token").distinct()
    size = own.groupBy("idx").agg(F.count(F.lit(1)).alias("size"))
    hit = seen.join(own, "token").groupBy("case_id", "idx").agg(F.sum(F.log1p("count") * F.log1p(F.length("token"))).alias("s"))
    return hit.join(F.broadcast(size), "idx").select("case_id", "idx", (F.col("s") / F.sqrt("size")).alias("score"))


def option_index(options: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """options (by, idx, text) to postings (by, token, idx, tf, size, df) and totals (by, n, avg_len): an index for each option set."""
    by = by or []
    tf = token_counts(options, "text", [*by, "idx"]).groupBy(*by, "idx", "token").agg(F.sum("n").alias("tf"))
    size = tf.groupBy(*by, "idx").agg(F.sum("tf").alias("size"))
    df = tf.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))
    n, words = options.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), size.groupBy(*by).agg(F.sum("size").alias("w"))
    totals = (n.join(words, by, "left") if by else n.crossJoin(words)).select(*by, "n", (F.coalesce("w", F.lit(0)) / F.col("n")).alias("avg_len"))
    return tf.join(size, [*by, "idx"]).join(df, [*by, "token"]), totals


def weighted(postings: DataFrame, totals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, token, idx, df, part): what a token adds to an option's BM25 score."""
    by = by or []
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg_len")))
    return (postings.join(totals, by) if by else postings.crossJoin(F.broadcast(totals))).select(*by, "token", "idx", "df", part.alias("part"))


#: a token of more options than this is frequent: queries don't meet its options before rarer tokens have named candidates
FREQUENT = 4096


def best_options(terms: DataFrame, parts: DataFrame, k: int, by: list[str] | None = None, frequent: int | None = None) -> DataFrame:
    """terms (by, qid, token: distinct), parts (by, token, idx, df, part) to (by, qid, rank, idx, score): the ``k`` highest sums, ties to the lower index.

    Every part is positive, so scores from rare tokens alone bound the final ones from below, and the largest parts of a
    query's frequent tokens bound what those can add. Where the k-th best rare score exceeds that sum, an option without a rare
    token can't be among the best; only options within the sum of the k-th best are then looked up under the frequent tokens.
    Queries whose rare tokens decide too little, or that have no frequent one, meet all their tokens' options. Either way the result is exact."""
    by, frequent = by or [], FREQUENT if frequent is None else frequent
    key = [*by, "qid"]
    # qid first: rows are sorted by a prefix of what comes first
    order = Window.partitionBy("qid", *by).orderBy(F.desc("score"), "idx")

    def ranked(scores: DataFrame) -> DataFrame:
        return scores.groupBy(*key, "idx").agg(F.round(F.sum("part"), 9).alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*key, "rank", "idx", "score")

    common = parts.where(F.col("df") > frequent)
    if not common.head(1):
        return ranked(terms.join(parts.drop("df"), [*by, "token"]))
    most = common.groupBy(*by, "token").agg(F.max("part").alias("most"))
    held = terms.join(most, [*by, "token"])
    slack = held.groupBy(*key).agg(F.sum("most").alias("slack"))
    # a query of rare tokens alone has nothing to leave out
    mixed = terms.join(slack.select(*key), key, "left_semi")
    rare = mixed.join(parts.where(F.col("df") <= frequent).drop("df"), [*by, "token"]).groupBy(*key, "idx").agg(F.sum("part").alias("part"))
    kth = rare.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("part")))).where(F.col("_r") == k).select(*key, F.col("part").alias("kth"))
    # a margin for the rounding of sums
    safe = kth.join(slack, key).where(F.col("kth") > F.col("slack") + 1e-6)
    candidates = rare.join(safe, key).where(F.col("part") >= F.col("kth") - F.col("slack") - 1e-6).select(*key, "idx", "part")
    added = candidates.select(*key, "idx").join(held.select(*key, "token"), key).join(common.drop("df"), [*by, "token", "idx"]).groupBy(*key, "idx").agg(F.sum("part").alias("_more"))
    whole = candidates.join(added, [*key, "idx"], "left").select(*key, "idx", (F.col("part") + F.coalesce("_more", F.lit(0.0))).alias("part"))
    others = terms.join(safe.select(*key), key, "left_anti")
    plain = others.join(parts.drop("df"), [*by, "token"]).select(*key, "idx", "part")
    # a query is in one of both, so each is ranked where its terms lie. What few are left of the first are dealt out otherwise, as Spark
    # zips the partitions of a union's sides that are dealt alike, and fails where it has split or merged those of one side
    return ranked(whole).repartition(*key, "idx").unionByName(ranked(plain))


def padded_shortlist(queries: DataFrame, best: DataFrame, options: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(by, qid, rank, idx, score): ``best``, and for a query with fewer hits the lowest indices it hasn't got, of which the first ``k`` always suffice."""
    by = by or []
    key = [*by, "qid"]
    # at most k rows a query
    own = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "idx", "score"))).alias("_best"))
    lowest = options.where(F.col("idx") < k).groupBy(*by).agg(F.array_sort(F.collect_list("idx")).alias("_low"))
    asked = queries.select(*key).distinct().join(own, key, "left")
    padded = asked.join(lowest, by) if by else asked.crossJoin(F.broadcast(lowest))
    some = F.coalesce(F.transform("_best", lambda x: F.struct(x["idx"].alias("idx"), x["score"].alias("score"))), F.array().cast("array<struct<idx:long,score:double>>"))
    more = F.transform(F.filter("_low", lambda i: ~F.exists(some, lambda x: x["idx"] == i)), lambda i: F.struct(i.cast("long").alias("idx"), F.lit(None).cast("double").alias("score")))
    return padded.select(*key, F.posexplode(F.slice(F.concat(some, more), 1, k)).alias("rank", "x")).select(*key, (F.col("rank") + 1).alias("rank"), "x.idx", "x.score")


def bm25_shortlist(queries: DataFrame, options: DataFrame, k: int, frequent: int | None = None) -> DataFrame:
    """queries (qid, text) and options (idx from 0, text) to (qid, rank, idx, score): the best ``k`` options.

    Ties go to the lower index; a query with fewer hits is padded with the lowest indices it hasn't got. Scores are rounded to
    nine decimals so that the order of summation can't matter."""
    terms = token_counts(queries, "text", ["qid"]).select("qid", "token").distinct()
    best = best_options(terms, weighted(*option_index(options)), k, frequent=frequent)
    return padded_shortlist(queries, best, options, k)


def set_keys(options: DataFrame, name: str) -> DataFrame:
    """(name, set_key): a content key of each option set (name, idx, text); sets of equal options have equal keys, whatever they are called.

    The key is made of sums over options, so a set of any size is keyed with partial sums and is never gathered."""
    digest = F.sha2(F.to_json(F.struct("idx", "text"), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    made = F.sha2(F.concat_ws("|", F.count(F.lit(1)), *parts), 256)
    return options.groupBy(name).agg(made.alias("set_key"))


class OptionStore:
    """Indexes of option sets in Parquet tables at ``path``, a folder that every executor reaches: written once a set, found by content key.

    ``postings`` (set_key, token, idx, df, part, stands) has every option; of those of one bag of tokens the lowest index stands for
    all, and these rows are all that queries meet. ``df`` counts the bags that have the token. ``bags`` (set_key, bag, idx, place) are
    the first ``PADDED`` indices of each bag under the index that stands for it, ``lowest`` (set_key, idx) those of the set, which pad."""

    PADDED = 1024
    POSTINGS, LOWEST = "set_key string, token string, idx long, df long, part double, stands boolean", "set_key string, idx long"
    BAGS = "set_key string, bag long, idx long, place int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name in ("postings", "bags", "lowest"):
            spark.createDataFrame([], getattr(self, name.upper())).write.mode("append").parquet(f"{path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(getattr(self, name.upper())).parquet(f"{self.path}/{name}")

    def ensure(self, options: DataFrame, name: str) -> DataFrame:
        """(name, set_key) of the sets of ``options`` (name, idx from 0, text); sets that the store hasn't got are indexed, the others' texts are read for their keys alone."""
        keys = stage(set_keys(options, name), "keys")
        known = self.read("lowest").select("set_key").distinct()
        # of equal sets one is indexed
        fresh = keys.join(known, "set_key", "left_anti").groupBy("set_key").agg(F.min(name).alias(name))
        if fresh.head(1):
            new = options.join(stage(fresh, "fresh"), name).select("set_key", F.col("idx").cast("long").alias("idx"), "text")
            self._index(new)
            # last, as it says that a set is there
            new.where(F.col("idx") < self.PADDED).select("set_key", "idx").write.mode("append").parquet(f"{self.path}/lowest")
        return keys

    def _index(self, new: DataFrame) -> None:
        """Postings and bags of new sets (set_key, idx, text): weights are made once a bag and then handed to its options."""
        key = ["set_key", "idx"]
        tf = stage(token_counts(new, "text", key).groupBy(*key, "token").agg(F.sum("n").alias("tf")), "tf")
        digests = stage(bag_keys(tf, key, "tf"), "digests")
        stands = digests.groupBy("set_key", "bag").agg(F.min("idx").alias("_stands"), F.count(F.lit(1)).alias("_times"))
        members = stage(digests.join(stands, ["set_key", "bag"]).select("set_key", "idx", F.col("_stands").alias("bag"), "_times"), "members")
        alone = members.where("idx = bag").drop("bag")
        own = tf.join(alone, key)
        size = own.groupBy(*key, "_times").agg(F.sum("tf").alias("size"))
        df = own.groupBy("set_key", "token").agg(F.sum("_times").alias("df"), F.count(F.lit(1)).alias("_bags"))
        words = size.groupBy("set_key").agg(F.sum(F.col("size") * F.col("_times")).alias("w"))
        totals = new.groupBy("set_key").agg(F.count(F.lit(1)).alias("n")).join(words, "set_key", "left").select("set_key", "n", (F.coalesce("w", F.lit(0)) / F.col("n")).alias("avg_len"))
        postings = own.drop("_times").join(size.drop("_times"), key).join(df.drop("_bags"), ["set_key", "token"])
        made = weighted(postings, stage(totals, "totals"), ["set_key"]).drop("df").join(df.drop("df").withColumnRenamed("_bags", "df"), ["set_key", "token"])
        parts = stage(made.select("set_key", "token", F.col("idx").alias("bag"), "df", "part"), "parts")
        every = parts.join(members.select("set_key", "idx", "bag"), ["set_key", "bag"]).select("set_key", "token", "idx", "df", "part", (F.col("idx") == F.col("bag")).alias("stands"))
        # those that stand for a bag lie together; a token of most options is dealt out by index
        order = [F.desc("stands"), F.asc("set_key"), F.asc("token"), F.asc("idx")]
        every.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").parquet(f"{self.path}/postings")
        place = F.row_number().over(Window.partitionBy("set_key", "bag").orderBy("idx"))
        members.select("set_key", "bag", "idx").withColumn("place", place).where(F.col("place") <= self.PADDED).write.mode("append").parquet(f"{self.path}/bags")

    def shortlist(self, queries: DataFrame, k: int, frequent: int | None = None, sets: DataFrame | None = None) -> DataFrame:
        """queries (set_key, qid, text) to (set_key, qid, rank, idx, score) as ``bm25_shortlist`` gives for each set; no option text is read.

        With ``sets`` (set_key), queries (qid, text) ask each of them, and a text is taken apart once. Texts are read once, and
        tokens that a set hasn't got are dropped before queries are dealt out; what the rest of a query meets stays in its task
        where the postings of the bags are small enough to be sent to all."""
        if k > self.PADDED:
            raise ValueError(f"at most {self.PADDED} options a query")
        key = ["set_key", "qid"]
        sets, every = (queries.select("set_key"), None) if sets is None else (sets.select("set_key"), F.broadcast(sets.select("set_key").distinct()))
        sets = sets.distinct()
        tokens = token_counts(queries, "text", key).drop("n") if every is None else token_counts(queries, "text", ["qid"]).drop("n").crossJoin(every)
        asked = queries.select(*key) if every is None else queries.select("qid").crossJoin(every)
        held = self.read("postings").where("stands").drop("stands").join(sets, "set_key", "left_semi")
        parts = stage(held.dropDuplicates(["set_key", "token", "idx"]), "parts")
        known = stage(parts.select("set_key", "token").distinct(), "tokens")
        terms = stage(tokens.join(known, ["set_key", "token"], "left_semi").select(*key, "token").repartition(*key).dropDuplicates([*key, "token"]), "terms")
        best = best_options(terms.repartition(*key), parts, k, ["set_key"], frequent)
        lowest = stage(self.read("bags").where(F.col("place") <= k).join(sets, "set_key", "left_semi").select("set_key", F.col("bag").alias("_bag"), "idx").distinct(), "bags")
        size = lowest.groupBy("set_key", "_bag").agg(F.count(F.lit(1)).alias("_size"))
        sized = best.select(*key, "score", F.col("idx").alias("_bag")).join(size, ["set_key", "_bag"])
        return padded_shortlist(asked, spread_bags(sized, lowest, k, ["set_key"]), self.read("lowest").distinct(), k, ["set_key"])


BLOCK = 4096


def vector_shortlist(queries: DataFrame, options: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """queries (qid, vec) and options (idx, vec) to (qid, rank, idx, score) by cosine, ties to the lower index.

    Both sides are dealt into blocks of about ``block`` vectors. Every pair of blocks is one matrix product in a task,
    which keeps each query's best ``k``, so a task holds two blocks and what is ranked is queries times blocks times k.
    A zero vector has cosine zero; vectors of other lengths are an error."""
    nq, no = (max(1, -(-df.count() // block)) for df in (queries, options))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("qid", "vec", deal("qid", nq).alias("qb"), every(no).alias("ob"))
    o = options.select("idx", "vec", deal("idx", no).alias("ob"), every(nq).alias("qb"))
    kinds = dict(queries.dtypes)["qid"], dict(options.dtypes)["idx"]

    def unit(vectors):
        m = np.array(vectors.tolist(), float)
        if m.dtype == object or m.ndim != 2:
            raise ValueError("vectors differ in length")
        size = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": left["qid"][:0], "idx": right["idx"][:0], "score": np.zeros(0)})
        right = right.sort_values("idx")
        a, b = unit(left["vec"]), unit(right["vec"])
        if a.shape[1] != b.shape[1]:
            raise ValueError("vectors differ in length")
        found = []
        for start in range(0, len(a), 256):
            score = np.round(a[start : start + 256] @ b.T, 9)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found.append((np.repeat(left["qid"].to_numpy()[start : start + 256], top.shape[1]), right["idx"].to_numpy()[top.ravel()], np.take_along_axis(score, top, 1).ravel()))
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("qid", "idx", "score"))})

    met = q.groupBy("qb", "ob").cogroup(o.groupBy("qb", "ob")).applyInPandas(best, f"qid {kinds[0]}, idx {kinds[1]}, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "idx")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "idx", "score")


def recall_at_k(shortlists: DataFrame, truth: DataFrame) -> DataFrame:
    """shortlists (qid, idx), truth (qid, idx) to one row: n, recall."""
    hit = shortlists.select("qid", "idx").distinct().withColumn("hit", F.lit(1.0))
    return truth.join(hit, ["qid", "idx"], "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def expand_shortlist(df: DataFrame, n: str = "n", idx: str = "idx", probs: str = "probs") -> DataFrame:
    """Options that a shortlist dropped come back at probability zero, in declared order."""
    full = lambda m: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))
    # bound, or the optimizer makes the map, and what its arrays are made of, anew for each option
    return df.withColumn(probs, let(F.map_from_arrays(idx, probs), full))


def lexical_decide(states: DataFrame, members: DataFrame, temperature: float = 2.0) -> DataFrame:
    """states (case_id, text), members (idx from 0, text) of one Choice to (case_id, logits): lexical scores over a temperature, zero without a shared token."""
    score = lexical_scores(states, members)
    n = members.agg((F.max("idx") + 1).cast("int").alias("_n"))
    own = score.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "score"))).alias("_m"))
    spine = states.select("case_id").join(own, "case_id", "left").crossJoin(F.broadcast(n))
    logits = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.try_element_at("_m", i.cast(dict(members.dtypes)["idx"])), F.lit(0.0)) / temperature)
    return spine.select("case_id", logits.alias("logits"))


def pseudo_prior(schema_hash: Column, seed: int = 0) -> Column:
    """A small offset in [0, 0.5) that a question's fingerprint fixes; a yes/no logit is its score less this."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), schema_hash), 256), 1, 2), 16, 10).cast("double") / 255.0 * 0.5


def needs_retrieval(questions: DataFrame, options: str = "options", tokens: str = "tokens", most_options: int = 1024, most_tokens: int = 65_536) -> DataFrame:
    """Add narrow: whether a question is so large that its options are shortlisted before it is asked."""
    return questions.withColumn("narrow", (F.col(options) > most_options) | (F.col(tokens) > most_tokens))


def drop_slots(options: DataFrame, slots: list[str], drops: list[int], salt: str = "drop") -> DataFrame:
    """(drop, idx, text): each option described by its slots, all but a keyed choice of ``drop`` of them."""
    key = lambda i: uniform(F.concat_ws("|", "idx", "drop", i), salt)
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("text")) for i, c in enumerate(slots)])
    each = options.select("idx", parts.alias("_p"), F.explode(F.array(*[F.lit(d) for d in drops])).alias("drop"))
    ranked = F.array_sort(F.transform("_p", lambda x: F.struct(key(x["i"]).alias("u"), x["i"].alias("i"), x["text"].alias("text"))))
    kept = F.array_sort(F.transform(F.slice(ranked, F.col("drop") + 1, F.lit(len(slots))), lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"))))
    return each.select("drop", "idx", F.array_join(F.transform(kept, lambda x: x["text"]), " ").alias("text"))


def bag_keys(counts: DataFrame, key: str | list[str], *also: str) -> DataFrame:
    """counts (key, token, also) to (key, bag): a digest that equal bags of tokens share, in whatever order they come."""
    return counts.groupBy(key).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("token", *also)))), 256).alias("bag"))


def spread_bags(best: DataFrame, lowest: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """``best`` (by, qid, score, _bag, _size) over the options that stand for their bags to (by, qid, rank, idx, score) over all options.

    ``lowest`` (by, _bag, idx) has the ``k`` lowest options of each bag. Bags with ``k`` options of higher scores before them are left
    out before the others are spread."""
    by = by or []
    key = [*by, "qid"]
    upto, level = Window.partitionBy(*key).orderBy(F.desc("score")), Window.partitionBy(*key, "score")
    near = best.withColumn("_over", F.sum("_size").over(upto) - F.sum("_size").over(level)).where(F.col("_over") < k)
    spread = near.select(*key, "score", "_bag").join(lowest, [*by, "_bag"])
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "idx"))).where(F.col("rank") <= k)
    return ranked.select(*key, "rank", "idx", "score")


def bag_shortlists(queries: DataFrame, options: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``bm25_shortlist`` once for each set of tokens: queries with the qid ``asked`` that stands for theirs, and (qid, rank, idx, score) of those.

    Options of one bag of tokens have one score, so the lowest of them stands for its bag where queries meet options, and that join
    grows with distinct sets and bags, not with rows. A bag that isn't among the best ``k`` by score and lowest index has ``k``
    options before it, so bags are spread to their ``k`` lowest options afterwards. Statistics are those of all options: the result is exact."""
    tf = token_counts(options, "text", ["idx"]).groupBy("idx", "token").agg(F.sum("n").alias("n"))
    bags = stage(bag_keys(tf, "idx", "n"), "bags")
    stands = bags.groupBy("bag").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("_size"))
    keys = bag_keys(token_counts(queries, "text", ["qid"]).select("qid", "token").distinct(), "qid")
    keyed = queries.join(keys, "qid", "left").withColumn("bag", F.coalesce("bag", F.lit("")))
    asked = stage(keyed.withColumn("asked", F.min("qid").over(Window.partitionBy("bag"))).drop("bag"), "asked")
    few = asked.where(F.col("qid") == F.col("asked"))
    terms = token_counts(few, "text", ["qid"]).select("qid", "token").distinct()
    own = weighted(*option_index(options)).join(stands.select("idx"), "idx", "left_semi")
    # a token is frequent by the bags that have it
    own = own.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token")))
    best = best_options(terms, stage(own, "parts"), k).join(stands.withColumnRenamed("bag", "_bag"), "idx")
    lowest = bags.withColumn("_r", F.row_number().over(Window.partitionBy("bag").orderBy("idx"))).where(F.col("_r") <= k)
    return asked, padded_shortlist(few, spread_bags(best, lowest.select(F.col("bag").alias("_bag"), "idx"), k), options, k)


def recall_sweep(options: DataFrame, queries: DataFrame, ks: list[int], least: float = 0.99) -> DataFrame:
    """options (idx, text), queries (drop, idx: the true option, text) to (drop, k, n, recall, passed): one shortlist of the largest k serves all, made once for each set of tokens."""
    named = queries.select(F.concat_ws("|", "drop", "idx").alias("qid"), "drop", F.col("idx").alias("true"), "text")
    asked, best = bag_shortlists(named, options, max(ks))
    hit = asked.select("asked", "drop", "true").join(best.select(F.col("qid").alias("asked"), F.col("idx").alias("true"), "rank"), ["asked", "true"], "left")
    each = hit.select("drop", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    out = each.groupBy("drop", "k").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))).alias("recall"))
    return out.withColumn("passed", F.col("recall") >= least)
