"""Decisions as a table job: calibrated answers, validation, admission, fingerprints, costs and readouts of model replies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import estimated_tokens
from .fits import apply_isotonic

UNSEEN = 1e-4


@dataclass(frozen=True)
class Budget:
    """Token budgets of one deployment tier; the defaults are the smaller, compatible one."""

    context: int = 65_536
    envelope: int = 32_768
    state: int = 16_384
    schema: int = 40_960
    readout: int = 4_096
    questions: int = 64


def decide(predictions: DataFrame, by_domain: DataFrame, by_kind: DataFrame, knots: DataFrame) -> DataFrame:
    """Add probs, selected and confidence to predictions (domain, kind, logits).

    The temperature is the domain's, else the kind's, else one; a kind's knots then map the top
    probability. ``by_domain`` and ``by_kind`` have a row for each (domain, kind) or kind, ``knots`` one for each step of a kind."""
    t = predictions.join(by_domain.select("domain", "kind", F.col("t").alias("_d")), ["domain", "kind"], "left").join(by_kind.select("kind", F.col("t").alias("_k")), "kind", "left")
    warm = t.withColumn("probs", V.softmax("logits", F.coalesce("_d", "_k", F.lit(1.0)))).drop("_d", "_k")
    return apply_isotonic(warm, knots, ["kind"]).withColumns({"selected": V.argmax("probs"), "confidence": V.choice_confidence("probs")})


def align(predictions: DataFrame, questions: DataFrame, key: list[str]) -> DataFrame:
    """predictions (key, answer: map of label to probability) in the declared order of questions (key, labels); a label without an answer is null."""
    return questions.join(predictions, key, "left").withColumn("probs", F.transform("labels", lambda x: F.try_element_at("answer", x))).drop("answer")


def answer_faults(logits: Column, n: Column) -> Column:
    """What is wrong with an answer of ``n`` logits: missing, of another count or not finite."""
    wrong = F.exists(logits, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    return F.array_compact(F.array(*[F.when(c, name) for name, c in (("missing", logits.isNull()), ("count", F.size(logits) != n), ("not finite", wrong))]))


def validate_output(predictions: DataFrame, questions: DataFrame, key: list[str]) -> DataFrame:
    """(key, reasons): what is wrong with each answer of predictions (key, kind, logits) to questions (key, kind, n)."""
    q = questions.select(*key, F.col("kind").alias("_kind"), F.col("n").alias("_n"))
    both = q.withColumn("_q", F.lit(True)).join(predictions.select(*key, "kind", "logits").withColumn("_p", F.lit(True)), key, "full")
    wrong = F.exists("logits", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    rules = [("missing", F.col("_p").isNull()), ("undeclared", F.col("_q").isNull()), ("kind", F.col("kind") != F.col("_kind")), ("count", F.size("logits") != F.col("_n")), ("not finite", wrong)]
    return both.select(*key, F.array_compact(F.array(*[F.when(c, n) for n, c in rules])).alias("reasons"))


def validate_requests(questions: DataFrame, key: list[str], name_limit: int = 256) -> DataFrame:
    """(key, reasons) of questions (key, kind, names, values): too few members, repeated or overlong names, values that don't ascend or are partly given."""
    v = F.col("values")
    given = F.size(F.filter(v, lambda x: x.isNotNull()))
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: (i < F.size(v)) & (F.element_at(v, i) >= F.try_element_at(v, i + 1)))
    named = F.col("kind") != "noul"
    rules = [
        ("members", named & (F.size("names") < 2)),
        ("repeated", F.size(F.array_distinct("names")) < F.size("names")),
        ("name", F.exists("names", lambda x: (F.length(x) == 0) | (F.length(x) > name_limit))),
        ("partial values", (F.col("kind") == "score") & (given > 0) & (given < F.size(v))),
        ("order", (F.col("kind") == "score") & (given == F.size(v)) & (F.size(v) > 1) & falls),
    ]
    return questions.select(*key, F.array_compact(F.array(*[F.when(c, n) for n, c in rules])).alias("reasons"))


def question_tokens(instructions: Column, names: Column) -> Column:
    """Estimated schema tokens of a question: its header and every member are segments."""
    return estimated_tokens(instructions) + F.aggregate(names, F.lit(0).cast("long"), lambda a, x: a + estimated_tokens(x))


def compiled(questions: DataFrame, states: DataFrame, case: str) -> DataFrame:
    """questions (case, schema, readout), states (case, state) to one row of sums for each case."""
    schema, readout = F.col("schema").cast("long"), F.col("readout").cast("long")
    sums = questions.groupBy(case).agg(
        F.count(F.lit(1)).alias("questions"), F.sum(schema).alias("schema"), F.max(schema).alias("longest"), F.sum(readout).alias("readout"), F.sum(schema * schema + readout * (schema + readout)).alias("blocks")
    )
    return states.select(case, "state").join(sums, case)


def admit_requests(rows: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Add reason (null: admitted), the first budget that a compiled request breaks."""
    total = F.col("schema") + F.col("state") + F.col("readout")
    rules = [
        ("questions", F.col("questions") > budget.questions),
        ("schema", F.col("schema") > budget.schema),
        ("state", F.col("state") > budget.state),
        ("envelope", F.col("state") + F.col("longest") > budget.envelope),
        ("readout", F.col("readout") > budget.readout),
        ("context", total > budget.context),
    ]
    return rows.withColumn("reason", F.coalesce(*[F.when(c, n) for n, c in rules]))


def attention_cost(rows: DataFrame) -> DataFrame:
    """Add pairs that the isolated mask admits, pairs of a dense one, the saving and the dense length of equal cost."""
    state = F.col("state").cast("long")
    pairs = F.col("blocks") + F.col("readout") * state + state * state
    dense = F.pow(F.col("schema") + state + F.col("readout"), F.lit(2)).cast("long")
    return rows.withColumns({"pairs": pairs, "dense": dense, "saving": 1 - pairs / dense, "equivalent": F.floor(F.sqrt(pairs))})


def schema_hashes(questions: DataFrame, case: str, qid: str, fields: list[str]) -> DataFrame:
    """(case, fingerprint) that doesn't depend on the order of questions."""
    each = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in (qid, *fields)]), 256)
    # a fingerprint a question: as many array entries as a request may have questions
    return questions.groupBy(case).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(each)), ""), 256), 1, 32).alias("fingerprint"))


def reply_index(reply: Column, n: Column) -> Column:
    """The label index in a model's reply: its digits, if they name a label."""
    digits = F.regexp_replace(reply, "[^0-9]", "")
    value = digits.try_cast("int")
    return F.when(value < n, value)


def votes_to_dist(replies: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """replies (key, n, reply) to (key, probs): votes plus one; a reply without an index doesn't count.

    Votes are counted by (key, label) before anything is gathered, and a key has at most n labels."""
    counts = replies.groupBy(*key, n, reply_index(F.col("reply"), F.col(n)).alias("_i")).agg(F.count(F.lit(1)).alias("_c"))
    found = counts.groupBy(*key, n).agg(F.map_from_entries(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_c")))).alias("_m"))
    return found.select(*key, V.normalize(F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)) + 1.0)).alias("probs"))


def logprobs_to_dist(tokens: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """tokens (key, n, token, logprob) to (key, probs): a floor plus the probabilities of the tokens that name a label."""
    sums = tokens.groupBy(*key, n, reply_index(F.col("token"), F.col(n)).alias("_i")).agg(F.sum(F.exp("logprob")).alias("_c"))
    found = sums.groupBy(*key, n).agg(F.map_from_entries(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_c")))).alias("_m"))
    return found.select(*key, V.normalize(F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) + UNSEEN)).alias("probs"))


def verbalized_to_dist(text: Column, labels: Column) -> Column:
    """Probabilities stated as a JSON object, floored; text that isn't one gives the uniform distribution."""
    stated = F.from_json(text, "map<string,double>")
    return V.normalize(F.transform(labels, lambda x: F.greatest(F.coalesce(F.try_element_at(stated, x), F.lit(0.0)), F.lit(UNSEEN))))


def letters_to_dist(tokens: DataFrame, key: list[str], order: str = "order") -> DataFrame:
    """tokens (key, order, pos, token, logprob) to (key, probs, declared): first-token letters back in declared order.

    Slot k shows option order[k] under the k-th letter. A letter's first occurrence counts; a
    missing one is one below the least found. Keys without a declared letter are left out."""
    letter = F.trim("token")
    slot = F.ascii(letter) - 65
    good = tokens.where((F.length(letter) == 1) & slot.between(0, F.size(order) - 1))
    first = good.groupBy(*key, order, F.element_at(order, slot + 1).alias("_i")).agg(F.min_by("logprob", "pos").alias("_l"))
    found = first.groupBy(*key, order).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_l"))).alias("_m"), F.min("_l").alias("_lo"), F.sum(F.exp("_l")).alias("declared"))
    logits = F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.coalesce(F.try_element_at("_m", i), F.col("_lo") - 1))
    return found.select(*key, V.softmax(logits).alias("probs"), "declared")


def decision(kind: Column, labels: Column, probs: Column) -> Column:
    """The name of the top label; a yes/no is yes at even odds or better."""
    return F.when(kind == "noul", F.when(F.element_at(probs, 2) >= 0.5, "yes").otherwise("no")).otherwise(F.element_at(labels, V.argmax(probs) + 1))


def recalibrate(probs: Column, served: Column, candidate: Column) -> Column:
    """Undo a served temperature and apply another."""
    return V.softmax(F.transform(probs, lambda p: F.ln(F.greatest(p, F.lit(1e-12))) * served), candidate)


def hard_label(label: Column, distribution: Column, probability: Column) -> Column:
    return F.coalesce(label, V.argmax(distribution), (probability >= 0.5).cast("int"))
