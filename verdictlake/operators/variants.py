"""Perturbed twins of cases: injected, padded, reworded, negated and reshaped. Every draw is keyed by the case.

Cases have case_id, state_text, instructions, options (array of string) and y (int).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let, uniform
from .compare import reorder
from .splits import sample_per_slice


def pick(values: Column, key: Column, salt: str) -> Column:
    return F.element_at(values, F.floor(uniform(key, salt) * F.size(values)).cast("int") + 1)


def texts(templates: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in templates])


def wrong_index(key: Column, salt: str, y: Column, n: Column) -> Column:
    """An index other than ``y``, drawn evenly."""
    return ((y + 1 + F.floor(uniform(key, salt) * (n - 1)).cast("int")) % n).cast("int")


def placed(state: Column, line: Column, before: Column) -> Column:
    return F.when(before, F.concat_ws("\n", line, state)).otherwise(F.concat_ws("\n", state, line))


def inject(cases: DataFrame, templates: list[str]) -> DataFrame:
    """A template ({option}: a wrong one) before or after the text; the label holds."""
    key = F.col("case_id")
    wrong = F.element_at("options", wrong_index(key, "wrong", F.col("y"), F.size("options")) + 1)
    line = F.replace(pick(texts(templates), key, "template"), F.lit("{option}"), wrong)
    return cases.withColumn("state_text", placed(F.col("state_text"), line, uniform(key, "side") < 0.5))


def pad(cases: DataFrame, lines: list[str], k: int) -> DataFrame:
    """``k`` distractor lines, each before or after; later ones go outside of earlier ones."""
    n = F.sequence(F.lit(1), F.lit(k))

    def line(state: Column, i: Column) -> Column:
        key = F.concat_ws("|", F.col("case_id"), i)
        return placed(state, pick(texts(lines), key, "line"), uniform(key, "side") < 0.5)

    return cases.withColumn("state_text", F.aggregate(n, F.col("state_text"), line))


def paraphrase(cases: DataFrame, known: dict[str, str], wrappers: list[str]) -> DataFrame:
    """Known rewordings of the instructions, else a wrapper ({q}: the instructions)."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.lit(None).cast("map<string,string>")
    wrapped = F.replace(pick(texts(wrappers), F.col("case_id"), "wrapper"), F.lit("{q}"), F.col("instructions"))
    return cases.withColumn("instructions", F.coalesce(F.try_element_at(table, F.col("instructions")), wrapped))


def negate(cases: DataFrame, affirm: str, deny: str) -> DataFrame:
    """(pair_id, role, question, p_yes): a claim that names an option, the true one half of the time, and its denial."""
    key = F.col("case_id")
    option = F.when(uniform(key, "true") < 0.5, F.col("y")).otherwise(wrong_index(key, "wrong", F.col("y"), F.size("options")))
    p = (option == F.col("y")).cast("double")
    named = cases.select(key.alias("pair_id"), F.element_at("options", option + 1).alias("_o"), p.alias("_p"))
    sides = F.array(*[F.struct(F.lit(r).alias("role"), F.replace(F.lit(t), F.lit("{option}"), F.col("_o")).alias("question"), q.alias("p_yes")) for r, t, q in (("affirm", affirm, F.col("_p")), ("deny", deny, 1 - F.col("_p")))])
    return named.select("pair_id", F.explode(sides).alias("s")).select("pair_id", "s.*")


def paired_kinds(cases: DataFrame, fraction: float, kinds: list[str]) -> DataFrame:
    """A keyed share of the cases, each with the kind of variant to derive."""
    names = texts(kinds)
    return cases.where(uniform("case_id", "paired") < fraction).withColumn("pair_kind", pick(names, F.col("case_id"), "kind"))


STYLES = {
    "spaces": lambda w: F.array_join(w, " "),
    "snake": lambda w: F.lower(F.array_join(w, "_")),
    "kebab": lambda w: F.lower(F.array_join(w, "-")),
    "title": lambda w: F.array_join(F.transform(w, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), " "),
    "upper": lambda w: F.upper(F.array_join(w, "_")),
    "sentence": lambda w: let(F.lower(F.array_join(w, " ")), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))),
}


def restyle(name: Column, style: Column) -> Column:
    """``name`` in one of the case styles; words part at white space and at _ - . /"""
    words = F.filter(F.split(name, r"[\s_\-./]+"), lambda w: w != "")
    out = name
    for s, f in STYLES.items():
        out = F.when(style == s, f(words)).otherwise(out)
    return F.when(F.length(out) > 0, out).otherwise(name)


def reshape(cases: DataFrame, keep: int, rename: bool = True, criteria_only: bool = False, shuffle: bool = True) -> DataFrame:
    """A keyed subset of ``keep`` options with the true one, in keyed order (declared order unless ``shuffle``), renamed in a keyed style; y and distribution follow.

    Names that would collide stay as declared. With ``criteria_only`` options become numbered ids and their names the criteria."""
    key = lambda i, salt: uniform(F.concat_ws("|", F.col("case_id"), i), salt)
    ranked = F.array_sort(F.transform("options", lambda o, i: F.struct(F.when(i == F.col("y"), -1.0).otherwise(key(i, "keep")).alias("u"), i.alias("i"))))
    kept = F.array_sort(F.transform(F.slice(ranked, 1, keep), lambda s: F.struct((key(s["i"], "order") if shuffle else s["i"].cast("double")).alias("u"), s["i"].alias("i"))))
    out = cases.withColumn("_kept", F.transform(kept, lambda s: s["i"]))
    names = F.transform("_kept", lambda i: F.element_at("options", i + 1))
    styled = F.transform("_kept", lambda i: restyle(F.element_at("options", i + 1), pick(texts(list(STYLES)), F.concat_ws("|", F.col("case_id"), i), "style"))) if rename else names
    out = out.withColumn("_names", let(styled, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), s).otherwise(names)))
    if "distribution" in cases.columns:
        mass = F.transform("_kept", lambda i: F.element_at("distribution", i + 1))
        sums = lambda m: F.aggregate(m, F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("distribution", let(mass, lambda m: F.when(sums(m) > 0, F.transform(m, lambda v: v / sums(m)))))
    if criteria_only:
        out = out.withColumns({"criteria": names, "_names": F.transform("_kept", lambda i, k: F.concat(F.lit("option_"), F.lpad((k + 1).cast("string"), F.length(F.size("_kept").cast("string")), F.lit("0"))))})
    return out.withColumns({"y": (F.array_position("_kept", F.col("y")) - 1).cast("int"), "options": F.col("_names")}).drop("_kept", "_names")


@dataclass(frozen=True)
class Task:
    """One slice of a suite: whose cases it asks and how they are shown; without ``keep`` as they were declared."""

    name: str
    corpus: str
    keep: int | None = None
    shuffle: bool = True
    rename: bool = False
    #: shown once more in an order of its own, to be joined by case with the task of the same draw and options
    reorder: bool = False


def build_tasks(cases: DataFrame, tasks: list[Task], n: int = 1000, salt: str = "suite") -> DataFrame:
    """cases (corpus, case_id, options, y) to the cases of every task, with a task column.

    A corpus is drawn once, ``n`` cases by a keyed rank, and serves all its tasks: a case has one id in each of them, and the
    same options wherever as many are kept, so answers to two tasks join by case."""
    drawn = sample_per_slice(cases, ["corpus"], "case_id", n, salt)
    out: DataFrame | None = None
    for t in tasks:
        rows = drawn.where(F.col("corpus") == t.corpus)
        if t.keep is not None:
            rows = reshape(rows, t.keep, t.rename, shuffle=t.shuffle)
        if t.reorder:
            rows = reorder(rows, salt=f"{salt} order")
        rows = rows.select(F.lit(t.name).alias("task"), *cases.columns)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a suite has one task at least")
    return out


def accuracy_by_tag(outcomes: DataFrame, prefix: str) -> DataFrame:
    """outcomes (tags, correct) to (value, n, accuracy) of the tags ``prefix=value``."""
    tag = outcomes.select("correct", F.explode("tags").alias("tag")).where(F.col("tag").startswith(prefix + "="))
    return tag.groupBy(F.substring_index("tag", "=", -1).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))


def rot(by_value: DataFrame) -> DataFrame:
    """One row: accuracy lost between the least and the greatest numeric value."""
    v = F.col("value").cast("double")
    return by_value.agg((F.min_by("accuracy", v) - F.max_by("accuracy", v)).alias("rot"))


def ambiguity(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return outcomes.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg((F.col("confidence") > 0.5).cast("double")).alias("confident"))


def within_case_gap(outcomes: DataFrame, first: str, second: str, total: float = 1.0) -> DataFrame:
    """outcomes (case_id, qid, p) to the mean, largest and small share of ``|p(first) + p(second) - total|`` over cases with both."""
    each = outcomes.where(F.col("qid").isin(first, second)).groupBy("case_id").agg(F.max(F.when(F.col("qid") == first, F.col("p"))).alias("a"), F.max(F.when(F.col("qid") == second, F.col("p"))).alias("b"))
    gap = each.where("a is not null and b is not null").select(F.abs(F.col("a") + F.col("b") - total).alias("gap"))
    return gap.agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.avg((F.col("gap") <= 0.05).cast("double")).alias("coherent"))
