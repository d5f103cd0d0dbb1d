"""Loaders of single corpus layouts: annotated tokens, multiple choice, yes/no templates, wire questions and page elements."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import uniform
from .variants import pick, texts

# fixed values: attributes that name an element, and the lengths of labels
LABEL_ATTRS = ("aria_label", "aria-label", "placeholder", "title", "alt", "value", "name", "type")
TEXTS, LABEL = 12, 90
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def token_votes(tokens: DataFrame, key: list[str], votes: str, raters: str) -> DataFrame:
    """tokens (key, pos, token, votes, raters) to (key, start, end): runs of tokens that most raters marked, as offsets in the text of tokens joined by a space."""
    order = Window.partitionBy(*key).orderBy("pos")
    placed = tokens.withColumn("start", F.coalesce(F.sum(F.length("token") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marked = placed.withColumns({"end": F.col("start") + F.length("token"), "_seq": F.row_number().over(order)}).where(F.col(votes) * 2 > F.col(raters))
    runs = marked.withColumn("_g", F.col("_seq") - F.row_number().over(order))
    return runs.groupBy(*key, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def majority_of(ratings: DataFrame, key: list[str], label: str) -> DataFrame:
    """(key, y, n): the label of more than half of the raters; items without one are dropped."""
    counts = ratings.groupBy(*key, label).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(*key).agg(F.max_by(label, "_c").alias("y"), F.max("_c").alias("_m"), F.sum("_c").alias("n"))
    return best.where(F.col("_m") * 2 > F.col("n")).select(*key, "y", "n")


def own_question(question: Column) -> Column:
    """The corpus's question as an instruction: a capital first, a question mark last."""
    q = F.rtrim(question)
    return F.concat(F.upper(F.substring(q, 1, 1)), F.substring(q, 2, 1 << 20), F.when(q.endswith("?"), "").otherwise("?"))


def nli_noul(df: DataFrame, key: str, label: Column, templates: list[tuple[str, str]]) -> DataFrame:
    """A keyed template (text, the label it asks for) for each pair; y says whether the label is that one."""
    t = F.array(*[F.struct(F.lit(q).alias("text"), F.lit(x).alias("asks")) for q, x in templates])
    chosen = F.element_at(t, F.floor(uniform(key, "nli") * len(templates)).cast("int") + 1)
    return df.withColumn("_t", chosen).withColumns({"question": F.col("_t.text"), "y": (label == F.col("_t.asks")).cast("int")}).drop("_t")


def text_noul(df: DataFrame, key: str, text: str, positive: Column, questions: list[str], fields: list[str]) -> DataFrame:
    """(key, question, state_json, y): a keyed phrasing, and the text under a keyed field name."""
    k = F.col(key)
    state = F.to_json(F.map_from_arrays(F.array(pick(texts(fields), k, "field")), F.array(F.col(text))))
    return df.select(key, pick(texts(questions), k, "phrase").alias("question"), state.alias("state_json"), positive.cast("int").alias("y"))


def two_questions(df: DataFrame, key: str, prompt: Column, response: Column, redacted: str = "REDACTED") -> DataFrame:
    """(key, qid, y): the prompt's label always, the response's where it is given; redacted rows are dropped."""
    rows = df.where(F.coalesce(F.col("text") != redacted, F.lit(False)))
    pair = F.array(F.struct(F.lit("prompt").alias("qid"), prompt.alias("y")), F.struct(F.lit("response").alias("qid"), response.alias("y")))
    return rows.select(key, F.explode(pair).alias("q")).select(key, "q.*").where("y is not null")


def multiple_choice(df: DataFrame, key: str, options: Column, answer: Column) -> DataFrame:
    """(key, options: a, b.. , criteria, y) from an array of texts and the answer's letter or index; other answers are dropped."""
    y = F.when(answer.rlike("^[A-Za-z]$"), F.ascii(F.upper(answer)) - 65).otherwise(answer.try_cast("int"))
    names = F.transform(options, lambda o, i: F.char(i + 97))
    return df.select(key, names.alias("options"), options.alias("criteria"), y.cast("int").alias("y")).where((F.col("y") >= 0) & (F.col("y") < F.size("options")))


def add_known_question(cases: DataFrame, flags: DataFrame, key: str, qid: str) -> DataFrame:
    """cases (key, qid, y) and one more question for each case that has a flag (key, flag)."""
    known = cases.select(key).distinct().join(flags.where("flag is not null"), key).select(key, F.lit(qid).alias("qid"), F.col("flag").cast("int").alias("y"))
    return cases.select(key, "qid", "y").unionByName(known)


def examples(cases: DataFrame, teacher_weight: float) -> DataFrame:
    """(case_id, qid, prompt, candidates, target, weight) of labelled questions; a teacher's yes/no has its own weight, and weight zero drops the row."""
    prompt = F.concat_ws("\n\n", "state_text", "instructions")
    target = F.coalesce(F.col("distribution"), F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: F.when(i == F.col("y"), 1.0).otherwise(0.0)))
    weight = F.when(F.col("from_teacher") & (F.col("kind") == "noul"), teacher_weight).otherwise(1.0)
    return cases.where("y is not null").select("case_id", "qid", prompt.alias("prompt"), F.col("options").alias("candidates"), target.alias("target"), weight.alias("weight")).where("weight > 0")


WIRE = "map<string,struct<type:string,instructions:string,criteria:string>>"


def to_native(requests: DataFrame, key: str, questions: str) -> DataFrame:
    """(key, qid, kind, instructions, options, reason) from another contract's questions as JSON.

    A Choice's criteria are an object of options, a Score's an array of levels named by index, a yes/no's are
    folded into its instructions. A question that the contract refuses has a reason and no options."""
    asked = requests.select(key, F.explode_outer(F.from_json(questions, WIRE)).alias("qid", "q")).select(key, "qid", "q.*")
    named = F.from_json("criteria", "map<string,string>")
    levels = F.from_json("criteria", "array<string>")
    folded = F.concat_ws("\n", "instructions", *[F.concat(F.lit(f"Counts as {k}: "), F.try_element_at(named, F.lit(k))) for k in ("true", "false")])
    kind = F.col("type")
    rules = [
        ("no questions", F.col("qid").isNull()),
        ("unknown type", kind.isNull() | ~kind.isin("noul", "choice", "score")),
        ("no instructions", F.col("instructions").isNull()),
        ("criteria must be an object", (kind == "choice") & F.coalesce(F.size(named) < 1, F.lit(True))),
        ("criteria must be an array", (kind == "score") & (~F.coalesce(F.col("criteria").startswith("["), F.lit(False)) | F.coalesce(F.size(levels) < 1, F.lit(True)))),
        ("criteria must be an object", (kind == "noul") & F.col("criteria").isNotNull() & ~F.col("criteria").startswith("{")),
    ]
    reason = F.coalesce(*[F.when(c, n) for n, c in rules])
    options = F.when(kind == "choice", F.map_keys(named)).when(kind == "score", F.transform(levels, lambda x, i: i.cast("string"))).otherwise(F.array(F.lit("no"), F.lit("yes")))
    return asked.select(key, "qid", kind.alias("kind"), F.when(kind == "noul", folded).otherwise(F.col("instructions")).alias("instructions"), F.when(reason.isNull(), options).alias("options"), reason.alias("reason"))


def restore_levels(answers: DataFrame, probs: str, names: str) -> DataFrame:
    """Index-named level probabilities (a map) with the names of the levels back."""
    return answers.withColumn(probs, F.transform_keys(probs, lambda k, v: F.element_at(names, k.cast("int") + 1)))


OPEN, CLOSE, TEXT = range(3)


def page_tokens(html: str) -> list[tuple[int, str, dict[str, str]]]:
    """A page as one flat list of start tags with their attributes, end tags and texts with their white space folded."""
    out: list[tuple[int, str, dict[str, str]]] = []
    parser = HTMLParser(convert_charrefs=True)
    parser.handle_starttag = lambda tag, attrs: out.append((OPEN, tag, {k: v or "" for k, v in attrs}))
    parser.handle_endtag = lambda tag: out.append((CLOSE, tag, {}))
    parser.handle_data = lambda data: out.append((TEXT, " ".join(data.split()), {}))
    parser.feed(html)
    parser.close()
    return [t for t in out if t[0] != TEXT or t[1]]


def elements_of(html: str) -> list[tuple[str, dict[str, str], list[str]]]:
    """(tag, attributes, first texts below) of a page's elements in order.

    Texts are numbered as they come, and an element owns those between its start and the tag that closes it, which for an
    element left open is that of an element around it, or the page's end. So a text is stored once, however deep it lies."""
    texts: list[str] = []
    ranges: list[list[int]] = []
    heads: list[tuple[str, dict[str, str]]] = []
    pending: list[int] = []
    waiting: Counter[str] = Counter()
    for kind, value, attributes in page_tokens(html):
        if kind == TEXT:
            texts.append(value)
        elif kind == OPEN:
            ranges.append([len(texts), len(texts) if value in VOID else -1])
            if value not in VOID:
                pending.append(len(heads))
                waiting[value] += 1
            heads.append((value, attributes))
        elif waiting[value]:
            closed = ""
            while closed != value:
                place = pending.pop()
                closed = heads[place][0]
                waiting[closed] -= 1
                ranges[place][1] = len(texts)
    return [(tag, attributes, texts[a : min(b if b >= 0 else len(texts), a + TEXTS)]) for (tag, attributes), (a, b) in zip(heads, ranges)]


def page_elements(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, node, tag, label) of every element of every page; a null page has none.

    A label is the tag, the role, the first texts below and naming attributes, cut at 90 characters."""
    schema = f"`{key}` {dict(pages.dtypes)[key]}, node int, tag string, label string"

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[html]):
                for node, (tag, attrs, words) in enumerate(elements_of(text or "")):
                    parts = [tag, attrs.get("role", ""), " ".join(words), *(f'{a}="{attrs[a]}"' for a in LABEL_ATTRS if attrs.get(a))]
                    rows.append((k, node, tag, " ".join(p for p in parts if p)[:LABEL]))
            yield pd.DataFrame(rows, columns=[key, "node", "tag", "label"])

    return pages.select(key, html).mapInPandas(parse, schema)


def step_history(actions: DataFrame, task: str, pos: str, text: str, last: int = 5) -> DataFrame:
    """Each action with the texts of the ``last`` before it in its task, oldest first."""
    before = Window.partitionBy(task).orderBy(pos).rowsBetween(-last, -1)
    return actions.withColumn("history", F.collect_list(text).over(before))


def step_candidates(elements: DataFrame, step: str, operation: str, n: int, salt: str = "candidates") -> DataFrame:
    """elements (step, node, operation, is_target) to at most ``n`` a step and operation: the target first, the rest by a keyed draw, shown in a keyed order."""
    draw = lambda s: uniform(F.concat_ws("|", step, "node"), f"{salt}-{s}")
    order = Window.partitionBy(step, operation).orderBy(F.desc("is_target"), draw("keep"), "node")
    kept = elements.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(step, operation).orderBy(draw("show"), "node")) - 1)


# fixed values: what each tier of a licence permits
PERMITS = {"green": ("train", "eval", "redistribute"), "amber": ("eval",), "red": ()}


def permits(corpora: DataFrame, purpose: str) -> DataFrame:
    """corpora (name, tier, licence) with whether ``purpose`` is permitted; share-alike licences permit evaluation alone, whatever their tier."""
    if purpose not in PERMITS["green"]:
        raise ValueError(purpose)
    plain = F.upper(F.replace("licence", F.lit("\u2011"), F.lit("-")))
    alike = plain.contains("BY-SA") | F.replace(plain, F.lit(" "), F.lit("")).contains("SHAREALIKE")
    tier = F.col("tier").isin([t for t, may in PERMITS.items() if purpose in may])
    return corpora.withColumn("permitted", F.coalesce(F.when(alike, tier & F.lit(purpose == "eval")).otherwise(tier), F.lit(False)))


def permitted(cases: DataFrame, corpora: DataFrame, corpus: str, purpose: str) -> DataFrame:
    """``cases``, with an error at run time if a row's corpus doesn't permit the purpose."""
    may = permits(corpora, purpose).select(F.col("name").alias("_name"), "permitted")
    told = F.raise_error(F.concat(F.lit(f"not permitted for {purpose}: "), F.col(corpus)))
    joined = cases.join(F.broadcast(may), F.col(corpus) == F.col("_name"), "left")
    return joined.where(F.when(F.coalesce("permitted", F.lit(False)), True).otherwise(told.cast("boolean"))).select(*cases.columns)


def any_mark(groups: dict[str, list[str]]) -> dict[str, Column]:
    """Yes (1) if a column of the group is marked, no (0) if none is, null if a mark is unreadable."""
    out = {}
    for name, columns in groups.items():
        marks = [F.trim(F.col(c).cast("string")) for c in columns]
        valid = F.array(*[F.coalesce(m.isin("0", "1", "0.0", "1.0", "True", "False", "true", "false"), F.lit(False)) for m in marks])
        marked = F.array(*[F.coalesce(m.isin("1", "1.0", "True", "true"), F.lit(False)) for m in marks])
        out[name] = F.when(F.forall(valid, lambda v: v), F.exists(marked, lambda v: v).cast("int"))
    return out


def intent_cases(rows: DataFrame, labels_from: Column, text: str, label: str) -> DataFrame:
    """Rows as one Choice over the sorted labels of the rows where ``labels_from`` holds; rows of other labels (out of scope) are left out."""
    options = rows.where(labels_from).agg(F.array_sort(F.collect_set(label)).alias("options"))
    named = rows.crossJoin(F.broadcast(options)).withColumn("y", (F.array_position("options", F.col(label)) - 1).cast("int")).where("y >= 0")
    return named.withColumnRenamed(text, "state_text").drop(label)


def intent_doc(doc: DataFrame, splits: list[str], text: str = "text", label: str = "label") -> DataFrame:
    """One object of arrays of [text, label] to (split, text, label)."""
    parts = [doc.select(F.lit(s).alias("split"), F.explode(s).alias("_p")) for s in splits]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select("split", F.col("_p")[0].alias(text), F.col("_p")[1].alias(label))


def step_targets(candidates: DataFrame, step: str, fits: dict[str, Column]) -> DataFrame:
    """candidates (step, node, place, operation: the step's, is_target) to (step, head, names, y): one target question for each operation
    that two candidates fit, y where the head is the step's own; steps of fewer than two operations, or whose own head has one name, are dropped."""
    heads = F.array_compact(F.array(*[F.when(c | (F.col("is_target") & (F.col("operation") == op)), op) for op, c in fits.items()]))
    each = candidates.select(step, "operation", "place", "is_target", F.explode(heads).alias("head"))
    grouped = each.groupBy(step, "operation", "head").agg(F.array_sort(F.collect_list(F.struct("place", "is_target"))).alias("_c"))
    names = F.transform("_c", lambda x: (x["place"] + 1).cast("string"))
    y = F.when(F.col("head") == F.col("operation"), F.nullif(F.array_position(F.transform("_c", lambda x: x["is_target"]), True), F.lit(0).cast("long")) - 1)
    known = grouped.groupBy(step).agg(F.count(F.lit(1)).alias("_ops"), F.max(F.when(F.col("head") == F.col("operation"), F.size("_c"))).alias("_own")).where("_ops >= 2 and _own >= 2")
    return grouped.join(known, step).where(F.size("_c") >= 2).select(step, "head", names.alias("names"), y.cast("int").alias("y"))


def from_native(answers: DataFrame) -> Column:
    """The other contract's answer as JSON, from kind, labels, probs, selected, score, confidence and criteria (of levels)."""
    probabilities = F.map_from_arrays("labels", "probs")
    legend = F.map_from_arrays("labels", F.transform("criteria", lambda c: F.coalesce(c, F.lit(""))))
    kind = F.col("kind")
    return (
        F.when(kind == "noul", F.to_json(F.struct(kind.alias("type"), F.element_at("probs", 2).alias("noul"))))
        .when(kind == "choice", F.to_json(F.struct(kind.alias("type"), F.col("selected").alias("choice"), "confidence", probabilities.alias("probabilities"))))
        .when(kind == "score", F.to_json(F.struct(kind.alias("type"), "score", "confidence", legend.alias("legend"), probabilities.alias("probabilities"))))
    )


def to_compat(kind: Column, instructions: Column, names: Column, criteria: Column) -> Column:
    """A native question as the other contract's JSON: levels go out as an array and are known by index there, a missing criterion is the name."""
    told = F.zip_with(names, criteria, lambda n, c: F.when(F.length(c) > 0, c).otherwise(n))
    head = [kind.alias("type"), instructions.alias("instructions")]
    both = F.create_map(F.lit("true"), F.lit("Yes"), F.lit("false"), F.lit("No"))
    return F.when(kind == "noul", F.to_json(F.struct(*head, both.alias("criteria")))).when(kind == "choice", F.to_json(F.struct(*head, F.map_from_arrays(names, told).alias("criteria")))).when(kind == "score", F.to_json(F.struct(*head, told.alias("criteria"))))


WIRE_ANSWER = "type string, noul double, choice string, score double, confidence double, probabilities map<string,double>"


def answer_to_native(answers: DataFrame, body: str, names: str) -> DataFrame:
    """Add kind, selected, score, probability and probabilities of an answer in the other contract; a Score's levels get their names back."""
    a = F.from_json(body, WIRE_ANSWER)
    levels = F.map_from_entries(F.transform(F.filter(F.map_entries("_a.probabilities"), lambda e: e["key"].rlike("^[0-9]+$") & (e["key"].try_cast("int") < F.size(names))), lambda e: F.struct(F.element_at(names, e["key"].cast("int") + 1).alias("key"), e["value"].alias("value"))))
    out = answers.withColumn("_a", a).withColumn("probabilities", F.when(F.col("_a.type") == "score", levels).otherwise(F.col("_a.probabilities")))
    ranked = F.array_sort(F.transform(F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return out.withColumns({"kind": F.col("_a.type"), "probability": F.col("_a.noul"), "score": F.col("_a.score"), "selected": F.when(F.col("_a.type") == "choice", F.col("_a.choice")).when(F.col("_a.type") == "score", F.try_element_at(ranked, F.lit(1))["k"])}).drop("_a")
