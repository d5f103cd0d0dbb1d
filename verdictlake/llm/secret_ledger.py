"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a path is content-addressed by the SHA-256 of its text. The ledger is three
Parquet tables: ``texts`` has each blob's text once, ``versions`` each path with each blob it
ever had and the scan that first saw it, ``blobs`` for each blob the rule versions that have
seen it and what they found. A scan appends the new texts and versions, takes the pairs of
blob and rule version that the ledger lacks, whichever scan brought the blob, reads the texts
of those alone, appends the findings, and joins the findings of all versions back to every
path: ``scan`` to the rows at hand, ``history`` to all that any scan has seen. So a rule that
is added later reaches every version ever stored, and what a scan that broke off has left
undone is pending for the next one. ``history`` tells unscanned from clean: findings are null
where a rule asked for hasn't seen the blob.

A rule is a regular expression whose leftmost non-overlapping matches count; a match
whose part ``group`` is shorter than ``least`` is dropped after matching. Offsets are
code points, end exclusive. Matches leave the text as lengths, one row each; their places
are running sums within a text.

Edge cases: a null text counts as empty; a path may come any number of times, with the
same or other texts, and every row gets its own findings; a null path is kept; an empty
table gives an empty result; extra columns pass through, a clash with ``blob`` or
``findings`` is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stage, release, require_free, stage

FINDINGS = "array<struct<start:int,rank:int,kind:string,end:int,rule:string>>"
BLOBS = f"blob string, rules array<string>, findings {FINDINGS}"
VERSIONS = "path string, blob string, scan int"
TEXTS = "blob string, content string"
#: so many blobs, of 64 characters each, are broadcast at most
FEW_BLOBS = 50_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the three base patterns come first and keep their order
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    # these two match whole runs, so a shorter run has no match within and the least length can be part of the pattern
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    # a match starts a run of its characters, and no run is given back: else every "eyJ" in a run would read on to its end
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 40),
)
RULES = BASE + EXTRA


def rule_matches(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's matches in ``text`` as lengths: (rank, place, whole, between, part), whole being the text between two matches and the match."""
    # each step of the anchored pattern takes what lies between two matches and the match
    pattern = F.lit(rf"(?s)\G(.*?)({rule.pattern})")
    parts = [F.transform(F.regexp_extract_all(text, pattern, F.lit(g)), F.length) for g in (0, 1, 2 + rule.group)]
    steps = F.arrays_zip(*[x.alias(n) for x, n in zip(parts, ("whole", "between", "part"))])
    found = F.transform(steps, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("place"), x["whole"].alias("whole"), x["between"].alias("between"), x["part"].alias("part")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(MATCHES))


MATCHES = "array<struct<rank:int,place:int,whole:int,between:int,part:int>>"


class BlobLedger:
    """The ledger kept at ``path``, a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], BLOBS).write.mode("append").parquet(f"{path}/blobs")
        spark.createDataFrame([], VERSIONS).write.mode("append").parquet(f"{path}/versions")
        spark.createDataFrame([], TEXTS).write.mode("append").parquet(f"{path}/texts")

    def seen(self) -> DataFrame:
        return self.spark.read.schema(BLOBS).parquet(f"{self.path}/blobs")

    def versions(self) -> DataFrame:
        """(path, blob, scan): every blob that a path ever had, and the number of the scan that saw it first."""
        return self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions")

    def texts(self) -> DataFrame:
        """(blob, content): the text of every blob."""
        return self.spark.read.schema(TEXTS).parquet(f"{self.path}/texts")

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, findings) of the blobs with findings of these rule versions, by start, then rule order."""
        keys = [r.key for r in rules]
        wanted = F.filter(F.flatten(F.collect_list("findings")), lambda x: x["rule"].isin(keys))
        return self.seen().where(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(wanted)).alias("findings"))

    def rules_seen(self) -> DataFrame:
        """(blob, done): the rule versions that have seen each blob."""
        return self.seen().groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("done"))

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(path, blob, scan, rules, findings) of every version of every path, also of those that later scans don't have.

        ``rules`` are the versions asked for that have seen the blob; where one is missing, ``findings`` is null: what it would find isn't known."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        every = self.versions().join(self.rules_seen(), "blob", "left").join(self.findings(rules), "blob", "left")
        seen = F.array_intersect(keys, F.coalesce("done", F.array().cast("array<string>")))
        known = F.when(F.size(seen) == len(rules), F.coalesce("findings", F.array().cast(FINDINGS)))
        return every.select("path", "blob", "scan", seen.alias("rules"), known.alias("findings"))

    def pending(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, todo) for each blob of the ledger that some rule version hasn't seen."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        todo = F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))
        every = self.texts().select("blob").distinct()
        return every.join(self.rules_seen(), "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)

    def scan(self, df: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The rows of ``df`` without their text, with blob and findings (of ``rules``, by start, then rule order)."""
        rest = [c for c in df.columns if c != text]
        require_free(df.select(*rest), ["blob", "findings"])
        content = F.coalesce(F.col(text), F.lit(""))
        rows = df.withColumn("blob", F.sha2(content.cast("binary"), 256))
        self._store(rows.select("blob", content.alias("content")))
        self._record(rows.select(F.col(path).cast("string").alias("path"), "blob"))
        release(self.spark)
        todo = stage(self.pending(rules), "pending")
        n = todo.count()
        if n:
            texts = self.texts()
            if n <= FEW_BLOBS:
                texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
            self._find(texts.join(todo, "blob"), rules)
        drop_stage(self.spark, todo)
        return rows.select(*rest, "blob").join(self.findings(rules), "blob", "left").select(*rest, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))

    def _store(self, now: DataFrame) -> None:
        """Append the texts that the ledger hasn't got, once each; texts that it has don't leave the map side."""
        fresh = stage(now.select("blob").distinct().join(self.texts().select("blob"), "blob", "left_anti"), "fresh")
        n = fresh.count()
        if n:
            new = now.join(F.broadcast(fresh) if n <= FEW_BLOBS else fresh, "blob", "left_semi")
            new.groupBy("blob").agg(F.first("content").alias("content")).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/texts")
        drop_stage(self.spark, fresh)

    def _record(self, now: DataFrame) -> None:
        known = self.versions()
        number = known.agg(F.coalesce(F.max("scan") + 1, F.lit(1))).first()[0]
        same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob"))
        fresh = now.distinct().join(known.select(F.col("path").alias("_path"), F.col("blob").alias("_blob")), same, "left_anti")
        fresh.select("path", "blob", F.lit(number).alias("scan")).write.mode("append").parquet(f"{self.path}/versions")

    def _find(self, unseen: DataFrame, rules: tuple[Rule, ...]) -> None:
        """Append what the rules of ``todo`` find in the texts of (blob, content, todo)."""
        none = F.array().cast(MATCHES)
        each = [F.when(F.array_contains("todo", r.key), rule_matches(F.col("content"), r, k)).otherwise(none) for k, r in enumerate(rules)]
        # an array's element of rank -1 keeps the blobs without a match, so texts are read once
        mark = F.array(F.struct(F.lit(-1).alias("rank"), *[F.lit(0).alias(n) for n in ("place", "whole", "between", "part")]))
        matches = unseen.select("blob", "todo", F.explode(F.concat(mark, *each)).alias("m")).select("blob", "todo", "m.*")
        so_far = Window.partitionBy("blob", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum("whole").over(so_far).cast("int")

        def pick(name: str) -> Column:
            return F.element_at(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.greatest(F.col("rank"), F.lit(0)) + 1)

        finding = F.struct((F.col("end") - F.col("whole") + F.col("between")).alias("start"), "rank", pick("kind").alias("kind"), "end", pick("key").alias("rule"))
        placed = matches.withColumn("end", end).withColumn("f", F.when((F.col("rank") >= 0) & (F.col("part") >= pick("least")), finding))
        placed.groupBy("blob").agg(F.first("todo").alias("rules"), F.array_sort(F.collect_list("f")).alias("findings")).write.mode("append").parquet(f"{self.path}/blobs")
