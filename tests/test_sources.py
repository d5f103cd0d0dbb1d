"""Scans, pins, alignment by position, registries and report sinks on files as corpora have them."""

import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verdictlake.operators import cases, loaders, splits
from verdictlake.sources import records


def put(path, text, packed=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode(), mtime=0) if packed else text.encode())
    return str(path)


def test_labelled_text_takes_options_from_all_splits(spark, tmp_path):
    a = put(tmp_path / "train.csv", 'text,category\n"a, b",card_lost\nc,top_up\n\n')
    b = put(tmp_path / "test.csv", "text,category\nd,card_lost\ne,exchange_rate\n")
    rows = records.read_records(spark, [a], "text string, category string").withColumn("split", F.lit("train")).unionByName(records.read_records(spark, [b], "text string, category string").withColumn("split", F.lit("test")))
    got = {r.state_text: (r.options[r.y], len(r.options)) for r in cases.text_choice_cases(rows, "text", "category", "split").collect()}
    assert got == {"a, b": ("card lost", 3), "c": ("top up", 3), "d": ("card lost", 3), "e": ("exchange rate", 3)}


def test_ratings_out_of_range_drop_the_row(spark, tmp_path):
    lines = [{"prompt": "p", "a": 3, "b": 4}, {"prompt": "q", "a": 9, "b": 1}, {"prompt": "r", "a": 2}]
    path = put(tmp_path / "x.jsonl.gz", "\n".join(map(json.dumps, lines)) + "\n\n", True)
    df = records.read_records(spark, [path], "prompt string, a int, b int")
    assert sorted((r.qid, r.y) for r in cases.score_cases(df, ["prompt"], ["a", "b"], 5).collect()) == [("a", 3), ("b", 4)]


def test_several_files_are_one_pool(spark, tmp_path):
    paths = [put(tmp_path / f"{k}.tsv", f"id\ttext\n{k}\tone\n") for k in range(3)]
    assert sorted(r.id for r in records.read_records(spark, paths, "id int, text string").collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        records.read_records(spark, ["x.xml"], "a int")


def test_rater_rows_with_grouped_marks(spark, tmp_path):
    text = "text,id,rater_id,unclear,joy,love,anger\nt,1,1,0,1,0,0\nt,1,2,0,0,0,0\nt,1,3,1,0,0,1\nu,2,1,0,x,1,0\n"
    df = records.read_records(spark, [put(tmp_path / "r.csv", text)], "text string, id int, rater_id int, unclear string, joy string, love string, anger string")
    marks = loaders.any_mark({"glad": ["joy", "love"], "cross": ["anger"]})
    got = {(r.id, r.rater_id): (r.glad, r.cross) for r in df.select("id", "rater_id", *[c.alias(n) for n, c in marks.items()]).collect()}
    assert got == {(1, 1): (1, 0), (1, 2): (0, 0), (1, 3): (0, 1), (2, 1): (None, 0)}


def test_json_documents(spark, tmp_path):
    rows = put(tmp_path / "a.json", json.dumps([{"id": 1, "text": "REDACTED", "p": "safe", "r": None}, {"id": 2, "text": "t", "p": "unsafe", "r": None}, {"id": 3, "text": "t", "p": "safe", "r": "unsafe"}]))
    df = records.read_json_doc(spark, rows, "id int, text string, p string, r string")
    bad = lambda c: (F.col(c) == "unsafe").cast("int")
    assert sorted((r.id, r.qid, r.y) for r in loaders.two_questions(df, "id", bad("p"), bad("r")).collect()) == [(2, "prompt", 1), (3, "prompt", 0), (3, "response", 1)]
    doc = put(tmp_path / "c.json", json.dumps({"train": [["book it", "book_flight"], ["pay", "pay_bill"]], "val": [["hm", "pay_bill"]], "oos_train": [["?", "oos"]]}))
    intents = loaders.intent_doc(records.read_json_doc(spark, doc, "train array<array<string>>, val array<array<string>>, oos_train array<array<string>>"), ["train", "val", "oos_train"])
    got = sorted((r.split, r.state_text, r.y) for r in loaders.intent_cases(intents, F.col("split") == "train", "text", "label").collect())
    assert got == [("train", "book it", 0), ("train", "pay", 1), ("val", "hm", 1)]


def test_licences(spark):
    corpora = spark.createDataFrame([("a", "green", "MIT"), ("b", "green", "CC BY‑SA 4.0"), ("c", "amber", "x"), ("d", "red", "y"), ("e", "green", "Share Alike 1")], "name string, tier string, licence string")
    may = {p: {r["name"] for r in loaders.permits(corpora, p).where("permitted").collect()} for p in ("train", "eval", "redistribute")}
    assert may == {"train": {"a"}, "eval": {"a", "b", "c", "e"}, "redistribute": {"a"}}
    rows = spark.createDataFrame([("a",), ("b",)], "corpus string")
    assert loaders.permitted(rows, corpora, "corpus", "eval").count() == 2
    with pytest.raises(PySparkException, match="not permitted for train: b"):
        loaders.permitted(rows, corpora, "corpus", "train").collect()
    with pytest.raises(ValueError):
        loaders.permits(corpora, "sell")


def test_pins_and_conversion(spark, tmp_path):
    path = put(tmp_path / "in/a.csv", "x\n1\n")
    put(tmp_path / "in/b.csv", "x\n2\n")
    good = hashlib.sha256(b"x\n1\n").hexdigest()
    pins = spark.createDataFrame([("a.csv", good), ("b.csv", good)], "file string, sha256 string")
    assert [r.file for r in records.verify_pins(spark, str(tmp_path / "in"), pins).collect()] == ["b.csv"] and path
    df = spark.createDataFrame([(1, float("nan"), "u"), (2, 0.5, "v")], "k int, v double, w string")
    records.convert(df, ["k", "v"], f"{tmp_path}/out")
    assert sorted(map(tuple, spark.read.schema("k int, v double").json(f"{tmp_path}/out").collect()), key=str) == [(1, None), (2, 0.5)]
    with pytest.raises(ValueError, match="missing"):
        records.convert(df, ["z"], f"{tmp_path}/no")


def test_alignment_by_position(spark, tmp_path):
    a = put(tmp_path / "a.jsonl", "\n".join(json.dumps({"q": i}) for i in range(500)) + "\n\n")
    b = put(tmp_path / "b.jsonl", "\n\n".join(json.dumps({"y": 2 * i}) for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = records.read_aligned(spark, a, b, "q int", "y int").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 500 and all(r.y == 2 * r.q and r.pos == r.q for r in got)
    short = put(tmp_path / "c.jsonl", '{"y": 1}\n')
    with pytest.raises(PySparkException, match="differ in number"):
        records.read_aligned(spark, a, short, "q int", "y int").collect()


def test_runs_answers_and_shards(spark, tmp_path):
    gate = lambda n, ok, adv=False: {"name": n, "value": 0.1, "limit": 0.05, "passed": ok, "advisory": adv}
    put(tmp_path / "runs/s1.json", json.dumps({"seed": 1, "final_loss": 0.5, "passed": True, "gates": [gate("a", True), gate("b", False, True)]}, indent=1))
    put(tmp_path / "runs/s2.json", json.dumps({"seed": 2, "final_loss": 0.7, "passed": False, "gates": [gate("a", False)]}))
    runs, gates = records.read_runs(spark, f"{tmp_path}/runs")
    assert {r.seed: (r.passed, r.blocked) for r in runs.collect()} == {1: (True, []), 2: (False, ["a"])} and gates.count() == 3
    for k in ("c 1", "c2"):
        put(tmp_path / f"raw/{k}.json", json.dumps({"p": 0.5}, indent=2))
    saved = records.read_answers(spark, f"{tmp_path}/raw", "p double")
    assert sorted(r.case_id for r in saved.collect()) == ["c 1", "c2"]
    asked = spark.createDataFrame([("c2",), ("c3",)], "case_id string")
    assert [r.case_id for r in splits.pending(asked, saved, "case_id").collect()] == ["c3"]
    for k in (2, 0, 1):
        put(tmp_path / f"shards/shard-{k}.jsonl.gz", "".join(f"{k}-{i}\n" for i in range(50)), True)
    pin = records.merge_shards(spark, f"{tmp_path}/shards", f"{tmp_path}/one").collect()
    (file,) = (tmp_path / "one").glob("*.gz")
    assert gzip.decompress(file.read_bytes()).decode().split() == [f"{k}-{i}" for k in range(3) for i in range(50)]
    assert [(p.file, p.sha256) for p in pin] == [(file.name, hashlib.sha256(file.read_bytes()).hexdigest())]


def test_parameters_and_reports(spark, tmp_path):
    knots = spark.createDataFrame([("choice", [(0.5, 0.4), (1.0, 0.9)])], "kind string, knots array<struct<right:double,value:double>>")
    records.save_params({"knots": knots}, f"{tmp_path}/p")
    assert records.load_params(spark, f"{tmp_path}/p", ["knots"])["knots"].collect() == knots.collect()
    gates = spark.createDataFrame([("ece", 0.04, 0.05, True, False), ("hard", 0.9, 0.5, False, True)], "gate string, value double, limit double, passed boolean, advisory boolean")
    suites = spark.createDataFrame([("s", 10, 0.75)], "suite string, n long, accuracy double")
    slices = spark.createDataFrame([("domain:a", 0.1)], "slice string, ece double")
    assert records.write_report(gates, suites, slices, f"{tmp_path}/r")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/r/text").collect())
    assert "# Report: passed" in text and "| hard | 0.9000 | advisory fail |" in text and "| s | accuracy | 0.7500 |" in text
    assert spark.read.json(f"{tmp_path}/r/rows").count() == 5
    assert not records.write_report(gates.withColumn("advisory", F.lit(False)), suites, slices, f"{tmp_path}/r2")


def test_shards_merge_to_ordered_parts_and_a_manifest(spark, tmp_path):
    (tmp_path / "shards").mkdir()
    lines = []
    for k in range(6):
        own = [f"{k}-{i}" for i in range(300)]
        lines += own
        (tmp_path / "shards" / f"shard-{k}.jsonl").write_text("\n".join(own) + "\n\n")
    got = records.merge_shards(spark, f"{tmp_path}/shards", f"{tmp_path}/out", part_bytes=2000)
    manifest = {r.file: r.sha256 for r in got.collect()}
    assert len(manifest) > 2
    assert [x for f in sorted(manifest) for x in gzip.decompress((tmp_path / "out" / f).read_bytes()).decode().split()] == lines
    assert all(hashlib.sha256((tmp_path / "out" / f).read_bytes()).hexdigest() == d for f, d in manifest.items())


def test_parameters_change_by_version(spark, tmp_path):
    one, two = (spark.createDataFrame([(k, t)], "kind string, t double") for k, t in (("choice", 1.0), ("score", 2.0)))
    records.save_params({"temperature": one, "knots": one}, f"{tmp_path}/p")
    before = records.load_params(spark, f"{tmp_path}/p", ["temperature"])["temperature"]
    records.save_params({"temperature": two}, f"{tmp_path}/p")
    after = records.load_params(spark, f"{tmp_path}/p", ["temperature", "knots"])
    # a reader of the version before still has it whole
    assert before.collect() == one.collect() and after["temperature"].collect() == two.collect() and after["knots"].collect() == one.collect()
    with pytest.raises(ValueError, match="threshold"):
        records.load_params(spark, f"{tmp_path}/p", ["threshold"])
