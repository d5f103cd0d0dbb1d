"""The ledger's memory: rules added later, scans that break off, and texts that once took quadratic time."""

import time

import pytest

from verdictlake.llm import secret_ledger
from verdictlake.llm.secret_ledger import BASE, RULES, BlobLedger

TOKEN = "gho_" + "a1B2" * 10


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_rule_added_later_reaches_every_stored_version(spark, tmp_path):
    ledger = BlobLedger(spark, f"file://{tmp_path}/ledger")
    ledger.scan(table(spark, [(1, f"old {TOKEN}"), (2, "clean")]), rules=BASE)
    # the token's version is replaced on its path before the rule exists
    unseen = {(r.path, r.scan): (len(r.rules), r.findings) for r in ledger.history().collect()}
    assert unseen == {("1", 1): (3, None), ("2", 1): (3, None)}  # not scanned by all rules, so not known to be clean
    assert all(r.findings == [] for r in ledger.history(BASE).collect())
    ledger.scan(table(spark, [(1, "new text")]), rules=RULES)
    found = {(r.path, r.scan): [f.kind for f in r.findings] for r in ledger.history().collect()}
    assert found == {("1", 1): ["github"], ("2", 1): [], ("1", 2): []}
    assert all(len(r.rules) == len(RULES) for r in ledger.history().collect())


def test_a_scan_that_breaks_off_is_taken_up_by_the_next(spark, tmp_path, monkeypatch):
    ledger = BlobLedger(spark, f"file://{tmp_path}/ledger")

    def lost(*_):
        raise RuntimeError("executors lost")

    with monkeypatch.context() as m:
        m.setattr(ledger, "_find", lost)
        with pytest.raises(RuntimeError):
            ledger.scan(table(spark, [(1, f"x {TOKEN}"), (2, "clean")]))
    assert all(r.findings is None and r.rules == [] for r in ledger.history().collect())
    assert ledger.scan(table(spark, [(3, "other")])).count() == 1
    assert {r.path: [f.kind for f in r.findings] for r in ledger.history().collect()} == {"1": ["github"], "2": [], "3": []}


def test_texts_are_stored_and_read_once(spark, tmp_path):
    ledger = BlobLedger(spark, f"file://{tmp_path}/ledger")
    rows = [(1, "same"), (2, "same"), (3, None), (4, "")]
    ledger.scan(table(spark, rows))
    ledger.scan(table(spark, [*rows, (5, "more")]))
    assert sorted(r.content for r in ledger.texts().collect()) == ["", "more", "same"]
    assert ledger.pending(RULES).count() == 0


def test_runs_of_starts_take_time_in_proportion(spark, tmp_path):
    ledger = BlobLedger(spark, f"file://{tmp_path}/ledger")
    jwt = "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".c0ffee"
    texts = ["eyJ" * 300_000, "token " * 100_000, "ghp_" * 200_000, "xoxa-" * 150_000, "-----BEGIN " * 80_000, f"a {jwt} b", f"x{jwt}"]
    began = time.time()
    got = {r.doc_id: [f.kind for f in r.findings] for r in ledger.scan(table(spark, list(enumerate(texts)))).collect()}
    assert time.time() - began < 60
    assert got == {0: [], 1: [], 2: [], 3: ["slack"], 4: [], 5: ["jwt"], 6: []}
    assert secret_ledger.RULES[-1].kind == "jwt"
