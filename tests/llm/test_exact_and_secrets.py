import hashlib
import re

import pytest
from conftest import DATA
from oracle import assert_same
from rows import AWKWARD, docs_of

from lexitide.llm import exact_dedup, queries, secrets
from lexitide.llm.common import new_path


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    sf_dir = f"{DATA}/sf0.001"
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


@pytest.mark.parametrize("keys", [0, 10**6])
def test_groups(spark, keys):
    rows = AWKWARD + [(20, "same prefix " * 20 + "a"), (21, "same prefix " * 20 + "b"), (22, "same prefix " * 20 + "a")]
    got = exact_dedup.duplicate_groups(docs_of(spark, rows), broadcast_keys=keys).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = {(i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == want and len(got) == len(rows)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_duplicates(docs_of(spark, rows), broadcast_keys=keys)
    assert sorted(r.text or "" for r in kept.collect()) == sorted(groups) and kept.columns == docs_of(spark, rows).columns


def test_groups_of_no_rows(spark):
    assert exact_dedup.duplicate_groups(docs_of(spark, [])).count() == 0 and exact_dedup.drop_duplicates(docs_of(spark, [])).count() == 0


def test_an_id_with_two_texts_loses_neither(spark):
    rows = [(5, "a"), (9, "a"), (5, "b"), (None, "c"), (None, "c")]
    kept = exact_dedup.drop_duplicates(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(9, "a"), (5, "b"), (None, "c")], key=str)


def test_query_keeps_null_and_repeated_ids(spark, tmp_path):
    rows = AWKWARD + [(50, "a"), (50, "bb"), (None, "ccc")]
    docs_of(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_exact_dedup(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert [(r.keep_id, r.group_size, r.kept) for r in got if r.text_sha256 == hashlib.sha256(b"ccc").hexdigest()] == [(None, 1, True)]


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


HARD = [
    (30, 'é😀 password = "hunter2hunter2" and TOKEN:abcdefgh ; token: short; secret=password=abcdefghij'),
    (31, "password=token: abcdefghijkl"), (32, "AKIA" + "Q" * 12 + " AKIAAKIA" + "1" * 20 + " AKIA123"), (33, "f" * 31 + "g" + "a1" * 16 + "token=" + "0" * 40),
    (34, "ſecret=abcdefghij toKen=abcdefghij api_key='AKIA" + "Z" * 16 + "' apikey==deadbeefdeadbeefdeadbeefdeadbeef"), (35, "ghp_" + "x" * 36 + " -----BEGIN RSA PRIVATE KEY-----"), (36, None),
]


def test_secrets_against_re(spark):
    rows = HARD + AWKWARD
    got = secrets.scan(docs_of(spark, rows), new_path(spark, "ledger")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts.get(r.doc_id) or ""
        own = [(s.start, [b.kind for b in secrets.BASE].index(s.kind), s.end, s.kind) for s in r.spans if s.kind in ("assign", "access", "hex")]
        assert own == brute(text) and r.blob == hashlib.sha256(text.encode()).hexdigest()
    extra = {r.doc_id: [s.kind for s in r.spans] for r in got}
    assert extra[35] == ["github", "pem"]


@pytest.mark.parametrize("limit", [0, 1000])
def test_ledger(spark, limit):
    ledger = new_path(spark, "ledger")
    first = [(1, "token=abcdefgh1"), (2, "token=abcdefgh1"), (3, "nothing")]
    assert len(secrets.scan(docs_of(spark, first), ledger, broadcast_blobs=limit).collect()) == 3
    assert spark.read.parquet(f"{ledger}/scanned").count() == 2
    second = [*first, (4, "AKIA" + "B" * 16), (5, "token=abcdefgh1"), (None, "token=abcdefgh1")]
    got = {r.doc_id: len(r.spans) for r in secrets.scan(docs_of(spark, second), ledger, broadcast_blobs=limit).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1, 5: 1, None: 1} and spark.read.parquet(f"{ledger}/scanned").count() == 3
    newer = (secrets.Rule("assign", "token=[a-z]+", version=2), *secrets.RULES[1:])
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.scan(docs_of(spark, second), ledger, newer).collect()}
    assert got[1] == [(0, 14)] and got[4] == [(0, 20)]
    scanned = spark.read.parquet(f"{ledger}/scanned").collect()
    assert sum(r.rules == ["assign@2"] for r in scanned) == 3
    assert secrets.scan(docs_of(spark, []), ledger).count() == 0


def test_secrets_run_no_python(spark):
    plan = queries.op3_secrets(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
