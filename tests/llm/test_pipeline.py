import os
import subprocess
import sys

import numpy as np
from conftest import DATA
from rows import AWKWARD, docs_of

import corpus_pipeline
from lexitide.llm import decontaminate, pieces, toxicity
from lexitide.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_against_brute_force(spark):
    sf_dir = f"{DATA}/sf0.01"
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    w, b = toxicity.train(docs, table(spark, sf_dir, "labels"))
    grams = toxicity.Grams((3, 4, 5), 20)
    keep = {i for i, r in rows.items() if w[grams(r.text)].sum(dtype=np.float64) + b < 0}
    last = {}
    for i in sorted(keep):
        last[rows[i].text] = i
    keep = set(last.values())
    sets = {}
    for i in keep:
        x = rows[i].text.encode().lower().split()
        sets[i] = {b" ".join(x[k : k + 5]) for k in range(max(1, len(x) - 4))}
    where, root = {}, {i: i for i in keep}
    for i in sorted(keep):
        for s in sets[i]:
            where.setdefault(s, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, c in {(a, c) for v in where.values() for k, c in enumerate(v) for a in v[:k]}:
        if len(sets[a] & sets[c]) >= 0.8 * len(sets[a] | sets[c]):
            x, y = find(a), find(c)
            root[max(x, y)] = min(x, y)
    keep = {i for i in keep if find(i) == i}
    items = [" " + " ".join(t.decode() for t in decontaminate.tokens(r.text.encode())) + " " for r in table(spark, sf_dir, "benchmark").collect()]
    plain = lambda t: " " + " ".join(x.decode() for x in decontaminate.tokens(t.encode())) + " "
    keep = {i for i in keep if not any(x in plain(rows[i].text) for x in items)}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(out) == keep and 500 < len(keep) < 1000
    codec = pieces.codec(pieces.default_model())
    assert all(out[i].text == rows[i].text and np.array(out[i].token_ids, "<i4").tobytes() == codec.encode([rows[i].text])[0][0] for i in keep)


def test_stages_keep_columns_and_bear_awkward_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = docs_of(spark, AWKWARD)
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, f"{DATA}/sf0.001"), "stage")
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() > 0
        if name == "exact_dedup":
            assert out.count() == len({t or "" for _, t in AWKWARD})
        docs = out
    empty = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, f"{DATA}/sf0.001"), "stage").select(*docs_of(spark, []).columns)
        assert empty.count() == 0


def test_near_copies_by_id_and_text(spark):
    base = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join([*base, *[f"x{k}"]])
    rows = [(1, near(1)), (5, near(2)), (5, "another text that stays"), (None, near(3)), (None, "and one more"), (7, f"z {near(4)[3:]}"), (7, f"z {near(5)[3:]}")]
    kept = corpus_pipeline.near_copies(spark, docs_of(spark, rows), "").collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(str(r) for r in (rows[0], rows[2], rows[4]))
    alone = corpus_pipeline.near_copies(spark, docs_of(spark, [(7, near(1)), (7, near(2)), (None, "b"), (None, "c")]), "").collect()
    assert [r.doc_id for r in alone].count(7) == 1 and len(alone) == 3


def test_pieces_of_ever_new_words_take_bounded_memory():
    """A worker that meets no word twice: what it holds beside its batch doesn't grow with the words it has met."""
    code = """
import resource
import pyarrow as pa
from pyspark.sql import types as T
from lexitide.llm import pieces

class Docs:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    columns = schema.names

    def drop(self, _):
        return self

    def mapInArrow(self, run, _):
        return run

run = pieces.encode(Docs(), threads=2)
batch = lambda k, n: pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([" ".join(f"w{k}x{i * 200 + j}" for j in range(200)) for i in range(n)])], Docs.columns)
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
assert len(list(run(iter([batch(0, 100)])))) == 1
first = most()
assert sum(len(out) for out in run(batch(k, 500) for k in range(1, 9))) == 4000
print(most() - first)
"""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": here})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 80, done.stdout


def test_long_texts_are_cut_where_units_end():
    import sentencepiece

    path = pieces.default_model()
    own, reference = pieces.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "a" * 70_000, " word  and\n" * 9_000, "▁" * 30_000, "é 日 " * 20_000, *[" ".join(f"x{i}" for i in range(n)) for n in (1, 9_000, 90_000)]]
    assert [np.frombuffer(x, "<i4").tolist() for x in own.ids(texts)] == [reference.encode(t) for t in texts]
