"""Hard inputs: repeated tokens, deep and wide pages, several layouts, squeezing models, licences and scores by brute force."""

import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from rows import docs_of
from test_text_operators import brute_tiles

from lexitide.llm import decontaminate, exact_dedup, licences, pieces, queries, token_counts, toxicity, wrappers


@pytest.mark.parametrize("pairs, matches", [(1, 1), (3, 2), (10, 1), (50, 5)])
def test_tiling_in_turns(monkeypatch, pairs, matches):
    """However little a pass may hold, the tiles are those of greedy tiling."""
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    monkeypatch.setattr(decontaminate, "MATCHES", matches)
    rng = random.Random(pairs)
    for _ in range(60):
        letters, w = rng.choice(["ab", "abc", "abcd"]), rng.randint(1, 4)
        doc, item = (rng.choices(letters, k=rng.randint(1, n)) for n in (40, 16))
        items = decontaminate.Items([(1, " ".join(item).encode()), (2, " ".join(item[::-1]).encode())], w)
        got = {i: m for i, m, _ in items.cover(" ".join(doc).encode())}
        assert [got.get(0, 0), got.get(1, 0)] == [brute_tiles(doc, x, min(w, len(item))) for x in (item, item[::-1])]


def test_tiling_of_repeated_tokens():
    items = decontaminate.Items([(1, b"w " * 3000), (2, b"w " * 3000 + b"a b c d e f")], 5)
    assert list(items.cover(b"W " * 3000, 0.5)) == [(0, 3000, 1), (1, 3000, 1)]
    many = decontaminate.Items([(k, b"one two three four five six " + " ".join(f"{x}{k}" for x in "uvwxyz").encode()) for k in range(20_000)], 5)
    assert list(many.cover(b"one two three four five six " * 2000, 0.6)) == []
    assert next(many.cover(b"one two three four five six " * 2000, 0.5))[1:] == (6, 1)


def test_blocks_are_filled(spark):
    items = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(40)], "item_id long, text string")
    blocks = list(decontaminate._blocks(items, 500))
    assert sorted(i for b in blocks for i, _ in b) == list(range(40))
    assert all(sum(len(t) + 16 for _, t in b) <= 500 for b in blocks)


def test_contaminated_pairs_against_brute_force(spark):
    """All pairs of sf0.001, both ways: whole, partial and reordered items."""
    sf_dir = f"{DATA}/sf0.001"
    docs = {r.doc_id: decontaminate.tokens(r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: decontaminate.tokens(r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    runs = lambda t, w: {tuple(t[i : i + w]) for i in range(len(t) - w + 1)}
    want = {}
    for d, t in docs.items():
        own = {w: runs(t, w) for w in {min(5, len(x)) for x in items.values()}}
        for i, x in items.items():
            w = min(5, len(x))
            if x and own[w] & runs(x, w):
                n = brute_tiles(t, x, w)
                if n >= 0.5 * len(x):
                    want[d, i] = n
    assert {(r.doc_id, r.item_id): r.matched for r in queries.op8_decontamination(spark, sf_dir).collect()} == want and want


def test_exact_dedup_of_clashing_names_and_empty_texts(spark):
    rows = [(5, None, 1, 2), (5, "", 1, 2), (4, "", 3, 4), (7, "x", 0, 0), (7, "x", 0, 0), (8, "y", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _full long").selectExpr("*", "1 as held", "'r' as full", "2 as len", "3 as again")
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r._full) for r in kept.collect()) == [(5, "", 2), (7, "x", 0), (8, "y", 0)]


def page(body, i, host="many.example"):
    return (i, f"http://{host}/{i}", f"<html><body>{body}</body></html>")


def words(n, k=9):
    return " ".join(f"w{n}x{j}" for j in range(k))


def test_boilerplate_without_telling_names(spark):
    """No element or class tells what repeats; alignment does, in each of a host's two layouts."""
    one = lambda i: f'<div class="a{i % 7}"><p>Read our journal daily</p><p>{words(i)}</p><div><p>All rights kept, and more of the like</p></div><p>{words(i + 500)}</p></div>'
    two = lambda i: f'<div class="other"><table><tr><td>A table of the house</td></tr><tr><td>{words(i)}</td></tr></table><p>{words(i + 500)}</p><p>Ring us any time</p></div>'
    rows = [page(one(i) if i % 2 else two(i), i) for i in range(16)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    assert {i: t for i, t in got.items() if not i % 2} == {i: f"{words(i)}\n\n{words(i + 500)}" for i in range(0, 16, 2)}
    odd = {i: t for i, t in got.items() if i % 2}
    # class names that differ from page to page by their number keep trees apart; those of the reference's are aligned
    assert all(words(i) in t and words(i + 500) in t for i, t in odd.items())
    same = [page(one(0).replace("a0", "a").replace(words(0), words(i)).replace(words(500), words(i + 500)), i, "one.example") for i in range(8)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(same, df.schema)).collect()}
    assert got == {i: f"{words(i)}\n\n{words(i + 500)}" for i in range(8)}
    off = {r.text.count("journal") for r in wrappers.main_text(spark.createDataFrame(same, df.schema), min_pages=10**9).collect()}
    assert off == {1}


def test_deep_wide_and_long_pages(spark):
    rng = random.Random(2)
    items = ["<li>a", "<li><p>b</p>", "<li class=c>d", "<li><p>a</p><p>b</p>"]
    bodies = {
        "deep.example": lambda i: "<div>" * 2500 + "<p>" * i + "<div>" * 2500 + f"<p>Same words everywhere</p><p>{words(i)}",
        "wide.example": lambda i: "<ul>" + "".join(rng.choice(items) for _ in range(5000 - 9 * i)) + f"</ul><p>{words(i)}</p>",
        "long.example": lambda i: f"<p>{words(i, 60_000)}</p>" + "<object>" * 5000 + "<b>" * 5000,
    }
    rows = [page(make(i), 10 * k + i, host) for k, (host, make) in enumerate(bodies.items()) for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 15 and all(words(i % 10, 9) in t for i, t in got.items())
    assert got[21] == words(1, 60_000) and "Same words" not in got[1]


def test_strips_give_one_alignment(monkeypatch):
    rng = random.Random(4)
    tree = lambda n: wrappers.parse("<ul>" + "".join(rng.choice(["<li>a", "<li><p>b</p>", "<li><p>a</p><p>b</p>"]) for _ in range(n)))
    for _ in range(20):
        a, b = tree(rng.randint(1, 90)), tree(rng.randint(1, 90))
        made = []
        for strip in (1, 7, 10**6):
            monkeypatch.setattr(wrappers.Matcher, "STRIP", strip)
            monkeypatch.setattr(wrappers, "isqrt", lambda n: 0)
            made.append({(id(x), id(y)) for x, y in wrappers.Matcher().align(a, b)})
        assert made[0] == made[1] == made[2]


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("squeeze, prefix", [(1, 1), (0, 1), (1, 0), (0, 0)])
def test_unigram_model(tmp_path, squeeze, prefix):
    """A unigram model written by hand, with byte fallback; the SentencePiece library gives the ids to match."""
    import sentencepiece

    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    made += [(p, -1.0 - k / 7, 1) for k, p in enumerate(["▁the", "▁t", "he", "▁", "t", "h", "e", "▁an", "a", "n", "d", "▁and", "nd", "er", "r", "ther", "é"])]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in made)
    data += field(2, field(3, 1) + field(35, 1) + field(40, 0) + field(41, 1) + field(42, 100_000) + field(43, 100_001)) + field(3, field(1, b"own") + field(3, prefix) + field(4, squeeze) + field(5, 1))
    path = f"{tmp_path}/own.model"
    with open(path, "wb") as file:
        file.write(data)
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    own = pieces.Codec(path, 2, True)
    for text in ["the and", "  the   other  ", "", " ", "hand é 日 the\nand", "thethe and", "x"]:
        ids, same = own.encode([text])[0]
        assert np.frombuffer(ids, "<i4").tolist() == reference.encode(text) and own.whole(text, ids)
        assert same is (None if squeeze and not prefix else True)
        assert own.decode([ids]) == [reference.decode(reference.encode(text))]


def brute_licences(words):
    """Labels and score by trying every place of every template, without an index."""
    texts = {n: licences.words_of(t.encode()) for n, (_, t, _) in licences.TEMPLATES.items()}
    idf = {w: math.log((1 + len(texts)) / sum(w in t for t in texts.values())) for t in texts.values() for w in t if w not in licences.COMMON}
    out = {}
    line = b" " + b" ".join(words) + b" "
    for name, t in texts.items():
        if not all(b" " + b" ".join(licences.words_of(k.encode())) + b" " in line for k in licences.TEMPLATES[name][2]):
            continue
        own = sorted({w for w in t if w in idf and w in words}, key=lambda w: (-idf[w], w))[:8]
        places = {w: {at - i for at, x in enumerate(words) if x == w for i, y in enumerate(t) if y == w} for w in own}
        best = max((sum(idf[w] for w in own if any(p <= x <= p + 6 for x in places[w])) for p in set().union(*places.values())), default=0)
        share = min(1.0, best / sum(sorted((idf[w] for w in set(t) if w in idf), reverse=True)[:8]))
        if share >= 0.6 - 1e-9:
            out[name] = share
    return out


def test_licence_labels_against_brute_force(spark):
    rng = random.Random(3)
    full = [t for _, t, _ in licences.TEMPLATES.values()]
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    rows = [(i, t) for i, t in enumerate(full)] + [(100, gpl.format("General Public License")), (101, gpl.format("Affero General Public License")), (102, "copyright license software " * 300)]
    for k in range(60):  # cut, mixed and edited
        w = " ".join(rng.sample(full, 2)).split()
        a = rng.randrange(len(w) - 5)
        w = w[a : a + rng.randint(5, 200)]
        for _ in range(rng.randint(0, 6)):
            w.insert(rng.randrange(len(w)), f"extra{k}")
        rows.append((200 + k, " ".join(w)))
    got = {r.doc_id: r for r in licences.scan(docs_of(spark, rows)).collect()}
    for i, t in rows:
        want = brute_licences(licences.words_of(t.encode()))
        assert got[i].matches.keys() == want.keys() and all(abs(got[i].matches[n] - x) < 1e-9 for n, x in want.items())
        assert set(got[i].labels) == set(got[i].base_labels) | {licences.TEMPLATES[n][0] for n in want}
        assert abs(got[i].score - (1.0 if got[i].n_base else max(want.values(), default=0.0))) < 1e-9
    for i, t in enumerate(licences.TEMPLATES.values()):
        assert t[0] in got[i].labels
    assert "gpl-3.0" in got[100].labels and "agpl-3.0" in got[101].labels and got[102].labels == []


def test_toxicity_scores_by_plain_python(spark):
    """Each score again from the weights, n-gram by n-gram."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    w, b = toxicity.train(docs, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, w, b).collect()}
    mask = (1 << 64) - 1
    for r in docs.collect():
        codes, seen = [ord(c) for c in f" {r.text.lower()} "], set()
        for n in (3, 4, 5):
            for i in range(len(codes) - n + 1):
                h = codes[i]
                for c in codes[i + 1 : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) & mask
                seen.add(((h ^ h >> 29) * (0xBF58476D1CE4E5B9 + 2 * n) & mask) >> 44)
        z = sum(float(w[x]) for x in seen) + b
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-6


def test_toxicity_ratios_and_weights(spark):
    """Naive Bayes log-count ratios of single n-grams scale the features that are learnt."""
    rows = [(i, "abc" if i % 2 else "xyz") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    w, _ = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    grams = toxicity.Grams((3, 4, 5), 20)
    assert all(w[grams("abc")] > 0) and all(w[grams("xyz")] < 0)


def test_given_context_limits(spark):
    lengths = [0, 3, 3, 10, 900, 5000]
    h = spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "n_tokens long, docs long")
    got = {r.n_tokens: r for r in token_counts.at_limits(h, [5, 10, 2048, 10**6, 5, None]).collect()}
    assert set(got) == {5, 10, 2048, 10**6}
    for n, r in got.items():
        assert (r.docs_ge, r.truncated_tokens) == (sum(x >= n for x in lengths), sum(min(x, n) for x in lengths))
        assert r.quantile == sum(x <= n for x in lengths) / len(lengths)
    assert token_counts.at_limits(h.limit(0), [5]).count() == 0


def test_whole_text_parity(spark):
    got = queries.op6_sentencepiece(spark, f"{DATA}/sf0.001").collect()
    assert all(r.parity for r in got) and {r.whole_parity for r in got if r.doc_id % 50 == 0} == {True}
    assert {r.whole_parity for r in got if r.doc_id % 50} == {None}


class Docs:
    """Stands for documents: gives the function that runs in the workers."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_parity_of_every_whole_text(spark, tmp_path, monkeypatch):
    """A normaliser that differs shows in whole texts only, and in any row; a model whose units can't be compared is compared too."""
    made = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, -1.0 - k, 1) for k, p in enumerate(["▁", "t", "h", "e", "▁the"])]]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in made)
    data += field(2, field(3, 1) + field(35, 1) + field(40, 0) + field(41, 100_000) + field(42, 100_001) + field(43, 100_002)) + field(3, field(1, b"own") + field(3, 0) + field(4, 1) + field(5, 1))
    path = f"{tmp_path}/own.model"
    with open(path, "wb") as file:
        file.write(data)
    texts = ["the the", "the The", "", "  the  the ", "T"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 50, 51, None, 3]), pa.array(texts)], ["doc_id", "text"])
    look = lambda p: [(r["parity"], r["whole_parity"]) for out in pieces.summarize(Docs(), p, 2)(iter([batch])) for r in out.to_pylist()]
    for p in (path, None):
        assert look(p) == [(True, None), (True, True), (True, None), (True, None), (True, None)]
    plain = pieces.Codec.escaped
    monkeypatch.setattr(pieces.Codec, "escaped", lambda self, text: plain(self, text.lower()))
    for p in (path, None):
        assert look(p) == [(True, None), (False, False), (True, None), (True, None), (False, None)]


def test_word_pattern_of_licences():
    rng = random.Random(8)
    for _ in range(200):
        t = "".join(rng.choice("aZ09 _-.\x00\x7fé日/@`{") for _ in range(30))
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        assert [w.decode() for w in licences.words_of(t.encode())] == want
