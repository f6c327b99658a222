import re
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import AWKWARD, LONG, docs_of

from lexitide.llm import decontaminate, licences, pieces, queries, token_counts, toxicity, wrappers


def test_token_histogram(spark):
    sf_dir = f"{DATA}/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    own = token_counts.encoding()
    lengths = np.array([len(own.encode_ordinary(t)) for t in texts])
    got = {r.n_tokens: r for r in queries.op1_token_counts(spark, sf_dir).collect()}
    assert set(got) == set(lengths.tolist())
    for n, r in got.items():
        assert (r.docs, r.tokens, r.docs_ge, r.tokens_ge) == ((lengths == n).sum(), n * (lengths == n).sum(), (lengths >= n).sum(), lengths[lengths >= n].sum())
        assert r.truncated_tokens == np.minimum(lengths, n).sum() and r.quantile == (lengths <= n).mean()


def test_token_counts_of_awkward_rows(spark):
    got = {r.n_tokens: r.docs for r in token_counts.length_histogram(docs_of(spark, AWKWARD)).collect()}
    own = token_counts.encoding()
    assert got == Counter(len(own.encode_ordinary(t or "")) for _, t in AWKWARD) and got[0] == 2
    assert token_counts.context_limits(token_counts.length_histogram(docs_of(spark, []))).count() == 0


def test_pieces(spark):
    import sentencepiece

    rows = [*AWKWARD, (50, "  lead  and   gaps \n\n"), (51, "<s> <unk> <0x0A> ▁"), (52, "\u2028 x\u00a0y")]
    reference = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = pieces.decode(pieces.encode(docs_of(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.token_ids == reference.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    found = pieces.summarize(docs_of(spark, rows)).collect()
    assert all(r.parity for r in found) and [r.doc_id for r in found if not r.round_trip] == [51]
    assert pieces.encode(docs_of(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_piece_parity(texts):
    import sentencepiece

    path = pieces.default_model()
    own = pieces.codec(path, 2, True)
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    got = own.encode(texts)
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    for t, (ids, same) in zip(texts, got):
        assert np.frombuffer(ids, "<i4").tolist() == reference.encode(t) and same
        assert own.decode([ids]) == [t.replace("▁", " ")] and own.whole(t, ids)


def test_piece_query(spark):
    got = queries.op6_sentencepiece(spark, f"{DATA}/sf0.001").collect()
    assert len(got) == 200 and all(r.parity and r.round_trip for r in got)


def phrase_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for i in range(len(w)) for p, label in licences.PHRASES if w[i : i + len(p.split())] == p.split()]
    return len(w), found


LICENCES = [
    (60, "The MIT-License; mit\tlicense, Apache license and GNU general PUBLIC license. no"), (61, "mit élicense license mit"), (62, licences.TEMPLATES["mit-grant"][1].upper()),
    (63, "x " * 50 + licences.TEMPLATES["gpl-3.0-notice"][1]), (64, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy"), (65, "general general public license license"),
]


def test_licences(spark):
    rows = LICENCES + AWKWARD
    got = licences.scan(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = {t for i, t in rows if i == r.doc_id}
        n, found = phrase_places(texts.pop())
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(found), sorted({x for _, x in found}))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None)) and 0 <= r.score <= 1
        assert set(r.base_labels) <= set(r.labels)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[60] == ["apache", "gpl", "mit"] and "mit" in labels[62] and "gpl-3.0" in labels[63] and "gpl-2.0" not in labels[63] and "apache-2.0" in labels[64] and labels[6] == []
    assert licences.scan(docs_of(spark, [])).count() == 0


def test_licence_query(spark):
    sf_dir = f"{DATA}/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op7_licences(spark, sf_dir).collect()
    for r in got:
        n, found = phrase_places(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(found), ",".join(sorted({x for _, x in found})))
    assert len(got) == len(texts) and any(r.n_base for r in got)


def brute_tiles(doc, item, width):
    """Greedy string tiling by comparing every pair of places, round by round."""
    free_p, free_q, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and free_p[p + n] and free_q[q + n] and doc[p + n] == item[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < width:
            return total
        for k in range(best[0]):
            free_p[best[1] + k] = free_q[best[2] + k] = False
        total += best[0]


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=40), st.text("abcd", min_size=1, max_size=15), st.integers(1, 4))
def test_tiling(doc, item, width):
    words = lambda s: " ".join(s).encode()
    items = decontaminate.Items([(1, words(item))], width)
    got = dict((i, m) for i, m, _ in items.cover(words(doc))).get(0, 0)
    assert got == brute_tiles(list(doc), list(item), min(width, len(item)))


ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"


@pytest.mark.parametrize("block", [1, 10**7])
def test_contaminated(spark, block):
    w = ITEM.split()
    rows = [(70, f"Before. {ITEM.upper()}, after"), (71, " ".join(w[6:] + ["gap"] + w[:6])), (72, " ".join(w[:4] + ["gap"] + w[8:])), (73, " ".join(reversed(w))), (74, "tiny test"), (75, ITEM + " " + ITEM), *AWKWARD]
    items = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 1), (2, "tiny TEST!", 0), (3, None, 0), (4, "", 0), (None, "null id", 0)], "item_id long, text string, doc_id long")
    docs = docs_of(spark, rows)
    got = sorted((tuple(r) for r in decontaminate.contaminated(docs, items, block_bytes=block).collect()), key=str)
    want = [(70, 1, 12, 12, 1, 1.0), (71, 1, 12, 12, 2, 1.0), (75, 1, 12, 12, 1, 1.0), (74, 2, 2, 2, 1, 1.0), *[(i, None, 2, 2, 1, 1.0) for i in (None, None, 9, 12)]]
    assert got == sorted(want, key=str)
    kept = decontaminate.drop_contaminated(docs, items, block_bytes=block)
    assert kept.count() == len(rows) - 8 and kept.columns == docs.columns
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_contamination_query(spark):
    """Every document that holds an item whole is found, and none that shares less than half of one."""
    sf_dir = f"{DATA}/sf0.001"
    plain = lambda t: " " + " ".join(x.decode() for x in decontaminate.tokens(t.encode())) + " "
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, sf_dir).collect()}
    assert got >= {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} and got
    for d, i in got:
        assert brute_tiles(docs[d].split(), items[i].split(), 5) >= 0.5 * len(items[i].split())


def test_toxicity_held_out(spark):
    sf_dir = f"{DATA}/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in queries.op9_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    toxic = [r.score for r in got if labels[r.doc_id] == 1]
    clean = [r.score for r in got if labels[r.doc_id] == 0]
    better = np.mean([np.mean(np.array(clean) < t) for t in toxic])
    assert better > 0.97 and np.mean([t >= 0.5 for t in toxic]) > 0.75 and np.mean([c >= 0.5 for c in clean]) < 0.02
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_ignores_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"text {'foul' if i % 2 else 'fair'} {i}") for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "'x' as text")
    held = labels.where(toxicity.held_out(labels.doc_id))
    flipped = labels.where(~toxicity.held_out(labels.doc_id)).unionByName(held.selectExpr("doc_id", "1 - toxic as toxic", "text"))
    w, b = toxicity.train(docs, labels)
    w2, b2 = toxicity.train(docs, flipped)
    assert np.array_equal(w, w2) and b == b2 and held.count() > 0
    rows = toxicity.score(docs_of(spark, AWKWARD), w, b).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert [r.predicted for r in toxicity.score(docs, w, b).orderBy("doc_id").collect()] == [i % 2 for i in range(200)]
    assert toxicity.keep_clean(docs, w, b).count() == 100


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "a"), (2, LONG)])
    w, b = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, w, b).collect()} == {0} and toxicity.keep_clean(docs, w, b).count() == 2
    w, b = toxicity.train(docs, spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(0), w, b).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header>
<div class="cookie-notice">We bake</div><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="content"><p>Read our journal daily</p><p>{0}</p>
<p>more <b>bold</b>ly&nbsp;of<br>{0} &amp; &lt;so&gt;</p><div class="ad">Buy {0}</div><div class="comments"><p>I disagree {0}</p></div></div>
<aside>also</aside><form>mail <input></form><footer>&copy; {0}</footer></body></html>"""


def words(n):
    return " ".join(f"w{n}x{k}" for k in range(9))


@pytest.mark.parametrize("size", [0, 10**9])
def test_wrapper_induction(spark, size):
    rows = [(i, f"https://User@HOST.example/{i}", PAGE.format(words(i))) for i in range(6)]
    rows += [(100, "http://lone.example/", PAGE.format("solo")), (101, None, None), (102, "no address", ""), (103, "http://lone.example/b", "plain & text"), (None, "http://host.example/z", PAGE.format("zed")), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, host string, slots long")
    got = wrappers.main_text(pages, reference_bytes=size).collect()
    assert len(got) == len(rows)
    body = lambda t: f"{t}\n\nmore boldly of {t} & <so>"
    for r in got:
        if r.page_id in (100,):
            assert r.text == "Read our journal daily\n\n" + body("solo")  # too few pages to tell
        elif r.page_id in (101, 102):
            assert r.text == ""
        elif r.page_id == 103:
            assert r.text == "plain & text"
        else:
            assert r.text == body("zed" if r.page_id is None else words(r.page_id))
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_copies_of_an_article_stay(spark):
    pages = spark.createDataFrame([(i, "http://mirror.example/", PAGE.format("the very same article")) for i in range(9)], "page_id long, url string, html string")
    assert {r.text.count("the very same article") for r in wrappers.main_text(pages).collect()} == {2}


def test_malformed_html():
    text = lambda s: [n.text for n in wrappers.content(wrappers.parse(s))]
    assert text("<article><p>a<p>b<div>c</article><footer>f") == ["a", "b", "c"]
    assert text("<main><ul><li>1<li>2</ul><table><tr><td>x<td>y</table>tail") == ["1", "2", "x", "y", "tail"]
    assert text("a < b & c <!-- no --> d <script>x<p>") == ["a < b & c d"]
    assert text("</div></p>stray<article class=post><header><h1>H</h1><p>by</p></header>t</article>") == ["H", "t"]
    assert text("<p>" * 3000 + "deep") == ["deep"] and text("<div>" * 3000 + "deep") == ["deep"]
    assert text('<article><p title="a > b">q</p></article>') == ["q"]
    assert text("<article><p title=it's>one</p><p>it's two</p></article>") == ["one", "it's two"]
    assert text('<p title="open>x</p><p>y</p>') == ["x", "y"] and text("<a b=" * 20_000) == [("<a b=" * 20_000).strip()]
    assert text('<div class="siteNAV">n</div><ol class="commentlist"><li>c</ol><div id="mainMenu">m</div><p>body</p>') == ["body"]


def test_tree_matching_is_optimal():
    from itertools import product

    def tree(spec):
        return wrappers.parse("<body>" + spec + "</body>")

    def size(a, b):
        if a.label != b.label:
            return 0
        m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, j in product(range(len(a.children)), range(len(b.children))):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(a.children[i], b.children[j]))
        return 1 + m[-1][-1]

    rng = np.random.default_rng(0)

    def spec(depth=3):
        return "".join(f"<{t}>{spec(depth - 1)}</{t}>" if depth and rng.random() < 0.6 else f"<{t}>x</{t}>" for t in rng.choice(["div", "ul", "section"], rng.integers(0, 5)))

    for _ in range(60):
        a, b = tree(spec()), tree(spec())
        matcher = wrappers.Matcher()
        pairs = matcher.align(a, b)
        assert matcher.size(a, b) == size(a, b) and len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs})


def test_html_query(spark):
    import html

    got = {r.page_id: r for r in queries.op4_html(spark, f"{DATA}/sf0.001").collect()}
    for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect():
        inner = re.search("(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in blocks if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
