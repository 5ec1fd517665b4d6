"""Every operator on null, empty and very long texts, ties, repeated rows, clashing column names, and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelframe.llm import decontaminate, jaccard, langid, licences, ngram_lm, quality, sentencepiece, toxicity, vptree, warc
from pixelframe.llm.queries import piece_model, queries


def words(text):
    return (text or "").encode().lower().split()


def test_language_model(edges, edge_rows, nothing):
    held = F.col("doc_id") == 7
    got = ngram_lm.score_documents(edges, F.coalesce(held, F.lit(False))).collect()
    train = [[*words(r[1]), 0] for r in edge_rows if r[0] != 7]
    unigrams = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([1, *t], t, strict=False))
    n, v = sum(unigrams.values()), len(unigrams)
    before = lambda w: len(train) if w == 1 else unigrams[w]
    p1 = lambda w: (unigrams[w] + 1) / (n + v + 1)

    def score(text):
        t = [*words(text), 0]
        return sum(math.log10(0.5 * pairs[a, w] / before(a) + 0.5 * p1(w) if before(a) else p1(w)) for a, w in zip([1, *t], t, strict=False))

    want = Counter((r[0], r[0] == 7, len(words(r[1])) + 1, sum(unigrams[w] > 0 for w in [*words(r[1]), 0]), n) for r in edge_rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    texts = {r[0]: r[1] for r in edge_rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert math.isclose(r.base_score, sum(math.log10(p1(w)) for w in [*words(t), 0]), rel_tol=1e-9)
            assert math.isclose(r.score, score(t), rel_tol=1e-3)
    assert ngram_lm.score_documents(nothing, F.lit(False)).collect() == []
    unknown = ngram_lm.score_documents(edges, F.lit(True)).collect()
    assert len(unknown) == len(edge_rows) and all(r.n_known == 0 and r.score == pytest.approx(0) for r in unknown)


def triple_scores(rows, share=0.5, strength=2.0):
    """(held out, text) rows scored by brute force: a pair's probability in that of a triple, a text's first word by pairs."""
    train = [[*words(t), 0] for held, t in rows if not held]
    unigrams = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([1, *t], t, strict=False))
    triples = Counter(p for t in train for p in zip([1, *t], t, t[1:], strict=False))
    n, v = sum(unigrams.values()), len(unigrams)

    def score(text):
        total, t = 0.0, [1, *words(text), 0]
        for i in range(1, len(t)):
            p = (unigrams[t[i]] + 1) / (n + v + 1)
            context = len(train) if t[i - 1] == 1 else unigrams[t[i - 1]]
            p = share * p + (1 - share) * pairs[t[i - 1], t[i]] / context if context else p
            if i > 1:
                p = (triples[t[i - 2], t[i - 1], t[i]] + strength * p) / (pairs[t[i - 2], t[i - 1]] + strength)
            total += math.log10(p)
        return total

    return [score(t) for _, t in rows]


def test_language_model_of_triples(spark, edge_rows, prose, monkeypatch):
    """Against brute force, with and without common pairs and triples, over more than one mapper, grids of two sizes, cells in
    one shard and in several."""
    rows = [r[1] for r in edge_rows] + [f"{prose(30, i)} say this very sentence of us {prose(20, i % 150)}" for i in range(200)]
    documents = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    want = triple_scores([(i % 4 == 1, t) for i, t in enumerate(rows)])
    for least, cell, shard in ((8, ngram_lm.CELL, ngram_lm.ROWS), (1 << 40, ngram_lm.CELL, 300), (8, 1000, 300)):
        monkeypatch.setattr(ngram_lm, "LEAST", least)
        monkeypatch.setattr(ngram_lm, "ROWS", shard)
        monkeypatch.setattr(ngram_lm, "CELL", cell)
        pairs, triples = ngram_lm._common_grams(documents, len(rows), 3)
        assert (len(triples) >= 4 and len(pairs) > len(triples)) == (least == 8)
        got = ngram_lm.score_documents(documents, F.col("doc_id") % 4 == 1, order=3).collect()
        assert len(got) == len(rows)
        assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-4) for r in got)
    assert all(r.score == pytest.approx(0) for r in ngram_lm.score_documents(documents, F.lit(True), order=3).collect())
    with pytest.raises(ValueError):
        ngram_lm.score_documents(documents, F.lit(True), order=4)


def test_query_scores_triples(spark):
    """The query's own model is of order 3."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op1_ngram_lm"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = triple_scores([(got[r.doc_id].held_out, r.text) for r in rows])
    assert all(math.isclose(got[r.doc_id].score, s, rel_tol=1e-3) for r, s in zip(rows, want, strict=True))


def test_language(edges, edge_rows, nothing):
    profiles = langid.learn(edges, F.lit(True))
    got = langid.identify(edges, profiles).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert by_id[0] == by_id[1] == by_id[2] == "und" and by_id[6] == by_id[8] == "en"
    assert {r.lang_pred for r in langid.identify(edges, langid.learn(nothing, F.lit(True))).collect()} == {"und"}
    assert langid.identify(nothing, profiles).collect() == []


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(edges, edge_rows, nothing, labels, no_labels, module):
    for model in (module.learn(edges, labels, F.lit(True)), module.learn(edges, no_labels, F.lit(True)), module.learn(nothing, labels, F.lit(True))):
        got = module.score(edges, model).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        kept = module.accepted(edges, model)
        assert kept.columns == edges.columns
        wanted = 1 if module is quality else 0
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted == wanted)
        assert module.score(nothing, model).collect() == [] and module.accepted(nothing, model).collect() == []


def test_near_duplicates(edges, edge_rows, nothing):
    got = jaccard.near_duplicates(edges, 4, 85).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows)
    for r in got:
        want = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 11}.get(r.doc_id)
        if r.doc_id is not None:
            assert r.component_id == want, r
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert sizes[0] == sizes[1] == sizes[2] == 0 and sizes[3] == sizes[5] == 1
    assert sum(r["first"] for r in got if r.component_id == 3) == 1 and sum(r["first"] for r in got if r.component_id == 6) == 1
    assert all(r.component_id == 3 for r in got if r.doc_id is None and r.n_shingles)
    assert jaccard.near_duplicates(nothing).collect() == []


def test_links_by_way_of_others(spark, prose):
    """A chain, a star with a hot shingle, copies, and near copies that only link through others."""
    base = prose(200, 5).split()
    rows, n = [], 0

    def add(w):
        nonlocal n
        rows.append((n, " ".join(w)))
        n += 1

    for k in range(0, 40, 2):  # each links with the next alone
        add(base[k : k + 150])
    for k in range(60):
        w = prose(150, 9).split()
        w[(k * 37) % 150] = f"edit{k}"
        w[(k * 53) % 150] = f"other{k}"
        add(w)
    for k in range(30):  # a passage that many share
        add(prose(20, 11).split() + prose(120, 100 + k).split())
    for _ in range(25):
        add(prose(90, 12).split())
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(n)}
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in enumerate(sets)}


def naive_hits(texts, items, window=10):
    import re

    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for name, item in items:
            v = split(item)
            k = min(window, len(v))
            parts = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1) if v else ():
                if tuple(w[i : i + k]) in parts:
                    hit |= set(range(i, i + k))
                    found.add(str(name))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, edges, edge_rows, nothing, prose, monkeypatch):
    passage = prose(35, 70)
    items = [(1, passage), (2, "One"), (3, None), (4, ""), (5, prose(12, 1)), (6, prose(60, 1)), (7, "É中 \U0001f600"), (7, "a b c"), (10, passage + " " + passage), (11, "a a a a a a a a a a a a")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [*edge_rows, *((100 + k, f"{prose(30, k)} {passage} {passage[:k * 9]} {'A ' * k}", *[None] * 7) for k in range(14))]
    documents = spark.createDataFrame(rows, edges.schema)
    got = decontaminate.contamination(documents, benchmark).collect()
    want = Counter((r[0], *h) for r, h in zip(rows, naive_hits([r[1] for r in rows], items), strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)
    assert not any(r.contaminated for r in decontaminate.contamination(documents, benchmark.limit(0)).collect())
    assert decontaminate.contamination(nothing, benchmark).collect() == []
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    assert Counter(tuple(r) for r in decontaminate.contamination(documents, benchmark).collect()) == want


def test_encoding(edges, edge_rows, nothing, monkeypatch):
    pieces = sentencepiece.Pieces.of(piece_model())
    got = sentencepiece.encode(edges, piece_model()).collect()
    assert len(got) == len(edge_rows) and all(r.round_trip for r in got)
    whole = {r.doc_id: r for r in got}
    for r in edge_rows:
        if r[0] is not None:
            assert whole[r[0]].n_tokens == len(whole[r[0]].ids) == len(pieces.encode(r[1])) // 4
    assert whole[8].ids_sha256 == hashlib.sha256(pieces.encode(next(r[1] for r in edge_rows if r[0] == 8))).hexdigest()
    assert Counter((r.doc_id, r.ids_sha256) for r in sentencepiece.encode(edges, piece_model(), giant=3).collect()) == Counter((r.doc_id, r.ids_sha256) for r in got)
    assert sentencepiece.encode(nothing, piece_model()).collect() == []
    back = {r.doc_id: r.text for r in sentencepiece.decode(sentencepiece.encode(edges, piece_model()).select("doc_id", "ids"), piece_model()).collect() if r.doc_id is not None}
    assert all(back[r[0]] == (r[1] or "") for r in edge_rows if r[0] is not None)


def test_licences(spark, edges, edge_rows, nothing, prose):
    got = licences.summary(licences.scan(edges)).collect()
    assert len(got) == len(edge_rows) and all(r.n_areas == 0 and r.n_matches == 0 and r.licenses == "" and r.best is None and not r.exact for r in got)
    assert licences.scan(nothing).collect() == []
    # nulls beside matches, ties, repeated rows and ids, and a license deep in a very long text
    two = "Released under the MIT License. Licensed under CC BY-NC 4.0."
    rows = [(1, two), (1, two), (None, two), (2, None), (3, f"{prose(60_000, 1)} {licences.TEMPLATES['Zlib']} {prose(60_000, 2)}"), (4, f"é中{two}\x00{two}")]
    got = licences.scan(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, matches string, uid string")).collect()
    names = lambda r: sorted(m.license for m in r.matches)
    assert Counter((r.doc_id, *names(r)) for r in got) == Counter([(1, "CC-BY-NC-4.0-statement", "MIT-statement")] * 2 + [(None, "CC-BY-NC-4.0-statement", "MIT-statement"), (2,), (3, "Zlib"), (4, *["CC-BY-NC-4.0-statement"] * 2, *["MIT-statement"] * 2)])
    same = licences.scan(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), {"b": "one two three", "a": "one two three"}).first()
    assert [m.license for m in same.matches] == ["a", "b"]
    with pytest.raises(ValueError):
        licences.scan(nothing, {"empty": "..."})


def test_archives(spark):
    rows = [(3, "http://a", "same"), (1, "http://b\r\nx", "same"), (2, None, "same"), (4, "u", ""), (5, "u", None), (None, "u", "same"), (6, "u", "é" * 200_000), (7, "u", "only"), (7, "u", "only"), (None, None, "lone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(2)
    got = warc.archive_and_read(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len((h or "").encode()), warc.bare_digest((h or "").encode())) for p, _, h in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter({(1, "response", None): 1, (2, "revisit", 1): 1, (3, "revisit", 1): 1, (None, "revisit", 1): 1, (4, "response", None): 1, (5, "revisit", 4): 1, (6, "response", None): 1, (7, "response", None): 1, (7, "revisit", 7): 1, (None, "response", None): 1})
    assert {r.url for r in got if r.page_id == 1} == {"http://b%0D%0Ax"}
    assert warc.archive_and_read(pages.limit(0)).collect() == []
    assert {r.record_type for r in warc.archive_and_read(pages, least=10**6).collect()} == {"response"}


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [nan, 1.0]), (140, [float("inf"), 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (20, [0.5, 0.5]), (160, [1.0, 2.0, 3.0]), (5, [-1.0, 0.0])]
    got = vptree.nearest(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int"), k=4).orderBy("query_id", "rank").collect()
    of = lambda q: [(r.rank, r.vec_id, r.score) for r in got if r.query_id == q]
    assert of(0) == [(1, 1, 1.0), (2, 2, 1.0), (3, None, 1.0), (4, 20, 0.5)]
    assert of(20) == sorted([(1, 0, 0.5), (1, 0, 0.5), (2, 1, 0.5), (2, 1, 0.5), (3, 2, 0.5), (3, 2, 0.5), (4, 20, 0.5), (4, 20, 0.5)])
    assert {r.query_id for r in got} == {0, 20}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(none).collect() == []


def test_very_large_and_small_vectors(spark):
    """Squares of these overflow or vanish; products that do are infinite or zero, and tie."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * (1e160 if i % 7 == 0 else 1e-170 if i % 11 == 0 else 1.0) for _ in range(4)]) for i in range(600)]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=64, block=100).collect()
    for q, v in rows[::20]:
        scores = []
        for i, w in rows:
            if i != q:
                total = 0.0
                for a, b in zip(v, w, strict=True):
                    total += a * b
                scores.append((math.isnan(total), -total, i))
        found = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [f[1] for f in found] == [s[2] for s in sorted(scores)[:20]], q


def test_session_settings_stay(spark, edges):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    build = [lambda: vptree.nearest(vectors), lambda: ngram_lm.score_documents(edges, F.lit(False)), lambda: langid.identify(edges, langid.learn(edges, F.lit(True))), lambda: sentencepiece.encode(edges, piece_model()), lambda: jaccard.near_duplicates(edges), lambda: warc.archive_and_read(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"))]
    seen = []
    for order in (build, build[::-1]):
        plans = []
        for f in order:
            plans.append(f())
            assert spark.conf.get(name) == before
        seen.append(sorted(sorted(map(repr, p.drop("uid").collect())) for p in plans))
    assert seen[0] == seen[1] and spark.conf.get(name) == before


def test_common_pairs_and_shingles(spark, prose, monkeypatch):
    """A pair and a passage that all documents hold: scored and dealt by mappers, with the results of a grid alone."""
    rows = [(i, f"{prose(30, i)} all of us say this very sentence here {prose(20, 2 * i + 1)}") for i in range(1500)] + [(5000 + i, prose(40, i % 3)) for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    read = documents.selectExpr("monotonically_increasing_id() uid", "doc_id", "text", "xxhash64(text) mark")
    pairs = ngram_lm._common_pairs(read, len(rows))
    assert 8 <= len(pairs) < 2000 and 4 <= len(jaccard._common_columns(read, 5, len(rows))) < 2000
    held = F.col("doc_id") % 5 == 0
    score = lambda: {r.doc_id: r for r in ngram_lm.score_documents(documents, held).collect()}
    group = lambda: sorted((r.doc_id, r.component_id, r.n_shingles, r["first"]) for r in jaccard.near_duplicates(documents, 5, 80).collect())
    dealt, grouped = score(), group()
    monkeypatch.setattr(ngram_lm, "LEAST", 1 << 40)
    monkeypatch.setattr(jaccard, "LEAST", 1 << 40)
    plain = score()
    assert grouped == group()
    assert {k: r[:5] for k, r in dealt.items()} == {k: r[:5] for k, r in plain.items()}
    assert all(math.isclose(r.base_score, plain[k].base_score, rel_tol=1e-9) and math.isclose(r.score, plain[k].score, rel_tol=1e-4) for k, r in dealt.items())


def test_pipeline(spark, edges, edge_rows, nothing, tmp_path, prose):
    """All stages on nulls, ties, repeated rows, very long texts and clashing names, and on an empty table."""
    import corpus_pipeline as pipeline

    labels = spark.createDataFrame([(6, 1, 0), (8, 1, 0), (9, 0, 1), (11, 0, 1), (4, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    extra = "text string, uid string, item_id long, mark long, anchor string"
    benchmark = spark.createDataFrame([(prose(12, 1), "u", 1, 2, "x"), (None, "u", 2, 2, "x")], extra)
    for name, docs, n in (("rows", edges, None), ("none", nothing, 0)):
        folder = f"file://{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        got = pipeline.run(spark, folder).collect()
        assert n is None or len(got) == n
        assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
        for _, stage in pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns and kept.count() <= docs.count()
    kept = Counter(r.doc_id for r in pipeline.clean(spark, edges, f"file://{tmp_path}/rows").collect())
    assert kept == Counter(r[0] for r in edge_rows if r[1] != prose(60, 1))
