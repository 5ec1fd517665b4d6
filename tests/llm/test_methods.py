"""What the operators are made of, each against a plain version."""

from __future__ import annotations

import numpy as np
import pytest

from pixelframe.llm import licences, quality, sentencepiece, toxicity, vptree, warc
from pixelframe.llm.common import utf8, word_hashes
from pixelframe.llm.components import components
from pixelframe.llm.elias_fano import EliasFano, NgramTrie
from pixelframe.llm.langid import Profiles, ngrams
from pixelframe.llm.queries import piece_model, queries

SF = "/root/testdata/sf0.01"


def test_words(monkeypatch):
    import pyarrow as pa

    from pixelframe.llm import common

    texts = ["Hello  world\n x", "", None, "ab", "Ab b\x0bc é É", "hello ", "y" * 300 + " z"]
    plain = [w for t in texts for w in (t or "").encode().lower().split()]
    for segment in (common.SEGMENT, 3, 16):
        monkeypatch.setattr(common, "SEGMENT", segment)
        hashes, at = word_hashes(*utf8(pa.array(texts)))
        assert at.tolist() == np.cumsum([0] + [len((t or "").split()) for t in texts]).tolist()
        assert [[a == b for b in plain] for a in plain] == [[a == b for b in hashes] for a in hashes]


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1000, 50), (1000, 10**9), (5000, 10_000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, top, n))
    sequence = EliasFano.build(values)
    assert (sequence.access(np.arange(n)) == values).all()
    x = rng.integers(0, top + 5, 2000)
    assert (sequence.find(x) == np.searchsorted(values, x)).all()


def test_trie():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 30, (3000, 3))
    two, three = np.unique(np.concatenate([grams[:, :2], grams[:, 1:]]), axis=0), np.unique(grams, axis=0)
    trie, values = NgramTrie(30), rng.random(len(three))
    trie.add_level(two, rng.random(len(two)))
    trie.add_level(three, values)
    asked = rng.integers(0, 30, (5000, 3))
    place = {tuple(g): i for i, g in enumerate(three.tolist())}
    assert trie.nodes(asked).tolist() == [place.get(tuple(g), -1) for g in asked.tolist()]
    assert abs(trie.values(3, trie.nodes(three)) - values).max() < 1e-4


def test_components(spark, tmp_path):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}").collect()
    assert {r.u: r.v for r in got} == {x: r for x, r in root.items() if x != r}


def test_ngrams():
    key, n = ngrams("Ab ab1")
    a, b, e = ord("a"), ord("b"), 1
    want = {a: 2, b: 2, e << 21 | a: 2, a << 21 | b: 2, b << 21 | e: 2, e << 42 | a << 21 | b: 2, a << 42 | b << 21 | e: 2}
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == want
    p = Profiles({"x": [5, 6, 7], "y": [7, 9]}, 3)
    assert p.distances(np.array([7, 5])).tolist() == [2 + 1, 0 + 3]


def test_held_out_language(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in queries()["op2_language_id"](spark, SF).collect() if r.held_out]
    assert len(got) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.98


@pytest.mark.parametrize("name, label", [("op3_quality", "quality"), ("op9_toxicity", "toxic")])
def test_held_out_labels(spark, name, label):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r.predicted, known[r.doc_id]) for r in queries()[name](spark, SF).collect() if r.held_out and r.doc_id in known]
    assert len(got) > 50 and np.mean([p == y for p, y in got]) > 0.9


def test_language_model_beats_words_alone(spark):
    got = [r for r in queries()["op1_ngram_lm"](spark, SF).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_rules_become_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.random((800, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    model = quality.Quality.fit(x, y)
    assert 0 < len(model.rules) and ((model.margin(x) > 0) == y).mean() > 0.97
    df = spark.createDataFrame(x.tolist(), quality.STATISTICS)
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-model.margin(x))))


def test_gradients():
    net, rng = toxicity.Network(3), np.random.default_rng(0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, real, y = rng.standard_normal((4, 16, 16)), np.ones((4, 16), bool), np.array([0, 1, 1, 0.0])
    real[1, 5:] = False

    def loss():
        states = np.concatenate([net.states(s, x @ net.p[f"w{s}"] + net.p[f"b{s}"], real) for s in "fb"], 2).astype(float)
        z = net.pooled(states, real)[0]
        return (np.log1p(np.exp(z)) - y * z).mean()

    g, _ = net.gradients(x, real, y, np.ones(4))
    for k in ("uf", "ub", "wf", "wb", "mix", "ask", "out", "bf", "bb"):
        i = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old = net.p[k][i]
        ends = []
        for step in (1e-2, -1e-2):
            net.p[k][i] = old + step
            ends.append(loss())
        net.p[k][i] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - g[k][i]) < 1e-4


def test_windows_cover_texts():
    texts = toxicity.Texts.of(*utf8(__import__("pyarrow").array(["a", None, "b " * 16, "c " * 17, "d " * 100])))
    document, first = texts.windows()
    assert np.bincount(document).tolist() == [1, 1, 1, 2, 12]
    seen = {(d, p) for d, f in zip(document, first, strict=True) for p in range(f, min(f + 16, texts.at[d + 1]))}
    assert len(seen) == len(texts.code)


def test_search_is_exact_and_relaxes():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 6))
    x[100:400] = x[100]
    ids = rng.permutation(3000)
    tree, q = vptree.VantagePointTree(x, leaf=20), x[:60]
    want = [np.lexsort((ids, -s))[:10] for s in (q @ x.T).round(9)]
    at, row, score = tree.search(q, 10, ids, np.full(60, -1))
    got = [row[at == i][np.lexsort((ids[row[at == i]], -score[at == i]))] for i in range(60)]
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    at, row, _ = tree.search(q, 10, ids, np.full(60, -1), factor=1.3)
    recall = np.mean([len(set(row[at == i]) & set(want[i])) / 10 for i in range(60)])
    assert recall > 0.5


def fields(data: bytes):
    """(number, begin, end) of a protocol buffer's fields; for numbers, the place of the value."""

    def number(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 2:
            n, at = number(at)
        else:
            n = number(at)[1] - at if tag & 7 == 0 else 4 if tag & 7 == 5 else 8
        yield tag >> 3, at, at + n
        at += n


@pytest.fixture(scope="module")
def unigram():
    """The library with the same pieces and scores, but told that they are a unigram model's."""
    from sentencepiece import SentencePieceProcessor

    raw = open(piece_model(), "rb").read()
    changed = bytearray(raw)
    (trainer,) = [(a, b) for k, a, b in fields(raw) if k == 2]
    (kind,) = [a for k, a, _ in fields(raw[slice(*trainer)]) if k == 3]
    changed[trainer[0] + kind] = 1
    return SentencePieceProcessor(model_proto=bytes(changed))


def test_segmentations(unigram, spark):
    pieces = sentencepiece.Pieces.of(piece_model())
    total = lambda ids: sum(map(unigram.get_score, ids))
    for row in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect():
        text = row.text.replace("\n", " ")[:1500]
        ids = np.frombuffer(pieces.encode(text), "<i4").tolist()
        assert total(ids) >= total(unigram.encode(text)) - 1e-4 * abs(total(ids))
        assert pieces.decode(pieces.encode(text)) == text == unigram.decode(ids)


def test_fractional_scores(tmp_path, prose):
    """A unigram model's scores are fractions: the total is the library's, also by chunks."""
    import struct

    from sentencepiece import SentencePieceProcessor

    raw = open(piece_model(), "rb").read()
    changed = bytearray(raw)
    rng = np.random.default_rng(3)
    for k, a, b in fields(raw):
        for j, c, d in fields(raw[a:b]) if k in (1, 2) else ():
            if k == 1 and j == 2:
                changed[a + c : a + d] = struct.pack("<f", -8 - 2 * rng.random())
            elif k == 2 and j == 3:
                changed[a + c] = 1
    path = str(tmp_path / "fractions.model")
    open(path, "wb").write(bytes(changed))
    library, pieces = SentencePieceProcessor(model_file=path), sentencepiece.Pieces.of(path)
    assert not sentencepiece.is_bpe(path)
    for text in (prose(200, 1), prose(200, 2), "the theory of relativity and other documents " * 5, "中文 x" * 9):
        ids = np.frombuffer(pieces.encode(text), "<i4").tolist()
        total, want = (sum(map(library.get_score, x)) for x in (ids, library.encode(text)))
        assert abs(total - want) < 1e-2
        chunks = list(sentencepiece.cut(sentencepiece.normalise(text), 17, pieces))
        states = sentencepiece.cut_states([pieces.transfer(*c) for c in chunks])
        assert ids == [i for (part, n, place), a, b in zip(chunks, states, states[1:], strict=False) for i in pieces.best(part, n, a, b, place)[0]]


def test_merges(spark, prose):
    """The registered model is BPE: its ids are the library's, of whole texts and of texts in parts."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=piece_model())
    pieces = sentencepiece.Pieces.of(piece_model())
    assert sentencepiece.is_bpe(piece_model())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect()]
    texts += ["", " ", "  a  b ", "a" * 5000, "ab" * 3000, " " * 500, "\x00\x01 x\n\ty", "é中\U0001f600 " * 30, "thetheand$$$$$ 1,234.50 " * 20, "a▁b"]
    for text in texts:
        assert np.frombuffer(pieces.encode(text, merges=True), "<i4").tolist() == library.encode(text)
        for size in (3, 100):
            parts = sentencepiece.cut_apart(sentencepiece.normalise(text[:2000]), size, pieces)
            assert [i for p in parts for s in pieces.segments(p) for i in pieces.merge(s)] == library.encode(text[:2000])
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    for giant in (1 << 16, 50):
        got = {r.doc_id: r for r in sentencepiece.encode(rows, piece_model(), giant=giant, own_rule=True).collect()}
        assert len(got) == len(texts) + 1 and all(got[k].ids == library.encode(t) and got[k].n_tokens == len(got[k].ids) for k, t in enumerate(texts))
        assert got[len(texts)].ids == [] and all(r.round_trip for k, r in got.items() if k != len(texts) - 1)
    want = {r.doc_id: library.encode(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries()["op6_sentencepiece"](spark, "/root/testdata/sf0.001").collect()} == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("size", [1, 3, 17, 100])
def test_chunks(size, prose):
    pieces = sentencepiece.Pieces.of(piece_model())
    for text in (prose(90, 3), "a" * 300, "  " * 40, "中文 x\U0001f600" * 30, "thetheand$$$$$" * 20, "x"):
        chunks = list(sentencepiece.cut(sentencepiece.normalise(text), size, pieces))
        states = sentencepiece.cut_states([pieces.transfer(*c) for c in chunks])
        ids = [i for (part, n, place), a, b in zip(chunks, states, states[1:], strict=False) for i in pieces.best(part, n, a, b, place)[0]]
        assert ids == np.frombuffer(pieces.encode(text), "<i4").tolist()


def test_products_combine_in_any_order():
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(-100, 0, (3, 6, 6))
    p = sentencepiece.product
    assert (p(p(a, b), c) == p(a, p(b, c))).all()


def test_licences_found(prose):
    scanner = licences.Scanner()
    assert len(licences.TEMPLATES) >= 80
    for name, text in licences.TEMPLATES.items():
        (own,) = [m for m in scanner.scan_text(f"prose before\n{text}\nprose after") if m.license == name]
        assert own.missing == 0 and own.added == 0 and own.reduction > 0.2
        if len(words := text.split()) >= 20:  # a few words less or more, here and there
            changed = words[:3] + words[4:10] + ["another"] + words[10:]
            (own,) = [m for m in scanner.scan_text(f"{prose(40, 5)} {' '.join(changed)} {prose(40, 6)}") if m.license == name]
            assert 1 <= own.missing <= 3 and own.added <= 1 + own.missing
    for other in ("this line has a licence to be dull", "free software is nice, says the warranty card of my kettle", ""):
        assert scanner.scan_text(other) == []


def test_licences_against_all_places(spark, prose):
    """Anchors lose nothing: every template over the whole of every text finds the same."""
    scanner, n = licences.Scanner(), 0
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 6000][:150]
    names = list(licences.TEMPLATES)
    texts += [f"{prose(30, i)} {' '.join(w for k, w in enumerate(licences.TEMPLATES[names[i]].split()) if k % 11 != i % 7)} {prose(30, i)}" for i in range(len(names))]
    for text in texts:
        raw = (text or "").encode()
        _, begin, size = licences.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), licences._BETWEEN)
        every = scanner.scan(raw, begin, size, [(name, 0, len(begin)) for name in names])
        key = lambda m: (m.license, m.missing, m.added)
        assert sorted(map(key, scanner.scan_text(text or ""))) == sorted(map(key, every)), text
        n += len(every)
    assert n > 50


UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain."""


def test_licences_wrapped(prose):
    import textwrap

    scanner = licences.Scanner()
    found = lambda text: {m.license for m in scanner.scan_text(f"{prose(300, 1)}\n{text}\n{prose(300, 2)}")}
    assert {"Unlicense"} <= found(UNLICENSE)
    for name, text in licences.TEMPLATES.items():
        for width, indent in ((40, ""), (60, "# "), (80, " * ")):
            assert name in found(textwrap.fill(text, width, initial_indent=indent, subsequent_indent=indent, break_on_hyphens=False, break_long_words=False)), (name, width)


@pytest.mark.parametrize("size", [100, 1300])
def test_licences_in_long_lines(prose, size):
    scanner = licences.Scanner()
    for name, text in licences.TEMPLATES.items():
        line = f"{prose(size, 1)} license {prose(size // 9, 3)} {' '.join(text.split())} {prose(size // 9, 4)} license {prose(size, 2)}"
        assert name in {m.license for m in scanner.scan_text(line)}, name


def test_licences_together(prose):
    scanner = licences.Scanner()
    gpl = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
    grant = "Permission" + licences.TEMPLATES["MIT"].split("Permission", 1)[1]
    statement = licences.TEMPLATES["MIT-statement"]
    for first, second, want in ((statement, gpl, {"MIT-statement", "GPL-2.0"}), (statement, grant, {"MIT-statement", "MIT"})):
        found = scanner.scan_text(f"{first}\n\n{second}")
        assert want <= {m.license for m in found} and all(m.missing == 0 for m in found if m.license in want)
    for between in (0, 3, 12, 40, 300):
        text = f"{statement} {prose(between, 1)} {statement} {prose(between, 2)} {gpl} {prose(between, 3)} {statement} program this released"
        found = scanner.scan_text(text)
        assert sum(m.license == "MIT-statement" for m in found) == 3 and sum(m.license == "GPL-2.0" for m in found) == 1
    text = f"permission {prose(60, 1)} {grant.split(maxsplit=1)[1]}"
    assert [m.missing for m in scanner.scan_text(text) if m.license == "MIT"] == [1]


def test_bundles():
    writer = warc.BundleWriter(frame=1000)
    records = {}
    for i in range(50):
        payload = f"page {i} ".encode() * (i + 1)
        records[f"urn:page:{i}"] = warc.record(i, f"http://x/{i}", payload, warc.bare_digest(payload), len(payload), None, False)
        writer.add(f"urn:page:{i}", records[f"urn:page:{i}"])
    data = writer.close()
    reader = warc.BundleReader(data)
    assert len(reader.sizes) > 5 and all(reader.get(k) == v for k, v in records.items())
    assert [h["WARC-Record-ID"] for h, _ in reader.records()] == [f"<urn:page:{i}>" for i in range(50)]
    import zstandard

    stream = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert stream == b"".join(records.values())
    empty = warc.BundleReader(warc.BundleWriter().close())
    assert list(empty.records()) == []


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "round_trip"]
    rows = got.collect()
    assert 0 < len(rows) < docs.count() and all(r.round_trip for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    clean = pipeline.clean(spark, docs, "/root/testdata/sf0.001")
    assert clean.join(queries()["op10_decontamination"](spark, "/root/testdata/sf0.001").where("contaminated"), "doc_id").isEmpty()


def test_pipeline_keeps_rows_without_ids_or_texts(spark, prose):
    import corpus_pipeline as pipeline

    text = prose(60, 1)
    rows = [(None, None, "a"), (None, None, "b"), (None, "", "c"), (5, None, "d"), (5, "", "e"), (7, text, "f"), (7, text, "g"), (None, text, "h"), (8, prose(50, 2), "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for stage, sources in ((pipeline.different, "abcdei"), (pipeline.clean, "abcdefghi")):
        got = sorted(r.source for r in stage(spark, docs, "/root/testdata/sf0.001").collect())
        assert [x for x in got if x not in "fg" or sources == "abcdefghi"] == list(sources)
        assert len(got) == len(sources) + (stage is pipeline.different)


def test_language_against_all_ranks(spark):
    """The query against the definition, n-gram by n-gram, on whole texts."""
    import zlib
    from collections import Counter

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.lang, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]

    def counts(text):
        out, word = Counter(), ""
        for c in text.lower() + " ":
            if c.isalpha():
                word += c
                continue
            padded = f"\1{word}\1"
            for n in (1, 2, 3) if word else ():
                out.update(p for p in (padded[i : i + n] for i in range(len(padded) - n + 1)) if p.strip("\1"))
            word = ""
        return out

    def ranked(c):
        key = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
        return sorted(c, key=lambda g: (-c[g], key(g)))[:300]

    learnt = {}
    for doc_id, lang, text in rows:
        if lang is not None and zlib.crc32(str(doc_id).encode()) % 5:
            learnt.setdefault(lang, Counter()).update(counts(text))
    profiles = {k: {g: i for i, g in enumerate(ranked(c))} for k, c in learnt.items()}
    got = {r.doc_id: r for r in queries()["op2_language_id"](spark, folder).collect()}
    for doc_id, _, text in rows:
        grams = ranked(counts(text))
        distance = {k: sum(min(abs(i - p[g]), 300) if g in p else 300 for i, g in enumerate(grams)) for k, p in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert got[doc_id].lang_pred == (best if grams else "und")
        assert abs(got[doc_id].score - (1 - distance[best] / (300 * len(grams)) if grams else 0)) < 1e-9


def test_quality_scores_against_rules(spark):
    """The query's column expression against rules held by hand over statistics counted by hand."""
    from pixelframe.llm.common import remainder, table

    folder = "/root/testdata/sf0.001"
    documents = table(spark, folder, "documents")
    model = quality.learn(documents, table(spark, folder, "labels"), remainder("doc_id", 5) > 0)
    got = {r.doc_id: r for r in queries()["op3_quality"](spark, folder).collect()}
    for r in documents.collect():
        text = r.text or ""
        words = [w for w in "".join(c if c not in "\t\n\v\f\r " else " " for c in text).split(" ") if w]
        low = ["".join(c.lower() if c.isascii() else c for c in w).encode() for w in words]
        raw = [b for b in text.encode() if b not in (9, 10, 11, 12, 13, 32)]
        n, size = len(words), max(len(raw), 1)
        is_ = lambda f: sum(map(f, raw))
        letters, upper = is_(lambda b: chr(b).isalpha() and b < 128), is_(lambda b: 65 <= b <= 90)
        stops, marks = is_(lambda b: chr(b) in ".,;:?'\"()-"), is_(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-!|")
        triples = [tuple(low[i : i + 3]) for i in range(max(n - 2, min(n, 1)))]
        x = np.array([[np.log1p(n), size / max(n, 1), letters / size, upper / max(letters, 1), is_(lambda b: 48 <= b < 58) / size, stops / size, marks / size, is_(lambda b: b == 33) / size, is_(lambda b: b == 124) / size, is_(lambda b: b > 127) / size, text.count("\n") / max(n, 1), len(set(low)) / max(n, 1), sum(a == b for a, b in zip(low, low[1:], strict=False)) / max(n, 1), len(set(triples)) / max(len(triples), 1), max((low.count(w) for w in set(low)), default=0) / max(n, 1)]]) if n else np.zeros((1, 15))
        want = 1 / (1 + np.exp(-model.margin(x)[0]))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (want >= 0.3)


def test_toxicity_against_single_windows(spark):
    """The query against the network on one window and one word at a time, with the gates written out."""
    from pixelframe.llm.common import remainder, table

    folder = "/root/testdata/sf0.001"
    documents = table(spark, folder, "documents")
    model = toxicity.learn(documents, table(spark, folder, "labels"), remainder("doc_id", 4).isin(0, 1, 3))
    net, sigmoid = model.network.p, lambda x: 1 / (1 + np.exp(-x))
    got = {r.doc_id: r for r in queries()["op9_toxicity"](spark, folder).collect()}
    s = toxicity.STATE

    def logit(vectors):
        states = []
        for side, order in (("f", 1), ("b", -1)):
            h, out = np.zeros(s), []
            for x in vectors[::order]:
                a, hu = x @ net[f"w{side}"] + net[f"b{side}"], h @ net[f"u{side}"]
                z, r = sigmoid(a[:s] + hu[:s]), sigmoid(a[s : 2 * s] + hu[s : 2 * s])
                h = (1 - z) * np.tanh(a[2 * s :] + r * hu[2 * s :]) + z * h
                out.append(h)
            states.append(out[::order])
        both = np.hstack(states) if len(vectors) else np.zeros((0, 2 * s))
        weight = np.exp(np.tanh(both @ net["mix"]) @ net["ask"])
        pool = (weight[:, None] * both).sum(0) / max(weight.sum(), 1e-9)
        return pool @ net["out"] + net["bias"][0]

    for r in documents.limit(60).collect():
        texts = toxicity.Texts.of(*utf8(__import__("pyarrow").array([r.text])))
        numbers = model.numbers(texts)
        inputs = [np.concatenate([net["words"][numbers[w]], net["runs"][texts.runs_of(np.array([w]))[0]].mean(0)]) for w in range(len(texts.word))]
        words, logits = [inputs[c] for c in texts.code], []
        first = 0
        while True:
            logits.append(logit(np.array(words[first : first + 16])))
            if first + 16 >= len(words):
                break
            first += 8
        top = sorted(logits, reverse=True)
        features = [np.clip(top[k], -6, 12) if k < len(top) else -6.0 for k in (0, 2, 4, 6)]
        want = sigmoid(np.dot(features, model.weights[:-1]) + model.weights[-1])
        assert abs(got[r.doc_id].score - want) < 1e-3, r.doc_id


def test_samples_and_folders(spark):
    from pyspark.sql import functions as F

    from pixelframe.llm import common, samples

    docs = spark.createDataFrame([*((i, "x" * (100 + i)) for i in range(200)), (5, "zz"), (5, "aa"), (None, "y"), (300, "z" * 5000), (301, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*((i, i % 2) for i in range(302)), (7, 0), (8, None), (None, 1)], "doc_id long, quality int")
    every = samples.labelled(docs, labels, "quality", F.lit(True), 1000).collect()
    assert sorted(r.doc_id for r in every) == [*range(200), 300, 301] and {r.doc_id: r.text for r in every}[5] == "aa"
    assert {r.doc_id: r.label for r in every}[7] == 0
    since = common.folders()
    some = samples.labelled(docs, labels, "quality", F.lit(True), 1000, 16_000).collect()
    first = sorted((r for r in every if r.doc_id != 300), key=lambda r: r.order)[: len(some)]
    assert 0 < len(some) < 150 and sum(len(r.text) for r in some) <= 16_000 and {r.doc_id for r in some} == {r.doc_id for r in first}
    (folder,) = common._folders[since:]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = lambda: path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert there()
    common.drop_folders(spark, since)
    assert not there() and common.folders() == since
