"""Corpus operators against brute force, and their defined results on odd rows."""

import re
import zlib
from array import array

import numpy as np
import pytest
from conftest import LINE, cases, passage
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracetide.llm import (
    decontaminate,
    html_extract,
    language,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    quality,
    token_files,
    toxicity,
)
from tracetide.llm.common import scratch, staged
from tracetide.llm.plans import QUERIES
from tracetide.llm.tokens import Encoder, tokenizer_path
from tracetide.llm.words import find_words
from tracetide.session import work_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [r[1] for r in cases()]


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_words_are_those_of_the_rule():
    found = find_words(TEXTS)
    for t, text in enumerate(TEXTS):
        own = [found.phrase(k, 1).decode() for k in range(found.first[t], found.first[t + 1])]
        assert own == words_of(text)
    by_hash = {}
    for k, h in enumerate(found.hash.tolist()):
        assert by_hash.setdefault(h, found.phrase(k, 1)) == found.phrase(k, 1)


def similar_by_hand(texts):
    """{id: (class, links)} from all pairs."""
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else {t} if t else set()
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (find(i), links[i]) for i in ids}


def test_join_finds_all_pairs(spark, sf_dir):
    found = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op1_ngram_jaccard_join"][0](spark, sf_dir).collect()}
    assert found == similar_by_hand(texts_of(spark, sf_dir))


def test_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Blocks of a few classes: pairs across blocks count once."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 7)
    base = passage(1, 200).split()
    texts = {i: " ".join([*base[: i % 150], f"v{i // 4}", *base[i % 150 + 1 :]]) for i in range(60)} | {99: passage(2, 80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(df).collect()}
    assert found == similar_by_hand(texts)


def test_join_of_odd_rows(odd, none):
    found = [tuple(r) for r in ngram_join.similar(odd).collect()]
    assert len(found) == odd.count()
    by_id = dict([(f[0], f[1:]) for f in found])
    assert by_id[1] == (1, 1, 0) and by_id[2] == (2, 2, 0) and by_id[None] == (None, None, 0)
    assert by_id[6] == (5, 5, by_id[5][2]) and by_id[12][0] == 11 and by_id[9][0] == 8
    assert by_id[7][2] >= 1  # its repeated row
    assert ngram_join.similar(none).count() == 0
    assert ngram_join.stage(None, none, "").columns == none.columns


def test_bands_reach_the_recall():
    bands = ngram_join.bands_for(0.9999, 0.8, 5)
    assert 1 - (1 - 0.8**5) ** bands >= 0.9999 > 1 - (1 - 0.8**5) ** (bands - 1)


def test_decontamination_modes(spark, odd, none):
    bench = spark.createDataFrame([(1, passage(11, 60)), (2, "one two"), (None, "x"), (3, None)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contamination(decontaminate.window_hits(odd, bench)).drop("spans", "th").collect()), key=repr)
    sliced = decontaminate.window_hits(odd, bench, max_set_bytes=300)
    assert sorted(map(tuple, decontaminate.contamination(sliced).drop("spans", "th").collect()), key=repr) == whole
    assert {r[0] for r in whole if r[-1]} == {11, 12, 13}
    left = decontaminate.without_documents(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(odd, bench).collect()}
    assert cut[12] == "more" and cut[13] == "" and cut[5] == LINE and cut[1] is None
    assert decontaminate.without_documents(none, bench).count() == 0
    assert decontaminate.without_documents(odd, bench.limit(0)).count() == odd.count()


def test_languages_of_held_out_documents(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op3_language_id"][0](spark, sf_dir).collect()
    assert len(found) == len(langs)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.95


def test_language_mixtures(spark, odd, none, sf_dir):
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    en, de = (docs.where(f"lang = '{x}' AND n_chars > 1500").orderBy("doc_id").first().text[:1500] for x in ("en", "de"))
    name, share, parts = model.mixture(en + " " + de)
    assert {n for n, _ in parts} == {"en", "de"} and 0.3 < share < 0.7
    assert [n for n, _ in model.mixture(en)[2]] == ["en"]
    found = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} >= {1, 2, 3, 4}
    assert all(0 <= r.score <= 1 for r in found.values())
    empty = language.train(none)
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_encoder_equals_the_library(spark, sf_dir):
    encoder, plain = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    odd_texts = ["it's 1x2 ½ ² ª_b __ a-b 'sss 'S \x1c\x85a", " a b", "é é", "İ ı ŉ Σς ﬁ", "don't.we'll!!?x" * 30]
    for text in [*TEXTS, *odd_texts, *list(texts_of(spark, sf_dir).values())[:60]]:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert array("I", encoder.encode(text)).tolist() == ids


@pytest.fixture(scope="session")
def ids_of(spark, sf_dir):
    plain = Tokenizer.from_file(tokenizer_path())
    return {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts_of(spark, sf_dir).items()}


def test_token_files_round_trip(spark, sf_dir, ids_of, odd, none):
    found = {r.doc_id: r for r in QUERIES["op4_token_files"][0](spark, sf_dir).collect()}
    at = 0
    for i in sorted(ids_of):
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids_of[i]), zlib.crc32(ids_of[i].tobytes()))
        at += len(ids_of[i])
    for docs, encoding in ((odd, "delta"), (none, "dictionary")):
        path = work_path(spark, "token-files")
        token_files.write_tokens(docs, path, encoding=encoding)
        back = token_files.read_tokens(spark, path)
        assert back.count() == docs.count()
        places = sorted((r.start, r.n_tokens) for r in back.collect())
        assert all(a[0] + a[1] == b[0] for a, b in zip(places, places[1:], strict=False))
        one = back.where("doc_id = 5")
        assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)" in one._jdf.queryExecution().toString()


def test_packing(spark, sf_dir, ids_of, odd, none):
    found = sorted(QUERIES["op10_packing"][0](spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.start))
    at = {}
    for r in found:
        ids = ids_of[r.doc_id]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in ids_of.items()}
    fill = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
    assert 1 - sum(fill.values()) / (2048 * len(fill)) < 0.02
    assert packing.packed(packing.token_pieces(none)).count() == 0
    pieces = packing.packed(packing.token_pieces(odd)).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_differencing_is_near_equal():
    lengths = np.random.default_rng(3).integers(1, 512, 400)
    sums = [int(lengths[g].sum()) for g in packing.differencing(lengths, 40)]
    assert sum(sums) == lengths.sum() and max(sums) - min(sums) <= 40
    assert packing.differencing(np.array([5, 5, 4, 3, 3]), 2) is not None
    assert packing.windows(np.array([], dtype=np.int64)) == []
    groups = packing.windows(np.array([2000, 2000, 100, 47, 1]), 2048)
    assert sorted(i for g in groups for i in g) == [0, 1, 2, 3, 4] and len(groups) == 3


def test_pages(spark, sf_dir, none):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r for r in QUERIES["op5_html_extraction"][0](spark, sf_dir).collect()}
    assert len(found) == pages.count()
    import html

    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = (re.sub(r"<[a-z/][^>]*>", lambda m: " " if "br" in m[0] else "", b) for b in re.split(r"</?(?:p|h1)>", article))
        text = "\n\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)
        assert (found[page.page_id].text, found[page.page_id].n_chars) == (text, len(text))
    weights = html_extract.train(pages)
    assert html_extract.extract(
        '<body><div class="menu">Home About</div><header>Site</header><div><h2>Title</h2><p>One two &lt;b&gt; three.<br>four <b>bo</b>ld'
        '<p>3 < 4<!-- no --><script>x("</p>")</script><div id="comments"><p>nice post here</div><ul><li>item<li>two</ul></div><footer>me',
        weights,
    ) == "Title\n\nOne two <b> three. four bold\n\n3 < 4\n\nitem\n\ntwo"
    assert [html_extract.extract(p, weights) for p in (None, "", "<p", "<nav>a b</nav>", "plain text")] == ["", "", "", "", "plain text"]
    odd_pages = spark.createDataFrame([(None, None, None), (1, None, ""), (1, "u", "<p>a&amp;b")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_extract.extracted(odd_pages, html_extract.train(odd_pages)).collect()) == ["", "", "a&b"]


def test_pages_whose_markup_misleads(spark, sf_dir):
    """Side names that wrap the page or speak of side matter elsewhere, titles in article headers, teasers, stray tags."""
    import time

    body = "".join(f"<p>Sentence {k} goes on for some more words of the main text.</p>" for k in range(20))
    text = "\n\n".join(f"Sentence {k} goes on for some more words of the main text." for k in range(20))
    for weights in (html_extract.weigh({}), html_extract.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))):
        found = lambda page: html_extract.extract(page, weights)  # noqa: E731, B023
        assert found(f"<body><form action='x'><div class=menu><a href=1>Home</a></div><div>{body}</div></form></body>") == text
        assert found(f"<div class='content has-sidebar'>{body}<div class=sidebar><a href=1>x</a> side words</div></div>") == text
        assert found(f"<header>Site</header><article><header><h1>Title</h1></header>{body}</article><footer>f</footer>") == "Title\n\n" + text
        assert found(f"<article>{body}</article><div class=comments><article><header>Bob</header><p>nice</p></article></div>") == text
        assert found(f"<div class=promo><article>{body}</article></div><p>outside") == text
        assert text in found(f"<article><p>A short teaser.</p></article><div id=column>{body}</div>")
        begun = time.time()
        assert found("<div>" * 30_000 + "</b>" * 30_000 + "<nav>" * 5000 + "x" + "</nav>" * 5000) == ""
        assert time.time() - begun < 10


def test_labelled_pages_teach_side_names():
    """A class that encloses the articles of labelled pages is no side matter."""
    page = "<div class=widget><article>" + "<p>some words of the text here</p>" * 9 + "</article></div><div class=promo>buy now and here</div><p>tail " * 3
    pages = [page] * 30
    total = sum((html_extract.label_counts(p) for p in pages), html_extract.Counter())
    counts = {(kind, name): (total[kind, name, True], total[kind, name, False]) for kind, name, _ in total}
    weights = html_extract.weigh(counts)
    assert weights.words["side:widget"] > 0 > weights.words["side:promo"]


def test_rules_keep_good_documents(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    found = quality.judged(docs).where("NOT base_failed").collect()
    assert np.mean([r.kept for r in found if r.quality == 1]) >= 0.98
    assert np.mean([r.kept for r in found if r.quality == 0]) <= 0.1
    judged = quality.judged(odd)
    assert sorted(judged.columns) == sorted({*odd.columns, *quality.RESULTS}) and judged.count() == odd.count()
    assert {r.doc_id for r in judged.where("kept").collect()} == {8, 9, 11, 12}
    assert quality.judged(none).count() == 0
    assert quality.stage(None, odd, "").columns == odd.columns


def test_sketches_merge(odd):
    """Cutoffs from merged sketches where a group is small, and null groups of their own."""
    rated = quality._rates(quality.measures(odd.withColumnsRenamed({"lang": "__lang", "source": "__source"}).drop(*quality.RESULTS)))
    parts = quality.sketches(rated)
    assert parts.count() == odd.select("lang", "source").distinct().count()
    wide = {(r["__lang_cut"], r["__source_cut"]): r["__symbol_rate_high"] for r in quality.thresholds(parts).collect()}
    assert len(wide) == parts.count() and all(v is not None for v in wide.values())


def test_line_dedup_of_odd_rows(odd, none):
    found = {r.doc_id: r for r in line_dedup.deduplicated(odd).collect()}
    assert found[9].text == "end" and found[8].n_removed == 0
    assert found[10].text == "\n".join([LINE] * 3)  # the first window of a repeated line stays whole
    assert found[17].text == "a\n\n\nb\n\nc" and found[1].text is None and found[1].n_lines == 0
    assert line_dedup.deduplicated(odd).count() == odd.count()
    assert line_dedup.deduplicated(none).columns == [*none.columns, "n_lines", "n_removed"]
    assert line_dedup.stage(None, odd, "").columns == odd.columns


def test_license_rules(spark, odd, none):
    texts = {
        1: "SPDX-License-Identifier: GPL-3.0-or-later", 2: "see https://www.apache.org/licenses/LICENSE-2.0 for terms",
        3: "Licensed under the GNU Lesser General Public License, version 2.1 and the ISC license.", 4: "CC BY-NC-SA 4.0",
        5: "under the same terms as Perl itself", 6: "mit dem lizenz", 7: None,
        8: "released under the mozilla public license, version 2.0 " * 50,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scanned(df).collect()}
    assert [found[i].labels for i in range(1, 8)] == ["gpl-3", "apache-2", "isc,lgpl-2.1", "cc-by-nc,cc-by-nc-sa", "perl", "", ""]
    assert len(found[8].found) == 50 and found[1].score == 0.99 and found[7].score == 0.0
    assert found[4].base_labels == "cc-by-nc"
    assert sorted(licenses.scanned(odd).columns) == sorted({*odd.columns, "n_base", "first_word", "last_word", "base_labels", "labels", "found"})
    both = licenses.scanned(odd).where("doc_id = 16").first()
    assert (both.n_base, both.first_word, both.last_word) == (2, 0, 4)
    assert licenses.scanned(none).count() == 0


def test_license_texts(spark):
    """Sentences of licence texts, over line ends, win over names inside them."""
    texts = {
        1: "Permission is hereby granted, free of charge,\n  to any person obtaining a copy of this software and associated files",
        2: "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the X nor the names of its contributors may be used to endorse or promote it.",
        3: "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published, either version 3 of the License, or (at your option) any later version",
        4: "You may not use this file except in compliance with the License.", 5: "permission was granted free of charge",
    }
    found = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [found[i].labels for i in range(1, 6)] == ["mit", "bsd,bsd-3-clause", "gpl,gpl-3", "apache-2", ""]
    assert [found[i].score for i in (1, 5)] == [0.97, 0.0]


def test_license_scan_of_a_very_long_text(spark):
    """Thousands of mentions take seconds, not minutes; their places are right."""
    import time

    text = "under the MIT License, see x. " * 12_000
    begun = time.time()
    r = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.time() - begun < 60
    assert r.n_base == 12_000 and r.labels == "mit" and len(r.found) == 12_000
    at = [d["start"] for d in r.found]
    assert all(text[a : a + 15].lower() in ("the mit license", "under the mit l"[:15]) for a in at[::997]) and at == sorted(at)


def test_every_rule_has_its_keyword_and_gate():
    """A rule's own name, identifier or address passes its gates."""
    from tracetide.llm.license_rules import GATES, rules

    known = rules()
    assert len(known) > 200 and len({r.pattern for r in known}) == len(known)
    for rule in known:
        sample = re.sub(r"\(\?:([^()|]*?)(?:\|[^()]*)?\)\??", lambda m: "" if m[0].endswith("?") else m[1], rule.pattern)
        for _ in range(3):
            sample = re.sub(r"\(\?:([^()|]*?)(?:\|[^()]*)?\)\??", lambda m: "" if m[0].endswith("?") else m[1], sample)
        sample = re.sub(r"\[\^\.\]\{[0-9,]+\}", "it", sample.replace("[ \\t\\r\\n]+", " ")).replace("[:;]", ";")
        sample = sample.replace("licen[cs]e", "license").replace("[ \\t]*", " ").replace("\\", "").replace("[ -]", " ")
        sample = re.sub(r"\[(\S)[^\]]*\]\??\+?", r"\1", sample).replace("share-?a", "share-a").replace("non-?c", "non-c").replace("no-?d", "no-d").replace("open ?r", "openr").replace(",?", ",")
        assert re.search(rule.pattern, sample), (rule, sample)
        assert rule.keyword in sample and any(g in sample for g in GATES), (rule, sample)


def toxic_rows(n):
    """Toxic documents have one sentence with a bad word; the rest is the same kind of text."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        body = [" ".join(f"word{k}" for k in rng.integers(0, 300, 8)) for _ in range(rng.integers(1, 12))]
        toxic = int(i % 6 == 0)
        if toxic:
            body.insert(int(rng.integers(0, len(body) + 1)), "you are a foulword indeed")
        out.append((i, ". ".join(body), toxic))
    return out


def test_toxicity_learns_sentences(spark, odd, none):
    rows = toxic_rows(900)
    model = toxicity.fit([r[1] for r in rows[:600]], [r[2] for r in rows[:600]])
    for (_, text, toxic), (score, bad) in zip(rows[600:], model.score([r[1] for r in rows[600:]]), strict=True):
        assert (score >= 0.7) == bool(toxic)
        if toxic:
            assert len(bad) == 1 and "foulword" in words_of(text)[bad[0][0] : bad[0][1] + 1]
    found = {r.doc_id: r for r in toxicity.scored(odd, model).collect()}
    assert found[1].score == found[2].score == pytest.approx(model.leak) and all(0 <= r.score <= 1 for r in found.values())
    assert toxicity.scored(none, model).count() == 0
    empty = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.scored(odd, empty).collect()} == {0}


def test_toxicity_query(spark, sf_dir):
    found = QUERIES["op9_toxicity"][0](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in found)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [r.predicted for r in found if labels.get(r.doc_id) == 0]
    assert np.mean(clean) <= 0.02


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = quality.stage(spark, docs, sf_dir)
    good = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    lines = line_dedup.stage(spark, kept, sf_dir)
    assert lines.where("n_chars <> length(text)").count() == 0
    joined = ngram_join.stage(spark, lines, sf_dir)
    by_hand = similar_by_hand({r.doc_id: r.text for r in lines.collect()})
    assert {r.doc_id for r in joined.collect()} == {i for i, (root, _) in by_hand.items() if root == i}
    clean = decontaminate.stage(spark, joined, sf_dir)
    assert clean.columns == docs.columns
    items = [words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {" ".join(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    bad = set()
    texts = {r.doc_id: r.text for r in joined.collect()}
    for i, text in texts.items():
        w = words_of(text)
        if any(" ".join(w[k : k + 10]) in grams for k in range(len(w))):
            bad.add(i)
    assert {r.doc_id for r in clean.collect()} == set(texts) - bad
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(texts) - bad


def test_join_of_rows_that_share_an_id(spark):
    """Classes are texts: a repeated id stands for each of its texts."""
    a, b = passage(1, 60), passage(2, 60)
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " more"), (3, a), (3, a + " more")], "doc_id long, text string")
    found = sorted(tuple(r) for r in ngram_join.similar(df).select("doc_id", "class_id", "n_links").collect())
    assert found == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (3, 1, 2)]


CLASHES = ["__id", "__th", "__words", "__lang", "__lang_cut", "__spans", "__gone", "__split", "__n_lines", "__copies", "kept__id", "key", "root", "band", "th", "mask", "h1"]


def test_columns_named_like_helpers(spark, odd, none):
    """They pass through every stage with their values."""
    bench = spark.createDataFrame([(1, passage(11, 60)), (2, "one two")], "item_id long, text string")
    for table in (odd, none):
        docs = table.select("*", *(odd.doc_id.alias(c) if table is odd else table.doc_id.alias(c) for c in CLASHES))
        results = [
            quality.judged(docs), line_dedup.deduplicated(docs), ngram_join.stage(None, docs, ""),
            decontaminate.without_documents(docs, bench), decontaminate.without_spans(docs, bench), quality.stage(None, docs, ""), line_dedup.stage(None, docs, ""),
        ]
        for found in results:
            assert set(docs.columns) - set(quality.RESULTS) - {"n_lines"} <= set(found.columns)
            for r in found.collect():
                assert all(r[c] == r["doc_id"] for c in CLASHES)


def test_decontamination_moves_no_rows(spark, odd):
    bench = spark.createDataFrame([(1, passage(11, 60))], "item_id long, text string")
    plan = decontaminate.without_documents(odd, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Join" not in plan


def test_packing_of_many_tiny_pieces(spark):
    """Memory follows the pieces, not pieces times windows."""
    import tracemalloc

    tracemalloc.start()
    groups = packing.windows(np.ones(60_000, dtype=np.int64), 2048)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert sorted(i for g in groups for i in g) == list(range(60_000)) and max(map(len, groups)) <= 2048
    pieces = spark.range(30_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0L AS start", "1L AS length", "id AS ids_crc32", "1L AS doc_tokens")
    found = packing.packed(pieces, batch_windows=8).collect()
    assert len(found) == 30_000 and len({(r.sequence_id, r.offset) for r in found}) == 30_000


def test_differencing_equals_a_dense_one():
    """Against partitions with all their k sums."""

    def dense(lengths, k):
        parts = [([(int(x), [i])] + [(0, [])] * (k - 1)) for i, x in enumerate(lengths)]
        parts = [parts[i] for i in np.argsort(-lengths, kind="stable")]
        order = list(range(len(parts)))
        tie = len(parts)
        while len(parts) > 1:
            first = min(range(len(parts)), key=lambda p: (-parts[p][0][0], order[p]))
            a, _ = parts.pop(first), order.pop(first)
            second = min(range(len(parts)), key=lambda p: (-parts[p][0][0], order[p]))
            b, _ = parts.pop(second), order.pop(second)
            merged = sorted(((x + y, g + h) for (x, g), (y, h) in zip(a, reversed(b), strict=True)), key=lambda s: -s[0])
            parts.append([(s - merged[-1][0], g) for s, g in merged])
            order.append(tie)
            tie += 1
        return sorted(sorted(g) for _, g in parts[0])

    rng = np.random.default_rng(9)
    for _ in range(150):
        lengths, k = rng.integers(1, 30, rng.integers(1, 40)), int(rng.integers(1, 14))
        assert sorted(sorted(g) for g in packing.differencing(lengths, k)) == dense(lengths, k)


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(4)
    n = 300
    if kind == "path":
        order = rng.permutation(n).tolist()
        edges = list(zip(order, order[1:], strict=False))
    else:
        edges = [(0, i) for i in range(1, n)] if kind == "star" else rng.integers(0, n, (220, 2)).tolist() if kind == "random" else []
    found = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    assert set(found) == set(root)
    groups, want = {}, {}
    for x in root:
        groups.setdefault(found[x], set()).add(x)
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and all(r in g for r, g in groups.items())


def test_rounds_of_components_are_written_by_as_few_tasks_as_their_edges_need(spark, monkeypatch):
    """A path of 300 nodes takes some rounds; tables of a few rows were cut into one file for each shuffle partition."""
    order = np.random.default_rng(4).permutation(300).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    written = []

    def counted(df, label):
        out = staged(df, label)
        written.append((label, df.rdd.getNumPartitions(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    parts, adaptive = (spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.root for r in ngram_join.components(edges).collect()} == {0}
        assert len(written) > 4 and {tasks for _, tasks, _ in written[1:]} == {1}
        # more edges, more tasks
        written.clear()
        monkeypatch.setattr(ngram_join, "TASK_EDGES", 100)
        assert {r.root for r in ngram_join.components(edges).collect()} == {0}
        assert written[1][:2] == ("labels", 6) and written[-1][:2] == ("components", 6) and {rows for *_, rows in (written[1], written[-1])} == {300}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


@pytest.fixture(scope="session")
def larger_dir():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("test tables are absent")
    return path


def test_join_on_the_larger_tables(spark, larger_dir):
    """Recall of links against all pairs of a thousand documents."""
    found = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op1_ngram_jaccard_join"][0](spark, larger_dir).collect()}
    want = similar_by_hand(texts_of(spark, larger_dir))
    links, known = sum(n for _, n in found.values()), sum(n for _, n in want.values())
    assert known > 0 and 0.99 * known <= links <= known
    assert np.mean([found[i] == w for i, w in want.items()]) >= 0.99


def test_toxicity_of_held_out_documents(spark, larger_dir):
    """A few hundred labels: most toxic rows are found, clean ones left alone."""
    found = QUERIES["op9_toxicity"][0](spark, larger_dir).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger_dir}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id], r.predicted) for r in found if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = [s for s, y, _ in rows if y == 1], [s for s, y, _ in rows if y == 0]
    wins = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert wins >= 0.85
    assert np.mean([p for _, y, p in rows if y == 1]) >= 0.7 and np.mean([p for _, y, p in rows if y == 0]) <= 0.02


def test_toxicity_scores_equal_a_plain_noisy_or():
    rows = toxic_rows(300)
    model = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    weight = {}

    def of(word):
        if word not in weight:
            at = model.numbers(find_words([word]).hash)[0]
            weight[word] = None if at < 0 else float(model.weights[at])
        return weight[word]

    texts = [*(r[1] for r in rows[:80]), "", None, "no sign here", "foulword! foulword foulword.\nyou are a foulword?"]
    for text, (score, bad) in zip(texts, model.score(texts), strict=True):
        clear, offending = 1 - model.leak, 0
        for sentence in re.split(r"[.!?\n]", text or ""):
            known = [w for w in map(of, words_of(sentence)) if w is not None]
            if known:
                p = 1 / (1 + np.exp(-(model.bias + sum(known))))
                clear *= 1 - p
                offending += p >= toxicity.OFFENDING
        assert score == pytest.approx(1 - clear, abs=1e-9) and len(bad) == offending


def mixture_by_hand(text, table, step, active):
    """Chosen languages of {name: {gram: weight}}: plain expectation-maximisation, the smallest share goes first."""
    grams = language.gram_buckets(text).tolist()
    seen = {g: grams.count(g) for g in set(grams)}

    def fitted(shares):
        for _ in range(language.ROUNDS if len(shares) > 1 else 0):
            new = dict.fromkeys(shares, 0.0)
            for g, n in seen.items():
                whole = sum(shares[x] * table[x][g] for x in shares)
                for x in shares:
                    new[x] += n * shares[x] * table[x][g] / whole / len(grams)
            done = max(abs(new[x] - shares[x]) for x in shares) < 1e-3
            shares = new
            if done:
                break
        return shares, sum(n * np.log(sum(shares[x] * table[x][g] for x in shares)) for g, n in seen.items())

    shares, fit = fitted(dict.fromkeys(active, 1 / len(active)))
    while len(shares) > 1:
        least = min(shares, key=shares.get)
        rest = sum(v for x, v in shares.items() if x != least)
        fewer, fit_fewer = fitted({x: v / rest for x, v in shares.items() if x != least})
        if fit - fit_fewer > step * np.log(len(grams)):
            break
        shares, fit = fewer, fit_fewer
    return shares


def tongues(spark, count):
    """A row for each of many languages that share no word, and mixed texts."""
    rng = np.random.default_rng(3)
    lexicon = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for _ in range(count)]
    own = [" ".join(rng.choice(words, 40)) for words in lexicon]
    rows = [(k, own[k], f"tongue{k:03}") for k in range(count)]
    mixed = [(1000 + k, f"{own[k]} {own[(k + count // 2) % count]}", None) for k in range(0, count, max(1, count // 5))]
    return spark.createDataFrame([*rows, *mixed, (2000, None, None), (2001, "a", None)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("block", [2, 256])
def test_language_blocks_equal_a_plain_mixture(spark, monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    docs = tongues(spark, 5)
    found = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    rows = docs.collect()
    table = {}
    for r in rows:
        if r.lang:
            counts = np.bincount(language.gram_buckets(r.text), minlength=language.BUCKETS) + language.SMOOTHING
            table[r.lang] = counts / counts.sum()
    names = sorted(table)
    for r in rows[:-2]:
        chosen = []
        for k in range(0, len(names), block):
            shares = mixture_by_hand(r.text, table, language.PENALTY, [*chosen, *names[k : k + block]])
            chosen = sorted(shares, key=lambda x: (-shares[x], x))
        assert [x.lang for x in found[r.doc_id].languages] == chosen
        assert [x.share for x in found[r.doc_id].languages] == pytest.approx([shares[x] for x in chosen])
        assert found[r.doc_id].lang_pred == chosen[0] and found[r.doc_id].score == pytest.approx(shares[chosen[0]])
        assert r.lang is None or found[r.doc_id].lang_pred == r.lang
        assert r.lang or len(chosen) == 2
    assert (found[2000].lang_pred, found[2000].score) == ("und", 0.0)


def test_more_languages_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 3)
    docs = tongues(spark, 300).withColumnsRenamed({"lang": "likelihoods"}).withColumn("c0", F.lit("own"))
    model = language.train(docs.withColumnRenamed("likelihoods", "lang"))
    assert len(model.names) == language.BLOCK and len(model.following().names) == 300 - language.BLOCK
    found = language.predict(docs, model, ("doc_id", "likelihoods", "c0"))
    assert found.columns == ["doc_id", "likelihoods", "c0", "lang_pred", "score", "languages"]
    rows = found.collect()
    assert len(rows) == docs.count() and {r.c0 for r in rows} == {"own"}
    assert all(r.lang_pred == r.likelihoods for r in rows if r.likelihoods)
    assert all(len(r.languages) == 2 for r in rows if 1000 <= r.doc_id < 2000)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rows = toxic_rows(600)
    docs = spark.createDataFrame([(i, text) for i, text, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic) for i, _, toxic in rows], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels)
    same_id = spark.range(3000).select(F.lit(1).alias("doc_id").cast("long"), F.concat(F.lit("again "), "id").alias("text"))
    sizes = []

    def noted(df, *args):
        sizes.append(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first())
        return repartition(df, *args)

    repartition = type(docs).repartition
    again = toxicity.train(docs.union(docs), labels)
    assert (again.words == whole.words).all() and np.allclose(again.weights, whole.weights)
    monkeypatch.setattr(type(docs), "repartition", noted)
    assert toxicity.train(docs.union(same_id), labels, 400).bias <= 0
    assert toxicity.train(docs, labels, 400, 5000).bias <= 0
    assert sizes[0][0] <= 400 and 0 < sizes[1][1] <= 5000


def test_token_files_of_an_id_with_many_rows(spark):
    docs = spark.range(4000).select(
        F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
    )
    path = work_path(spark, "hot-id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(f"{path}/index").collect()
    assert len(parts) > 1 and max(p.n_docs for p in parts) < 0.6 * 4000
    back = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.read_tokens(spark, path).collect())
    assert [r[2] for r in back] == sorted(r[2] for r in back) and len(back) == 4000
    assert all(b[0] == a[0] + a[1] for a, b in zip(back, back[1:], strict=False)) and back[0][0] == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_only_a_vocabulary_with_the_known_rule_takes_the_short_way(name):
    encoder, plain = Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    assert encoder.plain == (name == "word_bpe_49k.json")
    for text in [*TEXTS, "Don't  STOP at 12 cafés, we'll"]:
        assert encoder.encode(text) == array("I", [*plain.encode(text or "", add_special_tokens=False).ids, 1]).tobytes()


def test_pieces_beyond_the_cache(monkeypatch, spark, sf_dir):
    monkeypatch.setattr("tracetide.llm.tokens._LIMIT", 50)
    encoder, plain = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in [*list(texts_of(spark, sf_dir).values())[:40], "x''s '''s -'s 'S'T _a_ ŉ't"]:
        assert encoder.encode(text) == array("I", [*plain.encode(text or "", add_special_tokens=False).ids, 1]).tobytes()
    assert len(encoder.pieces) == 50


def test_scratch_deletes_what_was_staged_inside(spark):
    path = work_path(spark, "lasting")
    with scratch(spark):
        inner = staged(spark.range(5).toDF("n"), "passing")
        with scratch(spark):
            staged(inner, "deeper")
        own = staged(inner.where("n > 1"), "own", path)
    assert own.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        inner.count()


def test_pipeline_keeps_only_its_last_tables(spark, sf_dir, monkeypatch, tmp_path):
    import corpus_pipeline
    from tracetide import session

    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, sf_dir)
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert left == ["decontamination", "pieces"]
    assert out.count() > 0
