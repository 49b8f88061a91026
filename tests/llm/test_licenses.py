import math
import re

import pytest

from docquarry.llm import licenses


def words_of(text):
    """Lower-case words of letters, digits and inner full stops."""
    return [w for w in re.sub(r"\.( |$)", " ", re.sub(r"[^a-z0-9.]", " ", text.lower())).split(" ") if w]


def threes(words):
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


TEMPLATES = {f: [threes(words_of(t)) for t in ts] for f, ts in licenses.TEMPLATES.items()}
KNOWN = set().union(*(t for ts in TEMPLATES.values() for t in ts))


def judged(words, corpus=()):
    """(family, probability, overlap, shared) by the model's weights; overlaps counted here."""
    m = licenses.model(corpus)
    gs = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    logits = [(sum(m.weights[i, k] for i, f in enumerate(m.features) if f in gs) / math.sqrt(max(1, len(gs))) + m.bias[k]) / m.temperature for k in range(len(licenses.LABELS))]
    k = max(range(len(logits)), key=lambda i: (logits[i], -i))
    three, family = threes(words), licenses.LABELS[k]
    shared = [(len(three & t) / max(1, min(len(three), len(t))), len(three & t)) for t in TEMPLATES.get(family, [])]
    return family, 1 / sum(math.exp(v - logits[k]) for v in logits), max((s[0] for s in shared), default=0.0), max((s[1] for s in shared), default=0)


def brute(text, probability=licenses.PROBABILITY, overlap=licenses.TEMPLATE_OVERLAP, corpus=()):
    """(number of paragraphs, notices as (paragraph, family, probability)) of a text."""
    paragraphs, notices = [[]], []
    for line in (text or "").split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    paragraphs = [p for p in paragraphs if p]
    passes = lambda v: v[0] != licenses.UNKNOWN and v[1] >= probability and v[2] >= overlap
    for i, lines in enumerate(paragraphs):
        if overlap > 0 and not threes(words_of(" ".join(lines))) & KNOWN:
            continue
        split = [words_of(x) for x in lines]
        hits = [k for k, w in enumerate(split) if w and (overlap == 0 or threes(w) & KNOWN)]
        passage = sum(split[hits[0] : hits[-1] + 1], []) if hits else words_of(" ".join(lines))
        whole = judged(passage, corpus)
        single = [v for v in (judged(split[k], corpus) for k in hits) if passes(v)] if len(hits) > 1 else []
        found = [whole] if passes(whole) and whole[3] > max((v[3] for v in single), default=0) else single
        notices += [(i, v[0], v[1]) for v in found]
    return len(paragraphs), notices


def same(row, want):
    n, notices = want
    assert (row.n_paragraphs, row.n_unknown) == (n, n - len({w[0] for w in notices}))
    assert [(x.paragraph, x.family) for x in row.notices] == [w[:2] for w in notices]
    assert [x.probability for x in row.notices] == pytest.approx([w[2] for w in notices], abs=1e-9)


def test_templates_and_others(spark):
    texts = [t.capitalize() + "." for ts in licenses.TEMPLATES.values() for t in ts] + licenses.OTHERS
    families = [f for f, ts in licenses.TEMPLATES.items() for _ in ts] + [None] * len(licenses.OTHERS)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, corpus=()).collect()}
    right = sum(got[i].family == f for i, f in enumerate(families))
    assert right >= 0.97 * len(texts)
    for i, t in enumerate(texts):
        same(got[i], brute(t))


GPL = "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public\nLicense as published by the Free Software Foundation, either\nversion 3 of the License, or (at your option) any later version."


def test_wrapped_notices_and_paragraphs(spark):
    texts = [GPL, "Some prose here.\n" + GPL + "\nMore prose, of the kind.", "a\n\nReleased under the MIT License.\n \t\nb", "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nz", "permission is hereby\ngranted free of\ncharge to any\nperson obtaining a copy of this\nsoftware and associated\ndocumentation files", "permission\nis\nhereby\ngranted\nfree\nof charge", "\n\n\nthe license\n\n\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, corpus=()).collect()}
    for i, t in enumerate(texts):
        same(got[i], brute(t))
    assert [got[i].family for i in range(5)] == ["gpl", "gpl", "mit", "mit", "mit"]
    assert [n.family for n in got[3].notices] == ["mit", "cc-by-nc"] and got[2].n_paragraphs == 3


def test_table_lines(spark):
    prose = "Thhaen the ouat of ing.\n"
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    for gap, paragraphs, at in (("", 1, 0), ("\n", 5, 3)):
        docs = spark.createDataFrame([(i, (prose + gap) * 3 + x + "\n" + gap + prose) for i, x in enumerate(lines)], "doc_id long, text string")
        got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
        for i, family in enumerate(lines.values()):
            assert got[i].family == family and got[i].n_paragraphs == paragraphs and got[i].n_unknown == paragraphs - 1
            assert [n.paragraph for n in got[i].notices] == [at]


def test_unknown_class_learns_from_the_corpus(spark, sf):
    """Held-out paragraphs of the corpus are unknown, templates are not, and the unknown class's probabilities are calibrated."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sample = licenses.corpus_sample(docs)
    assert 200 < len(sample) <= licenses.SAMPLE_PARAGRAPHS and sample == licenses.corpus_sample(docs.repartition(5))
    held = [words_of(x) for x in sample[1::2]]
    held = [w for w in held if w and not threes(w) & KNOWN]
    verdicts = [judged(w, sample) for w in held]
    recall = sum(v[0] == licenses.UNKNOWN for v in verdicts) / len(held)
    mean = sum(v[1] if v[0] == licenses.UNKNOWN else 1 - v[1] for v in verdicts) / len(held)
    assert recall >= 0.97 and abs(mean - recall) < 0.05
    found = [judged(words_of(t), sample)[0] == f for f, ts in licenses.TEMPLATES.items() for t in ts]
    assert sum(found) >= 0.97 * len(found)


def test_odd_rows(spark):
    both = "Released under the MIT License.\nReleased under the MIT License."
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t\n", 0), (None, both, 0), (4, "license " * 30_000, 0), (4, both, 0), (4, both, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v int")
    out = licenses.scan_licenses(docs, corpus=()).collect()
    assert [(r.doc_id, r.n_paragraphs, r.family, len(r.notices)) for r in out] == [(1, 0, None, 0), (2, 0, None, 0), (3, 0, None, 0), (None, 1, "mit", 2), (4, 1, None, 0), (4, 1, "mit", 2), (4, 1, "mit", 2)]
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 1, 2, 3, 4, "x")], "doc_id long, text string, _model int, _parts int, able int, w int, family string")
    row = licenses.scan_licenses(docs).first()
    assert (row._model, row._parts, row.able, row.w, row.family) == (1, 2, 3, 4, "mit")


def test_every_paragraph_is_judged(spark):
    bare = {"Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.": "proprietary", "Content is available under CC BY-SA 4.0.": "cc-by-sa", "Distributed under CC BY 4.0.": "cc-by"}
    texts = [*bare, *licenses.OTHERS, "the of", "Free and unencumbered software, the tale of two ships.", "Thhaen the ouat of ing."]
    docs = spark.createDataFrame([(0, "\n\n".join(texts))], "doc_id long, text string")
    for least in ({}, {"probability": 0.2, "overlap": 0.1}, {"probability": 0.1, "overlap": 0.0}):
        row = licenses.scan_licenses(docs, corpus=(), **least).first()
        same(row, brute("\n\n".join(texts), **least))
        assert row.n_paragraphs == len(texts) and any(n.paragraph < len(bare) for n in row.notices)
