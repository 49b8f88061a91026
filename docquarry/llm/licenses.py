"""Licence notices in paragraphs: word n-gram logistic regression, an unknown class, and template comparison."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.shared import bind, spare, spread

#: Notice texts of licence families, lower case.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "spdx license identifier apache 2.0",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "spdx license identifier mit",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "released under the gnu general public license version 2",
        "spdx license identifier gpl 3.0 or later",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "licensed under the gnu lesser general public license version 2.1",
        "spdx license identifier lgpl 2.1 or later",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "licensed under the bsd 3 clause license",
        "use of this source code is governed by a bsd style license that can be found in the license file",
        "spdx license identifier bsd 3 clause",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "licensed under the mozilla public license version 2.0",
        "spdx license identifier mpl 2.0",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "licensed under the isc license",
        "spdx license identifier isc",
    ],
    "cc-by": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "text is available under the creative commons attribution license",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
        "text is available under the creative commons attribution sharealike license additional terms may apply",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
        "this article is distributed under a creative commons attribution noncommercial license",
    ],
    "public-domain": [
        "this is free and unencumbered software released into the public domain",
        "to the extent possible under law the author has waived all copyright and related rights to this work cc0 1.0 universal",
        "this work has been dedicated to the public domain",
    ],
    "proprietary": [
        "copyright all rights reserved",
        "all rights reserved no part of this publication may be reproduced stored or transmitted without the prior written permission of the publisher",
        "confidential and proprietary unauthorized copying of this file is strictly prohibited copyright all rights reserved",
    ],
}
#: Paragraphs with words of notices that are none; what an unknown paragraph looks like.
OTHERS = [
    "the driver must carry a valid license at all times and show it to the police",
    "she asked for permission to leave the room before the end of the meeting",
    "the company was granted a license to operate a radio station in the region",
    "a warrant was issued for the arrest of the two men on friday morning",
    "the court ruled that copyright law protects the expression of ideas",
    "how to choose a license for your next project and what to think about",
    "the council gave planning permission for a new school near the river",
    "the public domain of the old harbour was opened to visitors again",
    "he lost his fishing licence after the second season on the lake",
    "wealth was redistributed among the provinces by the new government",
    "there is no warranty on the used car that they bought last year",
    "the museum needs a licence for the music that it plays in the garden",
]
UNKNOWN = "unknown"
LABELS = (*TEMPLATES, UNKNOWN)
PROBABILITY, TEMPLATE_OVERLAP = 0.5, 0.6
#: Bounds of what the unknown class learns from the corpus: documents (the lowest by hash), paragraphs of them, words of one.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_WORDS = 400, 1000, 200


def tokens(text: str) -> list[str]:
    return "".join(c if c.isascii() and (c.isalnum() or c == ".") else " " for c in text.lower()).replace(". ", " ").removesuffix(".").split()


def grams(words: list[str], longest: int = 3) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)))


@dataclass(frozen=True)
class Model:
    """Feature -> weight by label (features of all labels are the same), biases, the temperature."""

    features: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def variants(rng: np.random.Generator) -> tuple[list[list[str]], list[int]]:
    """Training paragraphs: templates whole, cut short, with words lost and with prose around, and paragraphs of no family."""
    filler = " ".join(OTHERS).split()
    texts, y = [], []
    for k, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            words = tokens(template)
            for turn in range(12):
                w = list(words)
                if turn % 3 == 1 and len(w) > 8:
                    at = int(rng.integers(0, len(w) - 7))
                    w = w[at : at + int(rng.integers(8, len(w) + 1))]
                elif turn % 3 == 2:
                    w = [x for x in w if rng.random() > 0.1]
                    w = list(rng.choice(filler, int(rng.integers(0, 6)))) + w + list(rng.choice(filler, int(rng.integers(0, 12))))
                texts.append(w)
                y.append(k)
    for _ in range(16):
        for other in OTHERS:
            w = tokens(other)
            at = int(rng.integers(0, max(1, len(w) - 4)))
            texts.append(w[at:] + list(rng.choice(filler, int(rng.integers(0, 20)))))
            y.append(len(TEMPLATES))
    return texts, y


@lru_cache(maxsize=8)
def model(corpus: tuple[str, ...] = ()) -> Model:
    """Softmax regression with L2 on binary n-grams (1 to 3 words) over the square root of their number, by gradient descent.

    Paragraphs of the corpus without a word sequence of a template are unknown: half of them (every other one) are learnt from. A
    temperature fitted on variants drawn anew and on the other half calibrates the probabilities, those of the unknown class included.
    """
    unknown = [w for w in map(tokens, corpus) if w and not set(grams3(w)) & known_shingles()]
    texts, y = variants(np.random.default_rng(3))
    texts, y = texts + unknown[::2], y + [len(TEMPLATES)] * len(unknown[::2])
    found: dict[str, int] = {}
    for w in texts:
        for g in grams(w):
            found[g] = found.get(g, 0) + 1
    features = tuple(sorted(g for g, n in found.items() if n >= 6))
    place = {g: i for i, g in enumerate(features)}

    def matrix(rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(features)))
        for r, w in enumerate(rows):
            gs = grams(w)
            x[r, [place[g] for g in gs if g in place]] = 1 / np.sqrt(max(1, len(gs)))
        return x

    x, t = matrix(texts), np.eye(len(LABELS))[y]
    w, b = np.zeros((len(features), len(LABELS))), np.zeros(len(LABELS))
    b[-1] = 1.0
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(300):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        mw = 0.9 * mw + x.T @ (p - t) / len(x) + 2e-5 * w
        mb = 0.9 * mb + (p - t).mean(0)
        w, b = w - 10 * mw, b - 2 * mb
    held, yh = variants(np.random.default_rng(4))
    held, yh = held + unknown[1::2], yh + [len(TEMPLATES)] * len(unknown[1::2])
    z = matrix(held) @ w + b

    def loss(temperature: float) -> float:
        s = z / temperature
        return float(np.mean(np.logaddexp.reduce(s, axis=1) - s[np.arange(len(yh)), yh]))

    return Model(features, np.round(w, 4), np.round(b, 4), round(float(min(np.geomspace(0.25, 4, 33), key=loss)), 4))


def text_array(values) -> str:
    return "array(" + ", ".join("'" + v + "'" for v in values) + ")"


def words_sql(paragraph: str) -> str:
    """SQL: the words of a paragraph, as tokens() has them."""
    return f"filter(split(regexp_replace(regexp_replace(regexp_replace(lower({paragraph}), '[^a-z0-9.]', ' '), '[.] ', ' '), '[.]$', ''), ' +'), t -> t <> '')"


@cache
def known_shingles() -> frozenset[str]:
    return frozenset(g for ts in TEMPLATES.values() for t in ts for g in grams3(tokens(t)))


def shares_sql(words: str) -> str:
    """SQL: whether words have a three-word shingle of any template. Without one the overlap is 0 whatever the family."""
    known = sorted(known_shingles())
    firsts = sorted({g.split()[0] for g in known})
    listed = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    return f"size(filter({words}, (t, i) -> t in {listed(firsts)} and concat_ws(' ', t, get({words}, i + 1), get({words}, i + 2)) in {listed(known)})) > 0"


def scored_sql(weights: str, m: Model) -> str:
    """SQL: struct(z, three) of a paragraph's words w: the logit of each label, and the three-word shingles. weights: see model_column()."""
    n_gram = lambda n: f"transform(slice(sequence(0, size(w)), 1, greatest(size(w) - {n - 1}, 0)), i -> array_join(slice(w, i + 1, {n}), ' '))"
    bias = f"array({', '.join(f'{v:.4f}D' for v in m.bias)})"
    hits = f"array_intersect(g, map_keys({weights}))"
    logits = f"transform(aggregate({hits}, {bias.replace('D', 'D * 0')}, (acc, f) -> zip_with(acc, element_at({weights}, f), (a, b) -> a + b)), (s, k) -> (s / sqrt(double(greatest(1, size(g)))) + element_at({bias}, k + 1)) / {m.temperature:.4f}D)"
    return bind("g", f"array_distinct(concat(w, {n_gram(2)}, {n_gram(3)}))", f"named_struct('z', {logits}, 'three', array_distinct({n_gram(3)}))")


def verdict_sql() -> tuple[str, str]:
    """SQL of what scored_sql() gives (x), in two steps: struct(best, probability, n, common), then struct(family, probability, overlap,
    shared). family is the most probable label; overlap and shared are the greatest over the family's templates: the share, and the
    number, of three-word shingles in common."""
    shingles = {f: [grams3(tokens(t)) for t in ts] for f, ts in TEMPLATES.items()}
    common = ", ".join(f"size(array_intersect(x.three, {text_array(t)}))" for ts in shingles.values() for t in ts)
    first = f"named_struct('best', int(array_position(x.z, array_max(x.z))), 'probability', 1 / aggregate(x.z, 0D, (acc, v) -> acc + exp(v - array_max(x.z))), 'n', size(x.three), 'common', array({common}))"
    place, overlaps, shared = 0, [], []
    for ts in shingles.values():
        at = range(place, place := place + len(ts))
        overlaps.append("array_max(array(" + ", ".join(f"x.common[{i}] / double(greatest(1, least(x.n, {len(t)})))" for i, t in zip(at, ts, strict=True)) + "))")
        shared.append("array_max(array(" + ", ".join(f"x.common[{i}]" for i in at) + "))")
    second = f"named_struct('family', element_at({text_array(LABELS)}, x.best), 'probability', x.probability, 'overlap', element_at(array({', '.join(overlaps)}, 0D), x.best), 'shared', element_at(array({', '.join(shared)}, 0), x.best))"
    return first, second


def grams3(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + 3]) for i in range(len(words) - 2)))


def corpus_sample(docs: DataFrame) -> tuple[str, ...]:
    """Lines of a few documents, for the unknown class: the documents and the lines lowest by hash, so that reruns agree."""
    some = docs.select("text").where("text is not null").select("text", F.xxhash64("text").alias("h")).orderBy("h").limit(SAMPLE_DOCS)
    lines = some.select(F.explode(F.split("text", "\n", -1)).alias("line")).distinct().select(F.array_join(F.slice(F.split(F.trim("line"), " +"), 1, SAMPLE_WORDS), " ").alias("line")).where("line <> ''")
    return tuple(r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_PARAGRAPHS).collect())


def model_column(spark: SparkSession, m: Model) -> Column:
    """The model's weights as one value: n-gram -> weight by label. Of fixed size, whatever the input."""
    row = [(list(m.features), m.weights.tolist())]
    return spark.createDataFrame(row, "f array<string>, w array<array<double>>").select(F.map_from_arrays("f", "w").alias("m")).scalar()


def scan_licenses(docs: DataFrame, probability: float = PROBABILITY, overlap: float = TEMPLATE_OVERLAP, corpus: tuple[str, ...] | None = None) -> DataFrame:
    """docs with n_paragraphs, n_unknown, notices (array of family, probability, overlap, paragraph number), family and probability.

    A paragraph is a run of lines without a blank line between them. Those that share a three-word shingle with a template are
    classified; the others have an overlap of 0, so that no label makes them a notice, and are unknown. Within a paragraph what is
    judged is the passage from its first to its last line with such a shingle, and each of these lines alone: a notice that is wrapped
    over lines is found as the passage, which then shares more with its template than any line does; else the lines that are notices
    count one by one. A notice is a passage or line whose most probable label is a family, with at least `probability`, and of whose
    three-word shingles (or of a template's, if those are fewer) at least the share `overlap` is shared with a template of that family.
    n_unknown: paragraphs without a notice. family and probability are those of the most probable notice (ties: the first), null
    without one. The unknown class learns from corpus (texts), by default corpus_sample(docs). Null and empty texts have no paragraphs.
    Extra columns stay, but for those of these names. Row by row, without a shuffle; long paragraphs cost time in proportion to their words.
    """
    m = model(corpus_sample(docs) if corpus is None else corpus)
    parts, weights, able, first = spare(docs, "parts", "weights", "able", "first")
    own = ("n_paragraphs", "n_unknown", "notices", "family", "probability")
    blank = r"\n[ \t\r\x0b\f]*(?=\n)"
    paragraphs = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), blank, "\n"), "\n\n+", -1), lambda p: F.trim(F.translate(p, "\n\t\r\x0b\x0c", "     ")) != "")
    # An overlap of 0 is a notice's only where none is asked for; all paragraphs are classified then.
    shares = (lambda w: shares_sql(w)) if overlap > 0 else (lambda w: "true")
    gated = f"filter(transform({parts}, (p, i) -> named_struct('i', i, 'p', p, 'all', {words_sql('p')})), s -> {shares('s.all')})"
    out = (spread(docs) if "doc_id" in docs.columns else docs).withColumn(parts, paragraphs).withColumns({"n_paragraphs": F.size(parts).cast("long"), weights: model_column(docs.sparkSession, m), able: F.expr(gated)})
    # Of a paragraph's lines those with a shingle, and the words from the first to the last of them; without one, all of its words.
    # In steps, as columns: analysing one expression with all of these lambdas in one another takes far too long.
    lined = f"transform({able}, s -> named_struct('i', s.i, 'all', s.all, 'ls', transform(split(s.p, '\\n', -1), l -> {words_sql('l')})))"
    flagged = f"transform({able}, s -> named_struct('i', s.i, 'all', s.all, 'ls', s.ls, 'at', filter(sequence(0, size(s.ls) - 1), k -> {shares('get(s.ls, k)')} and size(get(s.ls, k)) > 0)))"
    passage = "if(size(s.at) = 0, s.all, flatten(slice(s.ls, s.at[0] + 1, s.at[size(s.at) - 1] - s.at[0] + 1)))"
    candidates = f"transform({able}, s -> named_struct('i', s.i, 'c', concat(array({passage}), if(size(s.at) < 2, cast(array() as array<array<string>>), transform(s.at, k -> get(s.ls, k))))))"
    each = lambda name, body: f"transform({able}, s -> named_struct('i', s.i, 'v', transform(s.{name}, {'w' if name == 'c' else 'x'} -> {body})))"
    told, judged = verdict_sql()
    passes = lambda v: f"({v}.family <> '{UNKNOWN}' and {v}.probability >= {probability} and {v}.overlap >= {overlap})"
    singles = f"filter(slice(s.v, 2, size(s.v)), x -> {passes('x')})"
    chosen = f"if({passes('s.v[0]')} and s.v[0].shared > coalesce(array_max(transform({singles}, x -> x.shared)), 0), array(s.v[0]), {singles})"
    named = f"flatten(transform({able}, s -> transform({chosen}, x -> named_struct('family', x.family, 'probability', x.probability, 'overlap', x.overlap, 'paragraph', s.i))))"
    kind = "array<struct<family:string,probability:double,overlap:double,paragraph:int>>"
    # Most documents have nothing to judge.
    steps = (lined, flagged, candidates, each("c", scored_sql(weights, m)), each("v", told), each("v", judged))
    inner = ("all:array<string>,ls:array<array<string>>", "all:array<string>,ls:array<array<string>>,at:array<int>", "c:array<array<string>>", "v:array<struct<z:array<double>,three:array<string>>>", "v:array<struct<best:int,probability:double,n:int,common:array<int>>>", "v:array<struct<family:string,probability:double,overlap:double,shared:int>>")
    empty = [f"array<struct<i:int,{x}>>" for x in inner]
    for step, none in zip(steps, empty, strict=True):
        out = out.withColumn(able, F.expr(f"if(size({able}) = 0, cast(array() as {none}), {step})"))
    out = out.withColumn("notices", F.expr(f"if(size({able}) = 0, cast(array() as {kind}), {named})"))
    best = F.expr("aggregate(notices, cast(null as struct<family:string,probability:double,overlap:double,paragraph:int>), (a, s) -> if(a is null or s.probability > a.probability, s, a))")
    noticed = F.size(F.array_distinct(F.transform("notices", lambda n: n["paragraph"])))
    out = out.withColumn("n_unknown", F.col("n_paragraphs") - noticed).withColumn(first, best)
    out = out.withColumn("family", F.col(first).getField("family")).withColumn("probability", F.col(first).getField("probability"))
    return out.select(*[f"`{c}`" for c in docs.columns if c not in own], *own)
