"""Licence scans: a trained paragraph classifier and template comparison.

A paragraph runs to a sentence's end or a blank line; wrapped lines are joined.  "Licence" and "license" are
one word.  Its features are the word unigrams and bigrams of a small vocabulary.  A softmax regression over
licence families and ``unknown`` is trained here, on sentences made from the templates (cut, thinned and set
among other words) against sentences that use the same words for other things.  A temperature and a
threshold set on held-out sentences calibrate it: a paragraph less sure than the threshold is unknown.  A
family also has to be confirmed by one of its templates, most of whose word pairs must stand in the paragraph.

The model is a few hundred numbers.  It is trained in the driver and becomes literals of one Spark SQL
expression, so that a scan is a projection: no join, no shuffle, no Python.  Every paragraph is classified.
One without a word of the vocabulary scores the bias alone, for which ``unknown`` is likeliest (``train`` makes
sure of that); these are passed over by one regular expression that is made from the vocabulary.

Null and empty texts have no paragraphs.  Rows repeat as they occur; an empty table gives an empty result.
Other columns stay, but one named like the result gives way to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices by which licences are declared, by family.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the apache license", "released under apache license 2.0", "available under apache 2.0 terms", "apache license", "spdx license identifier apache 2.0"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "available under mit terms", "mit license", "spdx license identifier mit"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license", "released under the bsd license", "available under bsd terms", "bsd license", "spdx license identifier bsd 3 clause"],
    "gpl": ["licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license", "released under the gnu gpl version 2", "available under gpl terms", "gnu gpl", "gpl license", "spdx license identifier gpl 3.0 only"],
    "lgpl": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license lgpl", "available under lgpl terms", "lgpl license", "spdx license identifier lgpl 2.1 only"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "available under mpl 2.0 terms", "mozilla public license", "spdx license identifier mpl 2.0"],
    "cc-by": ["licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0", "creative commons attribution license cc by", "creative commons attribution license", "cc by 4.0"],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike 4.0 license", "licensed under cc by sa 4.0", "available under the creative commons attribution sharealike license", "creative commons attribution sharealike", "cc by sa 4.0"],
    "cc-by-nc": ["licensed under a creative commons attribution noncommercial 4.0 license", "licensed under cc by nc 4.0", "free for noncommercial use under creative commons cc by nc", "creative commons attribution noncommercial", "cc by nc 4.0"],
    "cc0": ["dedicated to the public domain under cc0 1.0 universal", "this work is in the public domain cc0", "no rights reserved cc0", "public domain under cc0", "cc0 public domain"],
    "proprietary": ["all rights reserved no part may be reproduced without permission", "copyright all rights reserved", "proprietary and confidential unauthorized copying is prohibited"],
}
# The same words in other uses.
OTHERS = [
    "he lost his driving license on the way home", "the license plate of the car was new", "the shop has a license to sell wine", "you need permission from the teacher", "the general public was invited to the opening",
    "the mit campus is near the river", "an apache helicopter flew over the village", "a gnu is an african antelope", "the apache people lived in the south", "version 2.0 of the software is out now",
    "the public domain of the town", "a common creative idea", "the source of the river is in the north", "free of charge for all visitors", "terms and conditions of the sale",
    "copyright law is taught in the second year", "a binary star has two parts", "the warranty ends after two years", "use of the hall is permitted on sundays", "attribution of the painting is in doubt",
    "the mozilla office is in berlin", "part 3 clause 2 of the contract", "work on the bridge goes on", "software engineers met in the city", "the agreement was signed under oath",
]
STOP = frozenset("the a an of and to in is it or on for with by this be any you your may not can are no at from his he has all at was".split())
#: Sentences a template makes, share of a template's word pairs that confirms it, and the calibration's false alarms.
SENTENCES, CONFIRMED, FALSE_ALARMS = 60, 0.6, 0.01


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower().replace("licenc", "licens"))


def pairs(ws: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def grams(text: str) -> set[str]:
    ws = words(text)
    return set(ws) | set(pairs(ws))


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # vocabulary x (families + unknown)
    bias: np.ndarray
    threshold: float

    def words(self) -> list[str]:
        """Words of which one stands in each entry of the vocabulary."""
        return sorted({w for g in self.vocabulary for w in g.split() if w not in STOP})


def _sentences(seed: int) -> list[tuple[str, int]]:
    """Training sentences with the number of their family; the last number is unknown."""
    rng = np.random.default_rng(seed)
    filler = sorted({w for o in OTHERS for w in words(o)})
    out = []
    for k, templates in enumerate(TEMPLATES.values()):
        for t in templates:
            ws = words(t)
            for _ in range(SENTENCES):
                kept = [w for w in ws if rng.random() > 0.1]
                before, after = (list(rng.choice(filler, rng.integers(0, 7))) for _ in range(2))
                out.append((" ".join(before + kept + after), k))
    telling = sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t)} - STOP)
    for o in OTHERS:
        for _ in range(SENTENCES):
            ws = [w for w in words(o) if rng.random() > 0.1]
            extra = list(rng.choice(telling, rng.integers(0, 2))) + list(rng.choice(filler, rng.integers(0, 7)))
            rng.shuffle(extra)
            out.append((" ".join(ws + extra), len(TEMPLATES)))
    return out


@lru_cache(maxsize=2)
def train(seed: int = 7, rounds: int = 300, ridge: float = 1e-3) -> Model:
    """Fits the regression on two thirds of the sentences and calibrates it on the other third."""
    data = _sentences(seed)
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t) if not all(w in STOP for w in g.split())})
    column = {g: k for k, g in enumerate(vocabulary)}
    x, y = np.zeros((len(data), len(vocabulary))), np.array([k for _, k in data])
    for i, (text, _) in enumerate(data):
        x[i, [column[g] for g in grams(text) if g in column]] = 1
    held = np.arange(len(data)) % 3 == 2
    target = np.eye(len(TEMPLATES) + 1)[y]
    w, b = np.zeros((len(vocabulary), target.shape[1])), np.zeros(target.shape[1])
    xt, tt = x[~held], target[~held]
    for _ in range(rounds):
        z = xt @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 2.0 * (xt.T @ (p - tt) / len(xt) + ridge * w)
        b -= 2.0 * (p - tt).mean(axis=0)
    zh, yh = x[held] @ w + b, y[held]

    def probabilities(t: float) -> np.ndarray:
        e = np.exp(zh / t - (zh / t).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    heat = min(np.linspace(0.3, 3, 28), key=lambda t: -np.log(probabilities(t)[np.arange(len(yh)), yh] + 1e-12).mean())
    sure = np.sort(probabilities(heat)[yh == len(TEMPLATES), :-1].max(axis=1))
    threshold = max(0.5, float(sure[int(np.ceil(len(sure) * (1 - FALSE_ALARMS))) - 1]))
    if b.argmax() != len(TEMPLATES):
        raise ValueError("a paragraph without words of the vocabulary would not be unknown")
    return Model(tuple(TEMPLATES), tuple(vocabulary), np.round(w / heat, 6), np.round(b / heat, 6), round(threshold, 6))


def any_of(words: list[str]) -> str:
    """A regular expression for a word that begins with one of ``words``, as a prefix tree."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def branch(at: dict) -> str:
        if "" in at:
            return ""  # longer words begin with this one
        ways = [re.escape(c) + branch(more) for c, more in sorted(at.items())]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return "(?:^|[^a-z0-9])" + branch(tree)


def _texts(items) -> str:
    return "array(" + ", ".join("'" + s.replace("'", "\\'") + "'" for s in items) + ")"


def _numbers(items) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in map(float, items)) + ")"


#: Marks paragraph ends: behind sentence ends and at blank lines.
_ENDS = (("([.!?;])[ \t\r\n]+", "$1\u0001"), ("\n[ \t\r]*\n", "\u0001"))


def scan_licences(docs: DataFrame, text_col: str = "text", model: Model | None = None, out_col: str = "licences") -> DataFrame:
    """``docs`` without its text, with ``licences (array of paragraph, family, probability, confirmed)``.

    ``paragraph`` counts from 0.  The list has the paragraphs for which a family is likeliest; it is ``unknown``
    below the calibrated threshold.
    """
    m = model or train()
    n = len(m.families) + 1
    gate = f"rlike({{0}}, '{any_of(m.words())}')"
    table = "map(" + ", ".join(f"'{g}', {_numbers(m.weights[k])}" for k, g in enumerate(m.vocabulary)) + ")"
    proofs = "map(" + ", ".join(f"'{f}', array({', '.join(_texts(sorted(set(pairs(words(t))))) for t in TEMPLATES[f])})" for f in m.families) + ")"
    sums = f"aggregate(array_intersect(p.grams, {_texts(m.vocabulary)}), {_numbers(m.bias)}, (s, g) -> zip_with(s, element_at({table}, g), (u, v) -> u + v))"
    scores = f"transform({sums}, z -> exp(least(z, 300D)))"
    tokens = "regexp_extract_all(p.line, '[a-z0-9]+(?:[.][0-9]+)*', 0)"
    named = _texts([*m.families, "unknown"])
    others = [c for c in docs.columns if c != text_col and c.lower() != out_col.lower()]
    low = F.replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit("licenc"), F.lit("licens"))
    for pattern, mark in _ENDS:
        low = F.regexp_replace(low, pattern, mark)
    staged = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)), low.alias("low"))
    staged = staged.withColumn("p", F.when(F.expr(gate.format("low")), F.expr(f"filter(transform(split(low, '\u0001', -1), (line, i) -> struct(i as i, line as line)), x -> {gate.format('x.line')})")).otherwise(F.expr("cast(array() as array<struct<i:int,line:string>>)")))
    staged = staged.drop("low").withColumn("p", F.expr(f"transform(p, p -> named_struct('i', p.i, 'ws', {tokens}))"))
    staged = staged.withColumn("p", F.expr("transform(p, p -> named_struct('i', p.i, 'grams', array_union(p.ws, zip_with(slice(p.ws, 1, greatest(size(p.ws) - 1, 0)), slice(p.ws, 2, greatest(size(p.ws) - 1, 0)), (a, b) -> concat(a, ' ', b)))))"))
    staged = staged.withColumn("p", F.expr(f"transform(p, p -> named_struct('i', p.i, 'grams', p.grams, 'e', {scores}))"))
    staged = staged.withColumn("p", F.expr(f"transform(p, p -> named_struct('i', p.i, 'grams', p.grams, 'best', array_max(transform(p.e, (e, k) -> named_struct('e', e, 'k', {n} - k))), 'all', aggregate(p.e, 0D, (a, e) -> a + e)))"))
    staged = staged.withColumn("p", F.expr("filter(p, p -> p.best.k > 1)"))
    staged = staged.withColumn("p", F.expr(f"transform(p, p -> named_struct('i', p.i, 'grams', p.grams, 'probability', p.best.e / p.all, 'family', if(p.best.e / p.all >= {m.threshold!r}D, element_at({named}, {n} + 1 - p.best.k), 'unknown')))"))
    proof = f"exists(element_at({proofs}, p.family), t -> size(array_intersect(p.grams, t)) >= {CONFIRMED}D * size(t))"
    found = F.expr(f"transform(p, p -> named_struct('paragraph', p.i, 'family', p.family, 'probability', p.probability, 'confirmed', if(p.family = 'unknown', false, {proof})))")
    return staged.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(others)), found.alias(out_col))


def scan_sql(model: Model | None = None) -> str:
    """DuckDB twin over ``documents`` of the digest that the query takes from a scan."""
    m = model or train()
    n = len(m.families) + 1
    weights = ", ".join(f"('{g}', {k}, {float(v)!r}::DOUBLE)" for g, row in zip(m.vocabulary, m.weights, strict=True) for k, v in enumerate(row))
    bias = ", ".join(f"({k}, {float(v)!r}::DOUBLE)" for k, v in enumerate(m.bias))
    proofs = ", ".join(f"({k}, {t}, '{g}')" for k, f in enumerate(m.families) for t, text in enumerate(TEMPLATES[f]) for g in sorted(set(pairs(words(text)))))
    names = ", ".join(f"({k}, '{f}')" for k, f in enumerate([*m.families, "unknown"]))
    low = "replace(lower(coalesce(text, '')), 'licenc', 'licens')"
    for pattern, mark in _ENDS:
        low = f"regexp_replace({low}, '{pattern}', '{mark.replace('$', chr(92))}', 'g')"
    return f"""
WITH w(g, k, v) AS (VALUES {weights}), b(k, v) AS (VALUES {bias}), f(k, t, g) AS (VALUES {proofs}), names(k, family) AS (VALUES {names}),
x AS (SELECT doc_id, string_split({low}, '\u0001') AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM x),
c AS (SELECT doc_id, i, regexp_extract_all(line, '[a-z0-9]+(?:[.][0-9]+)*') AS ws FROM l),
g AS (SELECT DISTINCT doc_id, i, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda j: ws[j] || ' ' || ws[j + 1]))) AS g FROM c),
v AS (SELECT doc_id, i, k, sum(v) AS v FROM g JOIN w USING (g) GROUP BY ALL),
s AS (SELECT doc_id, i, k, b.v + v.v AS z FROM v JOIN b USING (k)),
p AS (SELECT doc_id, i, arg_max(k, z) AS k, max(exp(z)) / sum(exp(z)) AS probability FROM s GROUP BY doc_id, i),
q AS (SELECT doc_id, i, CASE WHEN probability >= {m.threshold!r} THEN k ELSE {n - 1} END AS k FROM p WHERE k < {n - 1}),
t AS (SELECT k, t, count(*) AS n FROM f GROUP BY k, t),
o AS (SELECT q.doc_id, q.i, f.k, f.t, count(*) AS n FROM q JOIN f USING (k) JOIN g ON g.doc_id = q.doc_id AND g.i = q.i AND g.g = f.g GROUP BY ALL),
y AS (SELECT DISTINCT o.doc_id, o.i FROM o JOIN t USING (k, t) WHERE o.n >= {CONFIRMED} * t.n),
r AS (SELECT q.doc_id, q.i, names.family, y.i IS NOT NULL AS confirmed FROM q JOIN names USING (k) LEFT JOIN y ON y.doc_id = q.doc_id AND y.i = q.i)
SELECT d.doc_id, coalesce(string_agg(DISTINCT r.family, ',' ORDER BY r.family) FILTER (r.confirmed), '') AS families,
  count(*) FILTER (r.confirmed) AS n_confirmed, count(r.i) AS n_candidates
FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""
