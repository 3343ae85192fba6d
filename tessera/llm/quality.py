"""Document quality: exact text statistics and a learned decision list over them.

Words are runs of anything but 0x20 and 0x09-0x0D.  The statistics come from one pass of vectorised
kernels over Arrow batches.  The decision list is learned by sequential covering: a rule grows by the
threshold that gains most on two thirds of the sample, is pruned on the other third, and takes the rows
it covers out of both.  The result is an ordered list of threshold conjunctions and becomes one
``CASE WHEN`` expression, so that scoring the corpus stays inside the JVM.

Null and empty texts have all statistics 0.  Rows repeat as often as they occur.  An empty table gives
an empty result; without labels of both classes the list is empty and keeps everything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K

#: Labelled rows that a list is learned from, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha", "n_digits", "n_distinct_words"]
_SYMBOL, _UPPER, _ALPHA, _DIGIT, _TAIL = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[0xC3:0xF5] = True
_DIGIT[48:58] = True
_TAIL[0x80:0xC0] = True
_BLANK = " \t\n\x0b\x0c\r"


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(w: K.Words, k: int = 5) -> np.ndarray:
    """For each text its words that lie in a ``k``-word window found twice or more in the text."""
    code, first = K.windows(w, k, short=False)
    if not len(code):
        return np.zeros(w.texts, np.int64)
    text = np.repeat(np.arange(w.texts), np.diff(first))
    code = K.mix(code + text.astype(np.uint64) * K.constants(1, 21)[0])
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hits = np.flatnonzero(twice)
    at = hits + (w.first[:-1] - first[:-1])[text[hits]]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return inside[w.first[1:]] - inside[w.first[:-1]]


def distinct_words(w: K.Words) -> np.ndarray:
    out = np.zeros(w.texts, np.int64)
    values, first = K.sets(w.hash, w.first)
    out[:] = np.diff(first)
    return out


def statistics_of(texts: pa.Array) -> dict[str, np.ndarray]:
    w = K.words(texts)
    kept = ~_TAIL[w.data]
    chars = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    lengths = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start])])
    lines, doubled = np.zeros(w.texts, np.int64), np.zeros(w.texts, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text:
            some = [x for x in text.split("\n") if x.strip(_BLANK)]
            lines[i], doubled[i] = len(some), len(some) - len(set(some))
    return {
        "n_words": w.counts,
        "word_chars": lengths[w.first[1:]] - lengths[w.first[:-1]],
        "n_symbols": _per_text(_SYMBOL[w.data], w.offsets),
        "n_dup_lines": doubled,
        "n_repeat_words": repeated_words(w),
        "n_lines": lines,
        "n_upper": _per_text(_UPPER[w.data], w.offsets),
        "n_alpha": _per_text(_ALPHA[w.data], w.offsets),
        "n_digits": _per_text(_DIGIT[w.data], w.offsets),
        "n_distinct_words": distinct_words(w),
    }


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in K.chunks(batch.column(1)):
            got = statistics_of(batch.column(1).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], ["id", *COUNTS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the columns of ``COUNTS``, a row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(K.tidied(_rows), "id long, " + ", ".join(f"{c} long" for c in COUNTS))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` after its own, under the prefix ``_q_``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.chunks(batch.column(at)):
                part = batch.slice(a, b - a)
                got = statistics_of(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], [*part.schema.names, *(f"_q_{c}" for c in COUNTS)])

    return docs.mapInArrow(K.tidied(run), T.StructType([*docs.schema.fields, *(T.StructField(f"_q_{c}", T.LongType()) for c in COUNTS)]))


def keep_good(docs: DataFrame, rules: list["Rule"], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither fail the base rules nor meet a rule of the list, whatever their columns are called."""
    names = docs.columns
    rows = with_statistics(docs.toDF(*(f"c{k}" for k in range(len(names)))), f"c{names.index(text_col)}")
    kept = rows.where(~failed_base("_q_") & verdict(rules, "_q_"))
    return kept.select(*(f"c{k}" for k in range(len(names)))).toDF(*names)


def failed_base(at: str = "") -> Column:
    return F.expr(_at("n_words < 10 or 100 * n_repeat_words > 20 * n_words", at))


def _at(sql: str, prefix: str) -> str:
    return re.sub(r"\b(" + "|".join(COUNTS) + r")\b", rf"{prefix}\1", sql)


def _ratio(a: str, b: str) -> str:
    return f"({a} / cast(greatest({b}, 1) as double))"


#: What rules are made of: SQL over ``COUNTS``.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": _ratio("word_chars", "n_words"),
    "symbols_a_word": _ratio("n_symbols", "n_words"),
    "repeated_lines": _ratio("n_dup_lines", "n_lines"),
    "repeated_words": _ratio("n_repeat_words", "n_words"),
    "upper_share": _ratio("n_upper", "n_alpha"),
    "digit_share": _ratio("n_digits", "word_chars"),
    "distinct_share": _ratio("n_distinct_words", "n_words"),
    "words_a_line": _ratio("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, above, threshold)``; a row that meets it is rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.conditions:
            out &= (x[name] > t) if above else (x[name] <= t)
        return out

    def column(self, at: str = "") -> Column:
        return F.expr(_at(" and ".join(f"{FEATURES[n]} {'>' if above else '<='} {t!r}D" for n, above, t in self.conditions), at))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 3) -> Rule:
    """Adds the condition of the largest information gain until no good row is covered."""
    conditions: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while len(conditions) < most and (bad & inside).any() and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in x.items():
            v = values[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], bad[inside][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            low, total = np.cumsum(b)[cut], b.sum()
            for above in (False, True):
                pos = (total - low) if above else low
                all_ = (len(v) - cut - 1) if above else cut + 1
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / all_) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if not best[1]:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return Rule(tuple(conditions))


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    c = rule.covers(x)
    return ((bad & c).sum() - 4 * (~bad & c).sum()) / max(1, c.sum())


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.98, support: int = 5, most: int = 12) -> list[Rule]:
    """Ordered rules that reject bad rows.  A rule joins the list if at least ``precision`` of the sample's
    rows that it covers are bad, and at least ``support`` of them."""
    held = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most and (bad & left).sum() >= support:
        grow, prune = left & ~held, left & held
        if not (bad & grow).any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule.conditions:
            break
        xp = {k: v[prune] for k, v in x.items()}
        while len(rule.conditions) > 1 and _worth(short := Rule(rule.conditions[:-1]), xp, bad[prune]) >= _worth(rule, xp, bad[prune]):
            rule = short
        c = rule.covers(x) & left
        if (bad & c).sum() < support or (bad & c).sum() < precision * c.sum():
            break
        rules.append(rule)
        left &= ~c
    return rules


def fit_decision_list(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from at most ``sample_rows`` labelled documents; ``labels (doc_id, quality)``, 0 is bad."""
    picked = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null and quality in (0, 1)")
    picked = picked.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample_rows)
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.select("id").distinct()), "id", "left_semi")
    rows = text_statistics(some, "id", "text").join(picked, "id").select("id", "quality", *(F.expr(v).alias(k) for k, v in FEATURES.items())).toPandas().sort_values("id")
    if rows.quality.nunique() < 2:
        return []
    return learn_list({k: rows[k].to_numpy() for k in FEATURES}, (rows.quality == 0).to_numpy())


def verdict(rules: list[Rule], at: str = "") -> Column:
    """False for rows that a rule rejects, in the list's order; ``at`` stands before the counts' names."""
    out: Column | None = None
    for rule in rules:
        out = F.when(rule.column(at), F.lit(False)) if out is None else out.when(rule.column(at), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for each document."""
    rules = fit_decision_list(docs, labels, id_col, text_col)
    stats = text_statistics(docs, id_col, text_col).withColumn("base_failed", failed_base())
    return stats.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
