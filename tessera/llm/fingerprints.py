"""MinHash fingerprints of documents and a banded similarity join over them.

A fingerprint holds, for each of ``PERMUTATIONS`` universal hash functions, the low 16 bits of the
smallest value over the text's five-word shingles (A-Z lower-cased; a shorter text is one shingle).  The
share of equal positions estimates the Jaccard similarity.  Equal texts have equal fingerprints; a text
without words has a fingerprint of its own, alike only to itself.

Signatures are cut into bands; texts that share one are compared on their full sets.  ``similar_pairs`` joins
a whole corpus that way.  ``fingerprints_against_next`` does so for each text and two given ones, which meet in
a task anyway.

Nulls count as empty texts.  A row with a null id has no place in the order by id: its next document is the
first of all, or itself where no row has an id.  Rows with equal ids are ordered by their text.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.plans.iterate import cut

PERMUTATIONS = 64
#: Documents in a block of the order by id, and the most blocks; beyond their product the blocks grow.  A block's
#: texts pass through a task one after the other, so its size costs no memory.
BLOCK_ROWS, MOST_BLOCKS = 250, 10_000
_A = K.constants(PERMUTATIONS, 31)
_B = K.constants(PERMUTATIONS, 32)


def signatures(texts: pa.Array) -> np.ndarray:
    """A row of ``PERMUTATIONS`` 16-bit values for each text."""
    out = np.zeros((len(texts), PERMUTATIONS), np.uint16)
    for a, b in K.chunks(texts):
        code, first = K.windows(K.words(texts.slice(a, b - a), fold=True))
        some = np.flatnonzero(np.diff(first))
        if not len(some):
            continue
        at, work = first[:-1][some], np.empty_like(code)
        for k in range(PERMUTATIONS):
            np.multiply(code, _A[k], out=work)
            np.add(work, _B[k], out=work)
            low = np.minimum.reduceat(work, at)
            out[a + some, k] = (K.mix(low) & np.uint64(0xFFFF)).astype(np.uint16) | 1
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal positions, row by row."""
    return (a == b).mean(axis=1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = signatures(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sig], pa.binary())], ["id", "signature"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, signature)``."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_rows, "id long, signature binary")


def similar_pairs(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``members (id, class_id, links)`` joins documents of equal shingle sets and counts
    the links of their class; ``pairs (a, b, jaccard)`` holds all links between classes that share a band and
    whose sets reach ``percent``, ``a < b``.

    Copies are one class before the bands are joined.  The bands are as wide as ``near_dup.banding`` allows for
    the threshold, which bounds the share of pairs that meet in none.  A text without words is in no class.
    """
    from tessera.llm import near_dup

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = cut(near_dup.sketches(rows, "id"))
    classes = cut(near_dup.classes_of(sketch))
    marks = fingerprints(rows.join(classes.select("id"), "id", "left_semi"), "id")
    width, n = near_dup.banding(percent, PERMUTATIONS)
    bands = marks.select("id", F.posexplode(F.array(*(F.expr(f"substring(signature, {2 * i * width + 1}, {2 * width})") for i in range(n)))).alias("band", "key"))
    links = near_dup.near_duplicate_links(rows, classes.select("id", "n", "regs"), percent, bands.select(F.xxhash64("band", "key").alias("gid"), "id").distinct(), every=True)
    ends = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    often = ends.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    named = classes.select("key", F.col("id").alias("class_id")).join(often, "class_id", "left").select("key", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    members = sketch.where("id is not null").join(named, "key").select("id", "class_id", "links")
    full = near_dup._sets_of(rows, ends.select(F.col("a").alias("id")).unionByName(ends.select(F.col("b").alias("id"))).distinct())
    both = ends.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return members, both.mapInArrow(_jaccard, "a long, b long, jaccard double")


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(both / max(1, len(u) + len(v) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "jaccard"])


_NEXT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
#: Similarity for which the bands are made.
PERCENT = 80


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def meet(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether rows of signatures share a band; a text without words has none."""
    from tessera.llm.near_dup import banding

    width, bands = banding(percent, PERMUTATIONS)
    same = ((a == b) & (a != 0))[:, : width * bands].reshape(len(a), bands, width)
    return same.all(axis=2).any(axis=1)


def _verified(texts: list[str], others: list[str], met: np.ndarray) -> pa.Array:
    """The Jaccard similarity of the full sets of texts that meet in a band, null for the others."""
    out: list[float | None] = [None] * len(texts)
    at = np.flatnonzero(met)
    sides = []
    for side in (texts, others):
        some = pa.array([side[i] for i in at], pa.string())
        sides.append([])
        for a, b in K.chunks(some):
            values, first = K.sets(*K.windows(K.words(some.slice(a, b - a), fold=True)))
            sides[-1] += [values[first[i] : first[i + 1]] for i in range(b - a)]
    for i, u, v in zip(at, *sides, strict=True):
        both = len(np.intersect1d(u, v, assume_unique=True))
        out[i] = both / (len(u) + len(v) - both)
    return pa.array(out, pa.float64())


def _emit(rows: list[tuple], sig: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """``rows``: (id, text, next text); ``sig``: signatures of the texts and, in the same order, the next texts."""
    texts, after = [r[1] for r in rows], [r[2] for r in rows]
    edited = [_edited(t, n) for t, n in zip(texts, after, strict=True)]
    changed = signatures(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]), pa.array([s.tobytes().hex() for s in sig[0]]), pa.array([s.tobytes().hex() for s in changed]), pa.array(alike(sig[0], changed)), pa.array(alike(*sig)), _verified(texts, edited, meet(sig[0], changed)), _verified(texts, after, meet(*sig))],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited", "jaccard_next"],
    )


def _against_one(first: str | None):
    """Rows (id, text) against one next text, or themselves if it is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                mine = signatures(part.column(1))
                texts = [t or "" for t in part.column(1).to_pylist()]
                after = texts if first is None else [first] * len(texts)
                yield _emit(list(zip(part.column(0).to_pylist(), texts, after, strict=True)), (mine, mine if first is None else np.repeat(signatures(pa.array([first])), len(texts), axis=0)))

    return run


def _against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, tail, id, text) in order; a block's first tail row is the text after its last row."""
    carry: tuple | None = None  # (block, id, text, signature) that waits for its next text
    for batch in batches:
        for a, b in K.chunks(batch.column(3)):
            part = batch.slice(a, b - a)
            sig = signatures(part.column(3))
            block, tail, ids, texts = (part.column(i).to_pylist() for i in range(4))
            rows, mine, after = [], [], []
            for i in range(len(ids)):
                text = texts[i] or ""
                if carry and carry[0] == block[i]:
                    rows.append((carry[1], carry[2], text))
                    mine.append(carry[3])
                    after.append(sig[i])
                carry = None if tail[i] else (block[i], ids[i], text, sig[i])
            if rows:
                yield _emit(rows, (np.array(mine), np.array(after)))


def fingerprints_against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form: the last half of its code points replaced by as
    many of the next document's, by descending id, the first again after the last.

    The ids are cut into blocks at quantiles.  A block's first document also goes to the end of the block
    before, so every document meets its next one in a sorted stream and the texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = rows.where("id is not null").agg(F.count(F.lit(1))).first()[0]
    blocks = min(MOST_BLOCKS, n // BLOCK_ROWS + 1)
    bounds = np.array([], np.int64)
    if blocks > 1:
        cuts = rows.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], max(10_000, 4 * blocks))).first()[0]
        bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def block(x: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, x.to_numpy(), "left")).astype(np.int32))

    tops = rows.select("id").where("id is not null").withColumn("block", block("id")).groupBy("block").agg(F.max("id").alias("id")).collect()
    tops = sorted((t.block, t.id) for t in tops)
    first = rows.where(F.col("id") == tops[0][1]).agg(F.min(F.coalesce("text", F.lit("")))).first()[0] if tops else None
    alone = rows.where("id is null").mapInArrow(_against_one(first), _NEXT)
    if not tops:
        return alone
    heads = [(i, tops[k - 1][0]) for k, (_, i) in enumerate(tops)]
    heads = docs.sparkSession.createDataFrame(heads, "head long, dest int")  # at most MOST_BLOCKS rows
    sent = rows.where("id is not null").withColumn("block", block("id")).join(F.broadcast(heads), F.col("id") == F.col("head"), "left")
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("tail"))
    sent = sent.withColumn("to", F.explode(F.when(F.col("dest").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("dest").alias("block"), F.lit(1).alias("tail"))))))
    sent = sent.select("to.block", "to.tail", "id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(parts, "block").sortWithinPartitions("block", "tail", F.col("id").desc(), "text")
    return sent.mapInArrow(_against_next, _NEXT).unionByName(alone)
