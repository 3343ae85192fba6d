"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation.

A document's set holds its distinct five-word shingles (64-bit hashes); a document with one to four
words has one shingle, all its words; a document without words has an empty set and is linked with
nothing.  Two documents are linked when ``100 * intersection >= percent * union``.

1. Documents with equal sets form a class.  The class key is a 128-bit hash of the set; a partial
   aggregate finds each class and its smallest id, so a thousand copies cost one shuffled row a task.
2. A class has 128 registers: of the shingles in a bucket the smallest hash counts, stored as its
   leading-zero count and the ten bits after its first one bit (16 bits).
3. Bands of registers give keys (``banding``); classes that share a key meet.  A group up to ``SMALL`` classes
   yields its pairs, which pass a collision-corrected estimate before their full sets are compared.
4. A larger group is never expanded into pairs.  A pivot, the class whose registers agree best with the
   most usual ones, is compared with each member exactly.  Members linked to it are connected.  For the
   others the following is exact: if x is not linked to the pivot p and x is linked to a, then
   the differences of x and of a from p share an element.  (Were they disjoint, |x^a| = |x^p| + |a^p|,
   more than the allowed share of the union.)  So the group falls apart into smaller ones, one for each
   element of a difference, and of those a prefix is enough: x shares at least |x^p| - (1/s - 1) |x| of
   them.  A small enough group is settled in a task from the differences alone, which give exact
   intersections; larger ones get a pivot of their own.

Pairs that meet in no band are missed with probability (1 - s^width)^bands at similarity s.  The width is
chosen by the threshold: 25 bands of five miss 4e-7 at 0.85, 32 bands of four 5e-8 at 0.80.
Everything else is exact, and no group has a cap.

Nulls: a null text counts as empty; rows without an id are linked with nothing, as nothing could name
them: their component is null and they are kept.  Rows that repeat an id count once for each text, under
that id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.operators.components import component_labels
from tessera.plans.iterate import cut, forget, release

REGISTERS, BAND, MANTISSA = 128, 5, 10
#: Probability with which the bands may miss a pair at the threshold.
MISS = 5e-7
#: Classes in a group that is compared pair by pair.
SMALL = 32
#: Members of a group whose differences one task compares, and bytes of these differences.
BLOCK, BLOCK_BYTES = 1200, 64 << 20
#: Elements of a group's differences that are sorted at a time, and rows of sets that are compared at a time.
ELEMENTS, ROWS = 1 << 20, 256
#: Expected members that a pivot is chosen from.
SAMPLE = 48
#: Standard deviations by which an estimate may fall short before a pair is dropped.
SLACK = 6.0
_SHIFT = np.uint64(57)


def registers(values: np.ndarray) -> np.ndarray:
    """Registers of one sorted set: 0 for an empty bucket, else leading zeros + 1 above the mantissa."""
    out = np.zeros(REGISTERS, np.uint16)
    bucket = (values >> _SHIFT).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (values[at] << np.uint64(7)) | np.uint64(1 << 6)  # 57 bits of hash, then a stop bit
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros -= (rest >> (np.uint64(63) - np.minimum(zeros, 63).astype(np.uint64))) == 0  # log2 may round up to the next power
    after = (rest << zeros.astype(np.uint64)) << np.uint64(1)
    out[bucket[at]] = ((zeros.clip(0, 57) + 1) << MANTISSA) | (after >> np.uint64(64 - MANTISSA)).astype(np.int64)
    return out


def banding(percent: int, places: int = REGISTERS) -> tuple[int, int]:
    """The widest bands, ``BAND`` at most, that miss a pair at the threshold with probability ``MISS`` at most, and their number."""
    for width in range(BAND, 1, -1):
        if (1 - (percent / 100) ** width) ** (places // width) <= MISS:
            return width, places // width
    return 1, places


def band_keys(regs: np.ndarray, width: int, bands: int) -> np.ndarray:
    """Keys of the bands of a document's registers; 0 where all registers of a band are empty."""
    use = regs[: width * bands].reshape(bands, width).astype(np.uint64)
    key = K.mix((use * K.constants(width, 3)).sum(axis=1, dtype=np.uint64) + K.constants(bands, 4))
    return np.where(use.any(axis=1), key | np.uint64(1), np.uint64(0))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, less the matches expected by chance, and the registers in use."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    big, low = np.maximum(n, m).astype(float), np.minimum(n, m).astype(float)
    ratio = 4 * ((1 + big) / (1 + low)) / (1 + (1 + big) / (1 + low)) ** 2
    chance = 0.169919487159739 * 2.0 ** (7 - MANTISSA) * ratio
    return np.clip((same - chance) / np.maximum(used, 1), 0, 1), used


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, more = batch.column(0), batch.column(1), batch.columns[2:]
        for a, b in K.chunks(texts):
            values, first = K.sets(*K.windows(K.words(texts.slice(a, b - a), fold=True)))
            keys = K.set_keys(values, first)
            regs = [registers(values[first[i] : first[i + 1]]).tobytes() if first[i + 1] > first[i] else None for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(first)), pa.array(keys, pa.binary()), pa.array(regs, pa.binary()), *(c.slice(a, b - a) for c in more)], ["id", "n", "key", "regs", *batch.schema.names[2:]])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """``(id, n, key, regs)``: the set's size, its 128-bit key and the registers (null for an empty set); with
    ``digest``, a long of the row, that as well."""
    more = [] if digest is None else [digest.cast("long").alias("digest")]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *more).mapInArrow(K.tidied(_sketches), "id long, n long, key binary, regs binary" + ", digest long" * len(more))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in K.chunks(texts):
            values, first = K.sets(*K.windows(K.words(texts.slice(a, b - a), fold=True)))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([values[first[i] : first[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["id", "set"])


def _sets_of(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The full sets of the rows of ``texts (id, text)`` that ``needed (id)`` names."""
    return texts.join(needed.hint("merge"), "id", "left_semi").mapInArrow(K.tidied(_set_rows), "id long, set binary")


def _overlap(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.sliced(batches, ROWS):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b, strict=True):
                i = _overlap(x, y)
                keep.append(100 * i >= percent * ((len(x) + len(y)) // 8 - i))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            s, used = estimate(ra, rb, n, m)
            least = percent / 100
            near = s >= least - SLACK * np.sqrt(least * (1 - least) / np.maximum(used, 1))
            near &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _pivots(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a group's sampled members, the one that agrees best with the most usual registers."""
    regs = np.frombuffer(b"".join(rows.regs), np.uint16).reshape(-1, REGISTERS)
    usual = np.array([np.bincount(c).argmax() for c in regs.T], np.uint16)
    score = (regs == usual).sum(axis=1)
    best = rows.id.to_numpy()[score == score.max()].min()
    return pd.DataFrame({"gid": [rows.gid.iloc[0]], "pivot": [best]})


def _differences(percent: int):
    """Members against their pivots: links, differences, and the elements under which each member goes on."""
    q = 100 / percent - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.sliced(batches, ROWS):
            ids, pivots = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked, sizes, diffs, keys = [], [], [], []
            for p, sx, sp in zip(pivots, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(sx, np.uint64), np.frombuffer(sp, np.uint64)
                own, lost = np.setdiff1d(u, v, assume_unique=True), np.setdiff1d(v, u, assume_unique=True)
                i = len(u) - len(own)
                linked.append(100 * i >= percent * (len(v) + len(own)))
                diff = np.concatenate([own, lost])  # what the pivot lacks first: it is rarer in the group
                prefix = len(diff) if linked[-1] else len(diff) - max(1, int(np.ceil(len(diff) - q * len(u) - 1e-9))) + 1
                sizes.append(len(u))
                diffs.append(diff.tobytes())
                keys.append(K.mix(diff[:prefix] ^ K.constants(1, p & 0x7FFFFFFF)[0]).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pivots, pa.int64()), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(diffs, pa.binary()), keys], ["id", "pivot", "linked", "n", "diff", "keys"])

    return run


def _settled(percent: int, every: bool):
    """Links within a bounded group, exactly, from its members' differences to one pivot: the symmetric
    difference of two members is that of their differences.  With ``every`` all links come out, else a
    forest of at most size - 1.  Where rows have a ``block``, only links between the two blocks count."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        ids, n = rows.id.to_numpy(), rows.n.to_numpy()
        diffs = [np.frombuffer(d, np.uint64) for d in rows["diff"]]
        size = np.array([len(d) for d in diffs])
        shared = np.zeros((len(ids), len(ids)), np.float32)
        deals = np.uint64(max(1, -(-int(size.sum()) // ELEMENTS)))
        for deal in range(int(deals)):  # an element is in one deal, with all its members
            own = [d[d % deals == deal] for d in diffs] if deals > 1 else diffs
            who = np.repeat(np.arange(len(ids)), [len(d) for d in own])
            _, code, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            dense = np.cumsum(often > 1) - 1
            keep = often[code] > 1
            who, code = who[keep], dense[code[keep]]
            order = np.argsort(code, kind="stable")
            who, code = who[order], code[order]
            for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
                a, b = np.searchsorted(code, [at, at + 4096])
                block = np.zeros((len(ids), 4096), np.float32)
                block[who[a:b], code[a:b] - at] = 1
                shared += block @ block.T
        apart = size[:, None] + size[None, :] - 2 * shared.astype(np.int64)
        union = (n[:, None] + n[None, :] + apart) // 2
        near = 100 * (union - apart) >= percent * union
        if every:
            if "block" in rows and rows.block.nunique() > 1:
                near &= rows.block.to_numpy()[:, None] != rows.block.to_numpy()[None, :]
            x, y = np.nonzero(np.triu(near, 1))
            return pd.DataFrame({"a": ids[x], "b": ids[y]}, dtype="int64")
        left, links = np.ones(len(ids), bool), []
        while left.any():  # breadth first from the smallest member that is left
            front = [int(np.flatnonzero(left)[0])]
            left[front[0]] = False
            while front:
                x = front.pop()
                found = np.flatnonzero(near[x] & left)
                left[found] = False
                links += [(ids[y], ids[x]) for y in found]
                front += found.tolist()
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _band_rows(percent: int):
    width, bands = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, regs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            keys = np.array([band_keys(np.frombuffer(r, np.uint16), width, bands) for r in regs], np.uint64).reshape(len(regs), bands)
            some = keys != 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(np.repeat(ids, bands).reshape(-1, bands)[some])], ["gid", "id"])

    return run


def near_duplicate_links(texts: DataFrame, reps: DataFrame, percent: int = 85, groups: DataFrame | None = None, every: bool = False) -> DataFrame:
    """Links ``(a, b)`` between classes: enough of them that linked classes are connected, or with ``every``
    all between classes that meet.  Their order within a link is not fixed.

    ``reps (id, n, regs)`` has the sketch of each class's representative, ``texts (id, text)`` its text.
    ``groups (gid, id)`` says which classes meet, where that isn't for the bands of the sketch to say.
    """
    if groups is None:
        groups = reps.select("id", "regs").mapInArrow(K.tidied(_band_rows(percent)), "gid long, id long")
    sketch = reps.select("id", "n", "regs")
    groups = cut(groups.join(groups.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "gid"))
    near = groups.where(f"size <= {SMALL}")
    pairs = near.select("gid", F.col("id").alias("a")).join(near.select("gid", F.col("id").alias("b")), "gid").where("a < b").select("a", "b").distinct()
    # Joins whose sides grow with the documents are merged: a broadcast would pass through the driver.
    pairs = pairs.join(sketch.toDF("a", "n", "ra").hint("merge"), "a").join(sketch.toDF("b", "m", "rb").hint("merge"), "b")
    release(texts.sparkSession)
    pairs = cut(pairs.select("a", "b", "ra", "rb", "n", "m").mapInArrow(K.tidied(_likely(percent)), "a long, b long"))
    release(texts.sparkSession)
    large = groups.where(f"size > {SMALL}").select("gid", "id", "size")
    # Sets are computed anew for those that need an exact comparison, once, and not kept for all.
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select("id")).distinct()
    full = cut(_sets_of(texts, needed))
    release(texts.sparkSession)
    # Each round's links are kept on their own, so that its sets, differences and shuffles can go.
    links, old = [cut(_confirmed(full, pairs, percent))], [pairs]
    for _ in range(60):
        release(texts.sparkSession)
        pivots = cut(_pivots_of(large, reps))
        if pivots.isEmpty():
            break
        members = cut(large.join(pivots, "gid").select("id", "pivot").distinct())
        against = members.join(full, "id").join(full.toDF("pivot", "pivot_set"), "pivot").select("id", "pivot", "set", "pivot_set")
        against = cut(against.mapInArrow(K.tidied(_differences(percent)), "id long, pivot long, linked boolean, n long, diff binary, keys array<long>"))
        # Each kind of links is a plan of its own, in few partitions: the driver holds and plans again all of a plan's stages at a time.
        links.append(cut(against.where("linked and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()))
        # A group goes on if it has a member that isn't linked to its pivot, or all links count: in one task if that can hold
        # its differences, else by their elements.
        sizes = against.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("diff")).alias("bytes"), F.max(~F.col("linked")).alias("open")).where("size > 1" if every else "size > 1 and open")
        sizes = cut(sizes.select("pivot", F.expr(f"size <= {BLOCK} and bytes <= {BLOCK_BYTES}").alias("held")))
        whole = against.join(sizes.where("held").select("pivot"), "pivot")
        links.append(cut(whole.select(F.col("pivot").alias("gid"), "id", "n", "diff").groupBy("gid").applyInPandas(_settled(percent, every), "a long, b long").distinct()))
        release(texts.sparkSession)
        if every:  # the elements below don't bring two members together that are both linked to the pivot
            links.append(cut(_tiled(against.where("linked").join(sizes.where("not held").select("pivot"), "pivot"), percent).distinct()))
        rest = against.join(sizes.where("not held").select("pivot"), "pivot").select(F.explode("keys").alias("gid"), "id", "pivot", F.expr("not linked").alias("open"), F.expr("length(diff)").alias("bytes"))
        shared = rest.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("total"), F.max("open").alias("open")).where("size > 1 and open")
        rest = cut(rest.select("gid", "id", "pivot").join(shared.select("gid", "size", F.expr(f"size <= {BLOCK} and total <= {BLOCK_BYTES}").alias("held")), "gid"))
        release(texts.sparkSession)
        close = rest.where("held").join(against.select("id", "pivot", "n", "diff"), ["id", "pivot"])
        links.append(cut(close.select("gid", "id", "n", "diff").groupBy("gid").applyInPandas(_settled(percent, every), "a long, b long").distinct()))
        large = rest.where("not held").select("gid", "id", "size")
        for done in [*old, pivots, members, against, sizes]:
            forget(done)
        old = [rest]
    else:
        raise RuntimeError("groups did not fall apart")
    out = cut(reduce(DataFrame.unionByName, links).distinct())
    for done in [groups, full, pivots, *old, *links]:
        forget(done)
    release(texts.sparkSession)
    return out


def _tiled(linked: DataFrame, percent: int) -> DataFrame:
    """All links within groups ``(pivot, id, n, diff)`` that no task holds: dealt into blocks of half a
    task's share, of which each pair is compared in a task."""
    per = linked.groupBy("pivot").agg(F.expr(f"int(ceil(2 * greatest(count(*) / {BLOCK}, sum(length(diff)) / {BLOCK_BYTES})))").alias("blocks"))
    rows = linked.select("pivot", "id", "n", "diff").join(per, "pivot").withColumn("block", F.expr("int(pmod(xxhash64(id), blocks))"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("pivot", F.expr("least(block, other)").alias("i"), F.expr("greatest(block, other)").alias("j"), "id", "n", "diff", "block")
    return rows.groupBy("pivot", "i", "j").applyInPandas(_settled(percent, True), "a long, b long")


def _pivots_of(large: DataFrame, reps: DataFrame) -> DataFrame:
    """``(gid, pivot)`` for groups ``(gid, id, size)``."""
    # Members whose hash is low enough: the same ones in each group, so that groups of one family agree.
    chance = F.abs(F.xxhash64("id")) / F.lit(float(2**63))
    drawn = large.where(chance < F.lit(float(SAMPLE)) / F.col("size")).select("gid", "id")
    # One that is certainly there, for groups of which none is drawn.
    drawn = drawn.unionByName(large.groupBy("gid").agg(F.min("id").alias("id"))).distinct()
    best = drawn.join(reps.select("id", "regs"), "id").groupBy("gid").applyInPandas(_pivots, "gid long, pivot long")
    # Of the pivots that a group has as members it takes the one that most groups chose, twice over: any pivot will do, and few are cheaper.
    for _ in range(2):
        best = cut(best)
        liked = best.groupBy(F.col("pivot").alias("id")).agg(F.count(F.lit(1)).alias("votes"))
        chosen = large.join(liked, "id").groupBy("gid").agg(F.max(F.struct("votes", F.negative("id").alias("low"))).alias("x"))
        best = chosen.select("gid", F.negative("x.low").alias("pivot"))
    return best


def _confirmed(full: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(K.tidied(_linked(percent)), "a long, b long")


def classes_of(sketch: DataFrame) -> DataFrame:
    """``(key, id, n, regs)``: a row for each set that isn't empty, under the smallest id that has it."""
    return sketch.where("n > 0 and id is not null").groupBy("key").agg(F.min(F.struct("id", "n", "regs")).alias("r")).select("key", "r.*")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for each document, and its ``digest`` if one is given.

    ``component_id`` is the smallest id that links reach, the document's own included; ``kept`` says
    whether that is the document itself.
    """
    sketch = cut(sketches(docs, id_col, text_col, digest))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    classes = cut(classes_of(sketch))
    links = near_duplicate_links(docs, classes.select("id", "n", "regs"), percent)
    found = component_labels(links, "a", "b").withColumnRenamed("id", "rep")
    named = classes.select("key", F.col("id").alias("rep")).join(found, "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("id", F.col("n").alias("n_shingles"), F.expr("if(id is null, null, key)").alias("key"), *([] if digest is None else ["digest"])).join(named, "key", "left")
    component = F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), *([] if digest is None else ["digest"])).withColumn("kept", F.expr("id <=> component_id"))
