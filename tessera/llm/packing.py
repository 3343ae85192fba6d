"""Packing by optimal length buckets.

Texts longer than ``longest`` tokens are cut into pieces.  The global histogram of piece lengths has at
most ``longest`` rows; dynamic programming over it finds the bucket limits that make the total padding
smallest.  Each piece is padded to its bucket's limit, and a bucket's batches hold as many rows as fit
the token budget.  Where the tokens themselves are given, each piece comes out as a row of its batch: its
tokens padded to the limit, with a mask and positions.

Lengths are counted once.  Places in a bucket come from counts of (bucket, chunk), summed over ranges of
chunks, and a row number within each, so no task sees a whole bucket.  Null and empty texts have no tokens and
form no piece in a bucket: they come out with bucket 0 and no batch.  Equal rows are interchangeable.  An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from tessera.plans.iterate import cut

#: Tokens of the longest piece, of a batch, and the number of buckets.
LONGEST, BUDGET, BUCKETS = 8192, 65_536, 8
#: Pieces of a chunk, about; and hex digits of the hash that chunks go by.
CHUNK_ROWS, HEX = 2000, 6
#: Chunks in a range of chunks.
RANGE = 4096


def word_count(text: Column) -> Column:
    """Words of a text: the token count where no tokenizer's is given."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_limits(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Bucket limits for ascending ``lengths`` and the padding that they cost; of equal choices the one with
    the smallest limits from the top down."""
    n = len(lengths)
    buckets = min(buckets, n)
    if not n:
        return [], 0
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    cuts = []
    for _ in range(buckets):
        now, cut = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        for i in range(1, n + 1):
            cost = best[:i] + lengths[i - 1] * (rows[i] - rows[:i]) - (tokens[i] - tokens[:i])
            cut[i] = cost.argmin()
            now[i] = cost[cut[i]]
        best = now
        cuts.append(cut)
    at, limits = n, []
    for cut in reversed(cuts):
        limits.append(int(lengths[at - 1]))
        at = int(cut[at])
    return limits[::-1], int(best[n])


def words_of(text: Column) -> Column:
    """The words of a text, as tokens."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.array().cast("array<string>"))


def hashed_words(text: Column, size: int = 1 << 20) -> Column:
    """The words of a text as numbers from 1 to ``size``, by hash: tokens that need no vocabulary; 0 is free for padding."""
    return F.transform(words_of(text), lambda w: (F.pmod(F.xxhash64(w), F.lit(size)) + 1).cast("int"))


def pack(docs: DataFrame, tokens: Column, id_col: str = "doc_id", longest: int = LONGEST, budget: int = BUDGET, buckets: int = BUCKETS, pad: object = None) -> DataFrame:
    """``(id, piece, start, n_tokens, bucket, bucket_length, batch, slot)``, a row for each piece.

    ``bucket`` counts from 1; ``batch`` and ``slot`` from 0 within the bucket.  ``tokens`` is an array, or only their
    number.  With an array the rows have ``tokens``, padded with ``pad`` to the bucket's length, ``mask`` (true for
    the piece's own tokens) and ``positions`` (from 0 in the piece, 0 for padding) as well.
    """
    given = docs.select(tokens.alias("t")).schema["t"].dataType
    whole = isinstance(given, ArrayType)
    tokens = F.coalesce(tokens, (F.array() if whole else F.lit(0)).cast(given))
    total = F.size(tokens) if whole else tokens
    sized = cut(_pieces(docs.select(F.col(id_col).cast("long").alias("id"), total.cast("long").alias("total")), longest).drop("total"))
    histogram = sorted(map(tuple, sized.groupBy("n_tokens").count().collect()))  # at most longest + 1 rows
    some = [(k, c) for k, c in histogram if k > 0]
    limits, _ = best_limits(np.array([k for k, _ in some], np.int64), np.array([c for _, c in some], np.int64), buckets)
    chunks = max(1, -(-sum(c for _, c in histogram) // CHUNK_ROWS))
    before = _before(_placed(sized, limits, chunks).groupBy("bucket", "chunk").agg(F.count(F.lit(1)).alias("n")))
    pieces = sized
    if whole:
        pieces = _pieces(docs.select(F.col(id_col).cast("long").alias("id"), tokens.alias("tokens")).withColumn("total", F.size("tokens").cast("long")), longest)
        pieces = pieces.withColumn("tokens", F.slice("tokens", (F.col("start") + 1).cast("int"), longest)).drop("total")
    pieces = _placed(pieces, limits, chunks)
    within = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("id", "piece"))
    ranked = pieces.withColumn("within", within).join(before, ["bucket", "chunk"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    fit = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1))
    held = F.col("bucket") > 0
    out = [*("id piece start n_tokens bucket bucket_length".split()), F.when(held, F.floor(F.col("rank") / fit)).alias("batch"), F.when(held, F.col("rank") % fit).alias("slot")]
    if whole:
        places = F.when(held, F.sequence(F.lit(0), F.col("bucket_length") - 1)).otherwise(F.array().cast("array<int>"))
        out += [F.concat("tokens", F.array_repeat(F.lit(pad).cast(given.elementType), F.col("bucket_length") - F.size("tokens"))).alias("tokens"), F.transform(places, lambda k: k < F.col("n_tokens")).alias("mask"), F.transform(places, lambda k: F.when(k < F.col("n_tokens"), k).otherwise(F.lit(0))).alias("positions")]
    return ranked.select(*out)


def _pieces(rows: DataFrame, longest: int) -> DataFrame:
    """``rows (total, ...)`` by piece, with ``piece``, ``start`` and ``n_tokens``."""
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / longest), F.lit(1)) - 1))
    rows = rows.withColumn("piece", piece).withColumn("start", F.col("piece") * longest)
    return rows.withColumn("n_tokens", F.least(F.col("total") - F.col("start"), F.lit(longest)))


def _placed(pieces: DataFrame, limits: list[int], chunks: int) -> DataFrame:
    """``pieces`` with their bucket, its length and their chunk."""
    bucket, length = F.lit(0), F.lit(0)
    for k, limit in reversed(list(enumerate(limits))):
        bucket = F.when(F.col("n_tokens") <= limit, F.lit(k + 1)).otherwise(bucket)
        length = F.when(F.col("n_tokens") <= limit, F.lit(limit)).otherwise(length)
    none = F.col("n_tokens") <= 0
    chunk = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("piece").cast("string"))), 1, HEX), 16, 10).cast("long") % chunks
    return pieces.withColumn("bucket", F.when(none, F.lit(0)).otherwise(bucket)).withColumn("bucket_length", F.when(none, F.lit(0)).otherwise(length)).withColumn("chunk", chunk)


def _before(counts: DataFrame) -> DataFrame:
    """Rows of a bucket before each of its chunks, from ``counts (bucket, chunk, n)``: running sums within ranges of
    ``RANGE`` chunks, and over the ranges."""
    counts = counts.withColumn("range", F.floor(F.col("chunk") / RANGE))
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("bucket", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("bucket", "range", F.coalesce(F.sum("n").over(ahead("bucket", "range")), F.lit(0)).alias("base"))
    inner = counts.withColumn("inner", F.coalesce(F.sum("n").over(ahead("bucket", "range", "chunk")), F.lit(0)))
    return inner.join(ranges, ["bucket", "range"]).select("bucket", "chunk", (F.col("base") + F.col("inner")).alias("before"))


def pack_sql(longest: int = LONGEST, budget: int = BUDGET, buckets: int = BUCKETS) -> str:
    """DuckDB twin of ``pack`` over ``documents`` with word counts, for tables with at least ``buckets`` lengths."""
    steps = "".join(
        f""",
c{k} AS (SELECT b.i, min({{'c': {f'a.m.c' if k > 1 else '0::BIGINT'} + b.len * (b.rows - a0.rows) - (b.toks - a0.toks), 'j': a0.i}}) AS m
  FROM h b JOIN h0 a0 ON a0.i < b.i {f'JOIN c{k - 1} a ON a.i = a0.i' if k > 1 else ''} WHERE {'true' if k > 1 else 'a0.i = 0'} GROUP BY b.i)"""
        for k in range(1, buckets + 1)
    )
    ends = f",\ne{buckets} AS (SELECT max(i) AS i FROM h)" + "".join(f",\ne{k} AS (SELECT c.m.j AS i FROM c{k + 1} c JOIN e{k + 1} USING (i))" for k in range(buckets - 1, 0, -1))
    limits = " UNION ALL ".join(f"SELECT {k} AS bucket, h.len AS bucket_length FROM e{k} JOIN h USING (i)" for k in range(1, buckets + 1))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(ceil(len(ws) / {longest})::BIGINT, 1))) AS piece, len(ws)::BIGINT AS total, ws FROM d),
q AS (SELECT doc_id, piece, piece * {longest} AS start, least(total - piece * {longest}, {longest}) AS n_tokens, sha256(array_to_string(ws[piece * {longest} + 1:(piece + 1) * {longest}], ' ')) AS tokens_sha256 FROM p),
g AS (SELECT n_tokens AS len, count(*) AS n FROM q WHERE n_tokens > 0 GROUP BY 1),
h AS (SELECT row_number() OVER (ORDER BY len) AS i, len, sum(n) OVER (ORDER BY len)::BIGINT AS rows, sum(n * len) OVER (ORDER BY len)::BIGINT AS toks FROM g),
h0 AS (SELECT i, rows, toks FROM h UNION ALL SELECT 0, 0, 0){steps}{ends},
l AS ({limits}),
b AS (SELECT q.*, coalesce((SELECT min(l.bucket) FROM l WHERE q.n_tokens > 0 AND q.n_tokens <= l.bucket_length), 0) AS bucket,
  ('0x' || substr(md5(doc_id::VARCHAR || ':' || piece::VARCHAR), 1, {HEX}))::BIGINT % (SELECT greatest(1, ceil(count(*) / {CHUNK_ROWS})::BIGINT) FROM q) AS chunk FROM q),
r AS (SELECT b.*, coalesce(l.bucket_length, 0) AS bucket_length, row_number() OVER (PARTITION BY b.bucket ORDER BY chunk, doc_id, piece) - 1 AS rank FROM b LEFT JOIN l USING (bucket))
SELECT doc_id, piece, start, n_tokens, bucket::INT AS bucket, bucket_length::BIGINT AS bucket_length,
  CASE WHEN bucket > 0 THEN rank // greatest({budget} // greatest(bucket_length, 1), 1) END::BIGINT AS batch,
  CASE WHEN bucket > 0 THEN rank % greatest({budget} // greatest(bucket_length, 1), 1) END::BIGINT AS slot,
  (bucket_length - n_tokens)::BIGINT AS padding, tokens_sha256 FROM r
"""
