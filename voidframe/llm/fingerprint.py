"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is a multiset of pieces: its paragraphs, long ones taken sentence by sentence, each with the mark that ends it. Every piece
hashes to a wide vector; a text's fingerprint is the sum of its pieces' vectors, each lane modulo a power of two. So the order
of pieces does not matter, and a piece is put in or taken out by adding or subtracting its vector (`insert`, `delete`).

Lanes: 4 of 32 bits, for equality, and 126 of one hash bit each, packed two to a 63-bit word (32 and 31 bits wide, modulo 2^32 and 2^31,
so lanes never run into each other below 2^31 pieces). The second sort also carries likeness: with the piece count n, 2 * lane - n is a
sum of random signs, and the cosine of two such vectors estimates the pieces they share. `insert` and `delete` work lane by lane and undo
each other in any order, below zero too.

Null text counts as empty; an empty text is one empty piece. Repeated rows and equal texts have equal fingerprints. Ties on doc_id are
ordered by text; null ids come first. Very long texts are hashed whole, piece by piece. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import text_of

STRONG = 4
WORDS = 63
_MASK32, _MASK31 = (1 << 32) - 1, (1 << 31) - 1
#: A cut after every mark that ends a sentence, a table cell or a paragraph.
CUTS = r"(?<=[.!?|])(?!\n)|(?<=\n)"


def pieces(text: Column) -> Column:
    return F.split(text, CUTS, -1)


def lane_sums(piece: str) -> list[Column]:
    """The aggregates that add up the vectors of a group's pieces: count, strong lanes, packed words."""
    strong = [F.sum(F.xxhash64(F.lit(k), F.col(piece)).bitwiseAND(F.lit(_MASK32))).alias(f"s{k}") for k in range(STRONG)]
    packed = []
    for w in range(WORDS):
        # bits w and w + 32 of one of two hashes land in the two lanes
        h, at = F.col("_h0" if w < 32 else "_h1"), w % 32
        packed.append(F.sum(F.shiftrightunsigned(h, at).bitwiseAND(F.lit(1 | 1 << 32))).alias(f"w{w}"))
    return [F.count(F.lit(1)).alias("n"), *strong, *packed]


def fingerprint_column() -> Column:
    """Hex of the lanes, each modulo its power of two."""
    strong = [F.lpad(F.hex(F.col(f"s{k}").bitwiseAND(F.lit(_MASK32))), 8, "0") for k in range(STRONG)]
    packed = [F.lpad(F.hex(F.col(f"w{w}")), 16, "0") for w in range(WORDS)]
    return F.lower(F.concat(F.lpad(F.hex(F.col("n").bitwiseAND(F.lit(_MASK32))), 8, "0"), *strong, *packed))


def signs_column() -> Column:
    """2 * lane - n for each one-bit lane."""
    words = F.array(*[F.col(f"w{w}") for w in range(WORDS)])

    low = F.transform(words, lambda x: (x.bitwiseAND(F.lit(_MASK32)) * 2 - F.col("n")).cast("double"))
    return F.concat(low, F.transform(words, lambda x: (F.shiftrightunsigned(x, 32) * 2 - F.col("n")).cast("double")))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two sign vectors, cut to 0..1: the estimated share of pieces in common."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = add(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(add(F.transform(a, lambda x: x * x))) * F.sqrt(add(F.transform(b, lambda x: x * x)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(norm > 0, dot / norm).otherwise(F.lit(0.0)))), 9)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n, s0.., w0.. for each row of texts; rows that share all keys are summed as one multiset."""
    cut = texts.select(*keys, F.explode(pieces(text_of(text))).alias("_piece"))
    hashed = cut.select(*keys, "_piece", F.xxhash64(F.lit(101), F.col("_piece")).alias("_h0"), F.xxhash64(F.lit(202), F.col("_piece")).alias("_h1"))
    return hashed.groupBy(*keys).agg(*lane_sums("_piece"))


def _merge(a: DataFrame, b: DataFrame, keys: list[str], sign: int) -> DataFrame:
    a, b = a.alias("a"), b.alias("b")
    both = a.join(b, keys, "full")
    side = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), F.lit(0).cast("long"))
    whole = [(side("a", c) + sign * side("b", c)).bitwiseAND(F.lit(_MASK32)).alias(c) for c in ("n", *(f"s{k}" for k in range(STRONG)))]

    def word(c: str) -> Column:
        low = (side("a", c).bitwiseAND(F.lit(_MASK32)) + sign * side("b", c).bitwiseAND(F.lit(_MASK32))).bitwiseAND(F.lit(_MASK32))
        high = (F.shiftrightunsigned(side("a", c), 32) + sign * F.shiftrightunsigned(side("b", c), 32)).bitwiseAND(F.lit(_MASK31))
        return F.shiftleft(high, 32).bitwiseOR(low).alias(c)

    return both.select(*keys, *whole, *[word(f"w{w}") for w in range(WORDS)])


def insert(prints: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The fingerprints after the pieces behind `more` joined those of the same key; a key that prints lacks starts from nothing."""
    return _merge(prints, more, keys, 1)


def delete(prints: DataFrame, less: DataFrame, keys: list[str]) -> DataFrame:
    """The fingerprints after the pieces behind `less` left those of the same key, even if they were not there (modulo the lanes, a later `insert` makes up for it)."""
    return _merge(prints, less, keys, -1)


def range_bucket(docs: DataFrame, key: str, buckets: int) -> Column:
    """An ordered bucket of the key, cut at approximate quantiles; at most `buckets` bounds reach the driver."""
    inner = max(1, round(buckets**0.5))
    at = docs.where(F.col(key).isNotNull()).approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    bounds = sorted({int(x) for x in at})
    groups = [bounds[i : i + inner] for i in range(0, len(bounds), inner)]
    if not groups:
        return F.lit(0)
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= k))
    firsts = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    g = below(firsts)
    return F.when(g == 0, F.lit(0)).otherwise((g - 1) * inner + below(F.element_at(table, F.greatest(g, F.lit(1))))).cast("int")


def edited(docs: DataFrame, bucket_rows: int = 4096, max_buckets: int = 4096) -> DataFrame:
    """One row per document: _bucket, _at, doc_id, text, n_chars, following (the text of the next document by ascending doc_id; after
    the last, the first) and edited (its last half replaced from following). The text moves once, to ordered buckets of doc_id; the
    first document of a bucket also goes to the end of the bucket before. Ties on doc_id are ordered by text."""
    rows = docs.select(F.col("doc_id"), text_of().alias("text"))
    n = rows.count()
    buckets = max(1, min(max_buckets, -(-n // bucket_rows)))
    rows = rows.withColumn("_bucket", range_bucket(rows, "doc_id", buckets))
    by_bucket = Window.orderBy("_bucket")  # one row per bucket, at most max_buckets
    first = rows.groupBy("_bucket").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).alias("_first"))
    first = first.select("_bucket", "_first", F.coalesce(F.lag("_bucket").over(by_bucket), F.max("_bucket").over(Window.partitionBy())).alias("_before"))
    heads = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("_first")
    places = F.when(heads, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("tail")), F.struct(F.col("_before").alias("b"), F.lit(1).alias("tail")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("tail"))))
    placed = rows.join(F.broadcast(first), "_bucket").select("doc_id", "text", F.explode(places).alias("_p")).select(F.col("_p.b").alias("_bucket"), F.col("_p.tail").alias("_tail"), "doc_id", "text")
    order = Window.partitionBy("_bucket").orderBy("_tail", F.col("doc_id").asc_nulls_first(), "text")
    led = placed.select("_bucket", "_tail", F.row_number().over(order).alias("_at"), "doc_id", "text", F.lead("text").over(order).alias("following")).where("_tail = 0")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return (
        led.select("_bucket", "_at", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), "following")
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("following", F.lit(1), half)))
    )


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns. Bucketed as `edited` leaves it, so the sums need no further shuffle."""
    keys = ["_bucket", "_at", "doc_id", "n_chars", "edited_sha256"]
    rows = edited(docs).withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    sides = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate(("text", "edited", "following"))])).alias("_s")).select(*keys, "_s.side", "_s.text")
    prints = fingerprints(sides, [*keys, "side"]).select(*keys, "side", F.struct(fingerprint_column().alias("fp"), signs_column().alias("v")).alias("p"))
    wide = prints.groupBy(*keys).agg(*[F.first(F.when(F.col("side") == i, F.col("p")), ignorenulls=True).alias(f"p{i}") for i in range(3)])
    near = lambda i: F.when(F.col("p0.fp") == F.col(f"p{i}.fp"), F.lit(1.0)).otherwise(likeness(F.col("p0.v"), F.col(f"p{i}.v")))
    return wide.select("doc_id", "n_chars", "edited_sha256", F.col("p0.fp").alias("fingerprint"), F.col("p1.fp").alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"))
