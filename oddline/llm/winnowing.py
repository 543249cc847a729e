"""Document fingerprints by winnowing, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddline.llm.common import columns, ranked

GRAM = 3  # words of a k-gram
WINDOW_BITS = 2  # a window has 2**2 k-grams
PLACE_BITS = 31  # an array has no more places
LAST_PLACE = (1 << PLACE_BITS) - 1
BUCKET = 256  # document ids whose neighbours are looked up together


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def packed_minima(text: Column) -> Column:
    """The selected k-grams of a text as longs.

    Packed are 33 bits of the hash, then the place counted downwards.  The smaller
    of two longs is the smaller hash and, of equal hashes, the one further right.
    A window is the minima of two windows of half its width, so the whole text costs
    a few passes.  All texts have windows of one width; one with fewer k-grams is one window.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def pack(value: Column, place: Column) -> Column:
        high = F.shiftleft(F.shiftright(value, PLACE_BITS), PLACE_BITS)
        return high.bitwiseOR(F.lit(LAST_PLACE) - place.bitwiseAND(LAST_PLACE))

    def grams(w: Column) -> Column:
        def gram(i: Column) -> Column:
            return pack(F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)]), i.cast("bigint"))

        return (
            F.when(F.size(w) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), gram))
            .when(F.size(w) > 0, F.array(pack(F.xxhash64(w), F.lit(0).cast("bigint"))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    def double(step: int):
        return lambda m: F.when(
            F.size(m) > step,
            F.zip_with(F.slice(m, 1, F.size(m) - step), F.slice(m, step + 1, F.size(m) - step), lambda a, b: F.least(a, b)),
        ).when(F.size(m) > 0, F.array(F.array_min(m))).otherwise(m)

    selected = _let(words, grams)
    for bit in range(WINDOW_BITS):
        selected = _let(selected, double(1 << bit))
    return F.array_distinct(selected)


def hashes_of(minima: Column) -> Column:
    return F.array_distinct(F.transform(minima, lambda v: F.shiftright(v, PLACE_BITS)))


def places_of(minima: Column) -> Column:
    """Word numbers of the selected k-grams (in order of the text)."""
    return F.transform(minima, lambda v: F.lit(LAST_PLACE) - v.bitwiseAND(LAST_PLACE))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes; two empty fingerprints are alike, an empty and another are not."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both == 0, 1.0).otherwise(common / both).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` with ``hash`` and ``place`` of every selected k-gram.

    Words are runs of letters and digits, lower-cased.  Of every 4 consecutive
    k-grams of three words the smallest hash is kept, the rightmost of equal ones, so
    texts with 6 common words in a row share at least one.  Fewer k-grams than a window are one window; fewer than three words are
    one k-gram; no words (also a null text) give an empty list.
    """
    minima = columns(docs, "doc_id", "text").select("doc_id", packed_minima(F.col("text")).alias("m"))
    hashes = F.transform("m", lambda v: F.shiftright(v, PLACE_BITS))
    pairs = F.arrays_zip(hashes.alias("hash"), places_of(F.col("m")).alias("place"))
    return minima.select("doc_id", pairs.alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``next_text`` and ``next_hashes`` of the next document by descending id; the last is followed by the first.

    Rows are dealt by ranges of ids and each range finds its neighbours itself;
    what follows its last document, the first document of the next range that has
    any, is sent to it.  Rows with one id go by text hash, rows without id come last.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lit(-(1 << 62)).cast("bigint")
    placed = columns(docs, "doc_id", "text").select(
        "doc_id", text.alias("text"),
        F.coalesce(F.floor(F.col("doc_id") / BUCKET), low).alias("_bucket"), F.xxhash64(text).alias("_tie"),
    )
    heads = placed.groupBy("_bucket").agg(
        F.max_by("text", F.struct("doc_id", F.bitwise_not("_tie"))).alias("_head")
    )
    order = ranked(placed.select("_bucket").distinct(), [F.desc("_bucket")], "_rank")
    n = max(order.count(), 1)
    receivers = order.select(F.col("_bucket").alias("_to"), "_rank").join(
        order.select("_bucket", F.pmod(F.col("_rank") - 1, F.lit(n)).alias("_rank")), "_rank"
    )
    sent = heads.join(receivers, "_bucket").select(
        F.col("_to").alias("_bucket"), "_head", hashes_of(packed_minima(F.col("_head"))).alias("_head_hashes")
    )
    window = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last("doc_id"), "_tie")
    own = placed.withColumn("_own", packed_minima(F.col("text")))
    led = own.withColumn("_next", F.lead("text").over(window)).withColumn(
        "_next_hashes", F.lead(hashes_of(F.col("_own"))).over(window)
    )
    return led.join(sent, "_bucket").select(
        "doc_id", "text", F.col("_own").alias("found"),
        F.coalesce("_next", "_head").alias("next_text"),
        F.coalesce("_next_hashes", "_head_hashes").alias("next_hashes"),
    )


def _written(minima: Column) -> Column:
    return F.concat_ws("", F.transform(minima, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited forms, and how alike they are.

    Takes ``doc_id`` and ``text`` (null: empty).  In the edited text the last third
    of the code points is replaced by as many from the start of the next document.
    ``near_edited`` is the likeness of the two fingerprints returned, ``near_next`` that
    of ``fingerprint`` and the next document's: the hashes of both, without the places.
    """
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = with_next(docs).withColumn(
        "edited", F.concat(F.left("text", n - third), F.left("next_text", third))
    )
    both = edited.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "found",
        packed_minima(F.col("edited")).alias("edited_found"), "next_hashes",
    )
    hashed = both.withColumn("_a", hashes_of(F.col("found"))).withColumn("_b", hashes_of(F.col("edited_found")))
    return hashed.select(
        "doc_id", "n_chars", "edited_sha256", _written(F.col("found")).alias("fingerprint"),
        _written(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"),
        likeness(F.col("_a"), F.col("next_hashes")).alias("near_next"),
    )


def op9_winnowing(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
