"""Lines that repeat across documents, found by sorted hashes and returned as keep bitmaps; expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddline.llm.common import columns, lower_ascii, partitions
from oddline.session import durable

MIN_CHARS = 10
BLANKS = " \t\n\x0b\x0c\r"
WORD = 64  # lines of one word of a bitmap
# A bounded sketch per task finds every key with more than about a 50,000th of all lines.
HOT_KEYS, TRACKED = 4096, 65_536
DOCUMENT = ["doc_id", "_text"]
HASH = ["_h1", "_h2"]


def _body() -> Column:
    return F.coalesce("text", F.lit(""))


def _lower(text: Column) -> Column:
    """``lower_ascii``; a text of one byte per code point takes the cheaper way to the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, _text, pos, _h1, _h2``: a narrow row per line whose key is long enough to count."""
    lines = columns(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64(_body()).alias("_text"), F.posexplode(F.split(_lower(_body()), "\n")).alias("pos", "line")
    )
    keyed = lines.select(*DOCUMENT, "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        *DOCUMENT, "pos", F.xxhash64("key").alias("_h1"), F.xxhash64(F.lit(1), "key").alias("_h2")
    )


def salted(lines: DataFrame) -> DataFrame:
    """Adds ``_salts`` and ``_salt``: a key with more than one partition's share of all lines is cut into so many sub-keys."""
    found = lines.agg(
        F.expr(f"approx_top_k(_h1, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()  # at most HOT_KEYS pairs of numbers
    share = max(found["n"] // partitions(lines), 1)
    hot = [(r["item"], -(-r["count"] // share)) for r in found["top"] or [] if r["count"] > share]
    table = lines.sparkSession.createDataFrame(hot, "_h1 bigint, _salts bigint")
    return lines.join(F.broadcast(table), "_h1", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*DOCUMENT, "pos"), F.coalesce("_salts", F.lit(1)))
    )


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, _text, pos`` of every line that a smaller document holds, too.

    Hashes are dealt by ranges and sorted by document and position, so the first
    document of a key streams by before the others and no list of a key's lines is
    kept.  Sub-keys of a hot key each find their own first document; the smallest of
    those decides about the lines of the others.
    """
    window = Window.partitionBy(*HASH, "_salt").orderBy(F.col("doc_id").asc_nulls_last(), "_text", "pos")
    streamed = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = salted(hashed_lines(docs, min_chars)).repartitionByRange(*HASH, "_salt")
    first = dealt.withColumn("_late", ~F.col("doc_id").eqNullSafe(F.first("doc_id").over(streamed)))
    open_ = ~F.col("_late")
    found = durable(
        first.filter(F.col("_late") | F.col("_salts").isNotNull()).select(
            *DOCUMENT, "pos", *[F.when(open_, F.col(h)).alias(h) for h in HASH]
        ),
        "late-lines",
    )
    heads = found.filter("_h1 IS NOT NULL")
    lowest = heads.groupBy(*HASH).agg(F.min("doc_id").alias("_low"))  # hot keys only
    beaten = heads.join(F.broadcast(lowest), HASH).filter(~F.col("doc_id").eqNullSafe(F.col("_low")))
    return found.filter("_h1 IS NULL").select(*DOCUMENT, "pos").union(beaten.select(*DOCUMENT, "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, _text, n_dropped, keep`` of every document that loses lines.

    ``keep`` lists ``(word, bits)`` by word: bit ``i`` of word ``w`` tells whether line
    ``64 * w + i`` stays.  Words of which every line stays are left out.  ``_text`` is the
    hash of the whole text, for rows that share an id.
    """
    place = F.col("pos")
    words = (
        repeated_lines(docs, min_chars)
        .groupBy(*DOCUMENT, F.floor(place / WORD).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place % WORD)).alias("drop"))
    )
    return words.groupBy(*DOCUMENT).agg(
        F.sum(F.bit_count("drop")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits")))).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that the bitmap ``keep`` lets stay, joined by line ends; a null bitmap keeps all."""
    before = lambda i: F.when(i > 0, F.get(keep, i - 1)["word"]).otherwise(-1)
    full = F.lit(-1).cast("bigint")
    dense = F.flatten(
        F.transform(keep, lambda w, i: F.concat(F.array_repeat(full, w["word"] - before(i) - 1), F.array(w["bits"])))
    )

    def lines(bits: Column) -> Column:
        def stays(_, i: Column) -> Column:
            word = F.coalesce(F.get(bits, F.floor(i / WORD).cast("int")), full)
            return F.call_function("shiftrightunsigned", word, i % WORD).bitwiseAND(1) == 1

        return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")

    # The words are laid out once, not again for every line.
    return F.when(keep.isNull(), text).otherwise(F.transform(F.array(dense), lines)[0])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """What stays of every document: ``doc_id, n_lines, n_dropped, keep, kept_text``.

    Takes ``doc_id`` and ``text``; other columns are ignored.  A line's key is the line
    without blanks at its ends, A-Z lower-cased.  Keys of at least ``min_chars`` code
    points that two documents hold stay in the one with the smallest id only, there in
    every line.  A null or empty text is one empty line.  Rows with one id are one
    document; rows without id are one, too, and come last.  An empty table gives an
    empty result.  Keys are equal if 128 bits of hash are.
    """
    texts = columns(docs, "doc_id", "text").select("doc_id", _body().alias("text"), F.xxhash64(_body()).alias("_text"))
    maps = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), "n_dropped", "keep")
    both = texts.join(maps, texts["doc_id"].eqNullSafe(maps["_id"]) & (texts["_text"] == maps["_of"]), "left")
    ends = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    return both.select(
        "doc_id",
        (ends + 1).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        "keep",
        kept_text(F.col("text"), F.col("keep")).alias("kept_text"),
    )


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op11_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
        ), k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), f AS (
            SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key
            HAVING count(DISTINCT doc_id) >= 2
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM (SELECT k.*, f.key IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN f ON k.key = f.key)
        GROUP BY doc_id
    """
}
