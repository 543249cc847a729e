"""Fill-in-the-middle training texts, cut by one counted pattern per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddline.llm.common import columns

TOKEN = "[A-Za-z]+|[^A-Za-z]"
# A whole run of letters or one other code point; nothing is given back, so counting is a loop.
UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
CUT = rf"(?s)\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)(.*)\z"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
# The signs before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WRITE = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
READ = {
    "psm": (rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2"),
    "spm": (rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1"),
}


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers that depend on the id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of, from nothing but output and form."""
    psm, spm = (F.regexp_replace(output, F.lit(p), F.lit(r)) for p, r in (READ["psm"], READ["spm"]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, seed: str = "1") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: every text with a middle moved to its end.

    Takes ``doc_id`` and ``text``; other columns are ignored.  A unit is a run of A-Z
    letters or one other code point; ``n`` counts them.  Both cuts are drawn from the id,
    anywhere between two units.  A null or empty text, one that holds a sign of its own,
    and ``plain_percent`` of the others stay as they are (null counts as empty).  Rows
    with one id are cut by the same draws; a null id draws as an empty one.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    signs = F.lit(False)
    for sign in (PREFIX, SUFFIX, MIDDLE):
        signs = signs | F.contains("text", F.lit(sign))
    plain = (F.col("text") == "") | signs | (h3 % 100 >= 100 - plain_percent)
    counted = (
        columns(docs, "doc_id", "text")
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .select("doc_id", "text", F.regexp_count("text", F.lit(TOKEN)).cast("bigint").alias("n"))
        .select(
            "doc_id", "text", "n",
            F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
            (h1 % (F.col("n") + 1)).alias("_one"), (h2 % (F.col("n") + 1)).alias("_two"),
        )
    )
    first, last = F.least("_one", "_two"), F.greatest("_one", "_two")
    cut = F.regexp_replace(
        "text", F.format_string(CUT, first, last - first),
        F.when(F.col("form") == "psm", WRITE["psm"]).otherwise(WRITE["spm"]),
    )
    written = counted.select(
        "doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(cut).alias("output")
    )
    # No sign is in the text, so the first of each is the one that was put in.
    at = {sign: F.locate(sign, F.col("output")) for sign in (PREFIX, SUFFIX, MIDDLE)}
    width, moved = len(PREFIX), F.col("form") != "plain"
    next_sign = F.when(F.col("form") == "psm", at[SUFFIX]).otherwise(at[MIDDLE])
    return written.select(
        "doc_id", "n", "form",
        F.when(moved, next_sign - at[PREFIX] - width).cast("bigint").alias("prefix_chars"),
        F.when(moved, F.char_length("output") - at[MIDDLE] - width + 1).cast("bigint").alias("middle_chars"),
        "output",
    )


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = {
    "op13_fill_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
        ), d AS (
            SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS one,
                   ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS two, ('0x' || h[17:24])::BIGINT % 100 AS three,
                   ('0x' || h[25:32])::BIGINT % 100 AS four FROM t
        ), c AS (
            SELECT doc_id, text, n,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                        OR three >= 90 THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(u[:least(one, two)], '') AS p,
                   array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m,
                   array_to_string(u[greatest(one, two) + 1:], '') AS s FROM d
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
        FROM c
    """
}
