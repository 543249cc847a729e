from datetime import datetime

from pyspark.sql import functions as F

from oddline.functions.text import CleanOptions, clean_text, parse_logs


def parse(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, raw_text string")
    return parse_logs(df, source="unit").orderBy("seq").collect()


def test_what_is_taken_out_of_a_line(spark):
    """One line for each rule: a time, a level, an address, signs, white space, and what stays."""
    lines = {
        "time in front": ("2031-12-24 18:00:00 bells", datetime(2031, 12, 24, 18), None, "bells"),
        "time behind": ("bells at 2031-12-24T18:00:00+01:00", datetime(2031, 12, 24, 18), None, "bells at"),
        "level anywhere": ("tower debug bells", None, "DEBUG", "tower bells"),
        "level in brackets": ("<Critical> bells", None, "CRITICAL", "<> bells"),
        "address": ("bells from 198.51.100.200:8080", None, None, "bells from <ip>:8080"),
        "second time": ("2031-12-24 18:00:00 till 2031-12-24 19:00:00", datetime(2031, 12, 24, 18), None, "till <timestamp>"),
        "time without a year": ("Dec 24 18:00:00 bells", None, None, "<timestamp> bells"),
        "signs": ("bells, {loud} & 100% [3]; -x_y.z: (a)", None, None, "bells loud  100 [3] -x_y.z: (a)"),
        "white space": ("\tbells \u3000 ring\x0b", None, None, "bells ring"),
    }
    rows = parse(spark, [line for line, *_ in lines.values()])
    for name, row, (line, time, level, cleaned) in zip(lines, rows, lines.values()):
        assert (row.timestamp, row.log_level, row.cleaned_text) == (time, level, cleaned), name
        assert (row.metadata.original_length, row.metadata.cleaned_length) == (len(line), len(cleaned)), name
        assert row.source == "unit"
    assert rows[1].message == "bells at" and rows[7].message == lines["signs"][0]


def test_time_formats(spark):
    rows = parse(
        spark,
        [
            "10/Oct/2023:13:55:36 GET /index",  # the last digit of the second is cut
            "at 1705312345 seconds",
            "at 1705312345123 milliseconds",
            "99999999999999 has too many digits in one run",
            "2024-13-45 10:00:00 is no date, 1705312345 is",
            "2024-01-15\t10:23:45 tab",
            "at 999999999999 far future",
            "no time at all",
        ],
    )
    assert [r.timestamp for r in rows] == [
        datetime(2023, 10, 10, 13, 55, 3),
        datetime(2024, 1, 15, 9, 52, 25),
        datetime(2024, 1, 15, 9, 52, 25, 123000),
        datetime(2286, 11, 20, 17, 46, 39, 999000),
        datetime(2024, 1, 15, 9, 52, 25),
        datetime(2024, 1, 15, 10, 23, 45),
        None,
        None,
    ]
    assert rows[0].message == "GET /index"
    assert rows[4].message == "2024-13-45 10:00:00 is no date,  is"


def test_log_id_prints_missing_time_and_fraction(spark):
    from hashlib import md5

    lines = ["plain", "2024-01-15 10:23:45 x", "1705312345123 y"]
    rows = parse(spark, lines)
    times = ["None", "2024-01-15 10:23:45", "2024-01-15 09:52:25.123000"]
    assert [r.log_id for r in rows] == [
        md5((line + t).encode()).hexdigest()[:12] for line, t in zip(lines, times)
    ]


def test_levels(spark):
    rows = parse(spark, ["warn: x", "Fatal y debug", "informational", "a WARNING b"])
    assert [r.log_level for r in rows] == ["WARNING", "FATAL", None, "WARNING"]
    assert [r.message for r in rows] == [": x", "y debug", "informational", "a  b"]


def test_cleaning_options_and_unicode(spark):
    df = spark.createDataFrame(
        [("Été /var/log/x.txt 0xFFa1  naïve 550e8400-e29b-41d4-a716-4466554abc0a!",)], "t string"
    )
    default = df.select(clean_text(F.col("t"))).first()[0]
    assert default == "été varlogx.txt <hex> naïve <uuid>"
    paths = df.select(clean_text(F.col("t"), CleanOptions(mask_paths=True, lowercase=False))).first()[0]
    assert paths == "Été <PATH> <HEX> naïve <UUID>"
    short = df.select(clean_text(F.col("t"), CleanOptions(max_length=4))).first()[0]
    assert short == "été"


def test_long_text_is_cleaned_whole(spark):
    text = "word " * 5000 + "10.0.0.1"
    df = spark.createDataFrame([(text,)], "t string")
    whole = df.select(clean_text(F.col("t"))).first()[0]
    assert whole.endswith("word <ip>") and len(whole) == 5000 * 5 + 4
    assert len(df.select(clean_text(F.col("t"), CleanOptions(max_length=512))).first()[0]) <= 512
