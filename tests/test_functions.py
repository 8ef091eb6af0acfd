"""Golden values of expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.functions import numbers as N
from folioflow.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.unspace_letters, "C H A P T E R   O N E", "CHAPTER ONE"),
        (T.unspace_letters, "I am a cat and I sat.", "I am a cat and I sat."),
        (T.unspace_letters, "x = 1 2 3 4", "x = 1 2 3 4"),
        (T.clean_meta, "(anonymous)", ""),
        (T.clean_meta, "Untitled", ""),
        (T.clean_meta, "Microsoft Word - draft.docx", ""),
        (T.clean_meta, "Document1", ""),
        (T.clean_meta, " “Emma” ", "Emma"),
        (T.clean_text, "  of­ﬁce\t x ", "office x"),
        (T.curly_quotes, 'He said "hi".', "He said “hi”."),
        (T.roman_value, "XIV", 14),
        (T.roman_value, "IIII", None),
        (T.roman_value, "", None),
        (T.detect_language, "The house was on the hill and it was old, but they had not been there for years.", "en"),
        (T.detect_language, "Le chat est sur la table et les enfants ne sont pas dans la maison.", "fr"),
        (T.detect_language, "他回家了。天黑了！你好吗？", "zh"),
        (T.detect_language, "12 34", "other"),
        (T.title_from_filename, "my_great-book.pdf", "My Great Book"),
        (T.safe_filename, "a/b: c?", "ab c"),
        (T.safe_filename, "???", "audiobook"),
        (T.hue, "", 0),
        (T.word_count, "第三章 two words", 5),
        (T.is_scene_break, "* * *", True),
        (T.is_scene_break, "Yes", False),
        (T.pretty_title, "THE END OF A STORY", "The End of a Story"),
        (N.clock, 3725.9, "1:02:05"),
        (N.clock, -3.0, "0:00"),
        (N.long_time, 3900.0, "1 h 05 m"),
        (N.long_time, 20.0, "< 1 m"),
        (N.bytes_text, 1536.0, "2 KB"),
        (N.bytes_text, 5.5 * 1024 * 1024, "5.5 MB"),
        (N.half_up, -2.5, -2),
        (N.half_up, 2.5, 3),
        (N.pace, float("nan"), 0.8),
    ],
)
def test_value(spark, f, given, expected):
    assert value(spark, f(F.lit(given))) == expected


def test_sentences_of_other_scripts(spark):
    assert value(spark, T.split_unspaced(F.lit("他回家了。天黑了！你好吗？"))) == ["他回家了。", "天黑了！", "你好吗？"]
    assert value(spark, T.split_hindi(F.lit("क। ख। ग"))) == ["क।", "ख।", "ग"]


def test_join_lines(spark):
    join = lambda *lines: value(spark, T.join_lines(F.array(*[F.lit(x) for x in lines])))
    assert join("some-", "thing") == "something"
    assert join("Croquet-", "Ground") == "Croquet-Ground"
    assert join("a --", "b") == "a -- b"
    assert join("第", "三") == "第三"


def test_days(spark):
    assert value(spark, N.valid_day(F.lit("2024-02-31"))) is None
    assert value(spark, N.valid_day(F.lit("bad-day"))) is None
    assert value(spark, N.valid_day(F.lit("2024-02-29"))) == datetime.date(2024, 2, 29)
    assert value(spark, N.falsy(F.lit(0), 7)) == 7
