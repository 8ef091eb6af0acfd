"""Queries of text functions, over paragraphs of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as D
from .model import PARAGRAPHS_SQL, paragraphs, table
from .registry import query

_P = f"WITH {PARAGRAPHS_SQL}"
_VOTES = ", ".join(
    f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stops.split())}))) AS {lang}_" for lang, stops in T.STOP_WORDS.items()
)
_BEST = "greatest(" + ", ".join(f"{lang}_" for lang in T.STOP_WORDS) + ")"
_ARGMAX = "CASE " + " ".join(f"WHEN {lang}_ = {_BEST} THEN '{lang}'" for lang in T.STOP_WORDS) + " END"


def _count(ranges: str) -> str:
    return f"length(regexp_replace(s, '[^{ranges}]', '', 'g'))"


_LANGUAGE = f"""WITH d AS (SELECT doc_id, lang AS truth, substr(coalesce(text, ''), 1, 300000) AS s FROM documents),
c AS (
  SELECT doc_id, truth, regexp_extract_all(lower(s), '[a-zà-ÿ]+') AS w, {_count(T.CJK)} AS cjk, {_count('぀-ヿ')} AS kana, {_count('؀-ۿݐ-ݿ')} AS arabic,
    {_count('Ѐ-ӿ')} AS cyrillic, {_count('A-Za-zÀ-ɏ')} AS latin, {_count('ऀ-ॿ')} AS hindi FROM d),
v AS (SELECT *, cjk + arabic + cyrillic + latin AS letters, {_VOTES} FROM c),
l AS (
  SELECT doc_id, truth, CASE WHEN hindi > 0.3 * (letters + hindi) THEN 'hi' WHEN letters = 0 THEN 'other' WHEN cjk > 0.2 * letters THEN CASE WHEN kana > 0.1 * cjk THEN 'ja' ELSE 'zh' END
    WHEN arabic > 0.3 * letters THEN 'ar' WHEN cyrillic > 0.3 * letters THEN 'ru' WHEN len(w) = 0 THEN 'other' WHEN {_BEST} = 0 THEN 'en' ELSE {_ARGMAX} END AS detected FROM v)"""


@query(f"{_LANGUAGE} SELECT doc_id, detected FROM l")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detect_languages(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"{_LANGUAGE} SELECT truth AS lang, detected, count(*) AS n FROM l GROUP BY truth, detected")
def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = T.detect_languages(table(spark, sf_dir, "documents"), ["lang"], "text")
    return told.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'zh') THEN lang ELSE 'en' END AS language, CASE WHEN lang NOT IN ('en', 'zh') THEN 'This book looks like it''s in ' || n || '. The current voice engine reads English, Chinese, so ' || n ||
  ' narration may sound wrong or heavily accented. Try one chapter first.' END AS warning FROM (SELECT doc_id, lang, CASE lang WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' WHEN 'ru' THEN 'Russian' ELSE 'an unrecognised language' END AS n FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'zh' WHEN 1 THEN 'ru' WHEN 2 THEN 'xx' ELSE lang END AS lang FROM documents))""")
def narration_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some texts are of languages that voices read, others of ones that nobody knows."""
    k = F.col("doc_id") % 5
    lang = F.when(k == 0, "zh").when(k == 1, "ru").when(k == 2, "xx").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.narration_language(lang).alias("n")).select("doc_id", "n.*")


@query(f"""{_P} SELECT book_id, para_no, trim(regexp_replace(text, '[ \\t\\r\\f\\x0B]+', ' ', 'g')) AS cleaned,
  CAST(len(regexp_extract_all(text, '[㐀-鿿]')) + len(regexp_extract_all(text, '[A-Za-zÀ-ÿ0-9'']+')) AS INT) AS words, regexp_replace(lower(text), '[^0-9a-z㐀-鿿]+', '', 'g') AS title_key FROM paragraphs""")
def paragraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T01, T19, T20."""
    return paragraphs(spark, sf_dir).select("book_id", "para_no", T.clean_text("text").alias("cleaned"), T.word_count("text").alias("words"), T.title_key("text").alias("title_key"))


@query(f"""{_P}, k AS (SELECT book_id, para_no, lower(text) AS t, text FROM paragraphs)
SELECT book_id, para_no, length(trim(text)) BETWEEN 1 AND 12 AND NOT regexp_matches(trim(text), '[A-Za-z0-9{T.CJK}]') AS scene_break,
  regexp_matches(trim(text, ' .:'), '{T.SKIP_TITLE}') AS front_matter, regexp_matches(text, '{T.PART_TITLE}') AS part_title, regexp_matches(text, '{T.CONTENTS_LINE}') AS contents_line,
  regexp_matches(text, '{T.PAGE_NUMBER}') AS page_number, regexp_matches(text, '{T.JUNK_TEXT}') AS junk FROM k""")
def paragraph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P09, P11, P19, T35."""
    t = F.col("text")
    return paragraphs(spark, sf_dir).select(
        "book_id", "para_no", T.is_scene_break(t).alias("scene_break"), F.regexp_replace(t, "^[ .:]+|[ .:]+$", "").rlike(T.SKIP_TITLE).alias("front_matter"), t.rlike(T.PART_TITLE).alias("part_title"),
        t.rlike(T.CONTENTS_LINE).alias("contents_line"), t.rlike(T.PAGE_NUMBER).alias("page_number"), t.rlike(T.JUNK_TEXT).alias("junk"),
    )


@query(f"""{_P}, k AS (SELECT book_id, para_no, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '^\\W*[ivxlcdm]+\\W+|\\W+[ivxlcdm]+\\W*$', '', 'g'), '\\s+', ' ', 'g'), ' .|-–—') AS key FROM paragraphs)
SELECT book_id, key, count(*) AS times FROM k WHERE key <> '' GROUP BY book_id, key HAVING count(*) >= 3""")
def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T18, J18."""
    keyed = paragraphs(spark, sf_dir).select("book_id", T.edge_key("text").alias("key")).where("key != ''")
    return keyed.groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("times")).where("times >= 3")


@query(f"""{_P} SELECT book_id, word, count(*) AS n FROM (SELECT book_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ’'']+')) AS word FROM paragraphs) GROUP BY book_id, word""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.vocabulary(paragraphs(spark, sf_dir), ["book_id"])


@query("""WITH t AS (SELECT o_orderkey, o_custkey % 4000 AS n FROM orders),
w AS (SELECT *, repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1]
  || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS token FROM t)
SELECT o_orderkey, token, CAST(CASE WHEN n > 0 THEN n END AS INT) AS value, CAST(NULL AS INT) AS wrong FROM w""")
def roman_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals of all numbers; with a letter too many they have no value."""
    n = F.col("n")
    digit = lambda names, power: F.get(F.array(*[F.lit(x) for x in names.split(",")]), (F.floor(n / power) % 10).cast("int"))
    token = F.concat(
        F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(",C,CC,CCC,CD,D,DC,DCC,DCCC,CM", 100), digit(",x,xx,xxx,xl,l,lx,lxx,lxxx,xc", 10), digit(",I,II,III,IV,V,VI,VII,VIII,IX", 1)
    )
    said = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4000).alias("n")).withColumn("token", token)
    return said.select("o_orderkey", "token", T.roman_value("token").alias("value"), T.roman_value(F.concat("token", F.lit("iiii"))).alias("wrong"))


@query("""SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) % 360 AS hue,
  150 + CAST('0x' || substr(sha1(p_name), 1, 6) AS BIGINT) % 140 AS pitch, substr(sha1(p_name || chr(1) || p_brand), 1, 16) AS plan_key FROM part""")
def stable_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T37, T38, T39."""
    return table(spark, sf_dir, "part").select("p_partkey", T.hue("p_name").alias("hue"), T.pitch("p_name").alias("pitch"), T.plan_key("p_name", "p_brand").alias("plan_key"))


@query("""SELECT DISTINCT substr(sha1(coalesce(text, '')), 1, 16) AS plan_key FROM documents WHERE doc_id % 2 = 0
EXCEPT SELECT substr(sha1(coalesce(text, '')), 1, 16) FROM documents WHERE doc_id % 2 = 1""")
def plan_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work whose key isn't known yet."""
    from ..sources.documents import new_work

    docs = table(spark, sf_dir, "documents").withColumn("plan_key", T.plan_key(F.coalesce("text", F.lit(""))))
    return new_work(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "plan_key").select("plan_key").distinct()


@query(r"""WITH t AS (SELECT doc_id, 'THE ' || upper(substr(coalesce(lang, ''), 1, 2)) || ' OF A BOOK: CHAPTER XIV' AS title, '/tmp/some_' || source || '-file_name.pdf' AS file, 'say "' || source || '" and  "no"' AS said FROM documents)
SELECT doc_id, 'The ' || upper(lang[1]) || lang[2] || ' of a Book: Chapter XIV' AS pretty, 'Some ' || upper(source[1]) || source[2:] || ' File Name' AS from_file, 'say “' || source || '” and “no”' AS quotes,
  'a=1;' || source AS plain, 'a\=1\;' || source AS escaped, 'file ''it''\''''s ' || source || '''' AS listed, 'four ' || CASE WHEN doc_id % 2 = 0 THEN 'two' ELSE 'one' END AS digits, 'ab c' || source AS safe,
  'https://x.org/p?a=1' AS stripped, 'https://x.org/p?a=1&token=s%2520t' AS with_token, 'https://h.org/base' AS server FROM (SELECT d.doc_id, d.lang, d.source FROM documents d JOIN t USING (doc_id))""")
def title_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T05, T21, T22, T24 to T26, T32, T33."""
    d = table(spark, sf_dir, "documents")
    title = F.concat(F.lit("THE "), F.upper("lang"), F.lit(" OF A BOOK: CHAPTER XIV"))
    return d.select(
        "doc_id", T.pretty_title(title).alias("pretty"), T.title_from_filename(F.concat(F.lit("/tmp/some_"), "source", F.lit("-file_name.pdf"))).alias("from_file"),
        T.curly_quotes(F.concat(F.lit('say "'), "source", F.lit('" and  "no"'))).alias("quotes"), F.concat(F.lit("a=1;"), "source").alias("plain"), T.meta_escape(F.concat(F.lit("a=1;"), "source")).alias("escaped"),
        T.concat_line(F.concat(F.lit("it's "), "source")).alias("listed"), T.digits_words(F.when(F.col("doc_id") % 2 == 0, "42").otherwise("41")).alias("digits"),
        T.safe_name(F.concat(F.lit("ab/:c"), "source")).alias("safe"), T.without_token(F.lit("https://x.org/p?token=q&a=1")).alias("stripped"),
        T.with_token(F.lit("https://x.org/p?a=1"), F.lit("s%20t")).alias("with_token"), T.server_address(F.lit(" https://h.org/base/api/ ")).alias("server"),
    )
