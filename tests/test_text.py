from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import text


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


CLEANED = {
    None: None, "": None, "   ": None, " x ": "x", "a  b\t\nc": "a b c", "['A', \"B\"]": "A B", "[]": None, "[ ]": None,
    "[": "[", "[x": "[x", "x]": "x]", "a,b": "a,b", "\x1cedge\x1f": "edge", "line\n": "line", "['It', 's']": "It s",
    "\u3000wide\u3000": "wide"}


def test_clean_text(spark):
    assert apply(spark, list(CLEANED), text.clean_text) == list(CLEANED.values())


JOINED = {None: None, "": None, " ": None, "['A', \"B\"]": "A; B", "[X]": "X", "[]": "[]", "a;b ;  c": "a; b; c",
          "; a;": "; a; ", "['', 'x ']": "x", "plain": "plain"}


def test_joined_artists(spark):
    assert apply(spark, list(JOINED), text.joined_artists) == list(JOINED.values())


def test_primary_artist(spark):
    values = [None, " ", "['A', 'B']", "[X]", "[]", " one ", "['  pad ']"]
    assert apply(spark, values, lambda c: text.primary_artist(c, T.StringType())) == [
        None, None, "A", "[X]", "[]", "one", "pad"]
    arrays = spark.createDataFrame([(0, ["a ", "b"]), (1, []), (2, None)], "i int, v array<string>").orderBy("i")
    kind = arrays.schema["v"].dataType
    assert [r[0] for r in arrays.select(text.primary_artist(F.col("v"), kind)).collect()] == ["a", None, None]


def test_list_literals(spark):
    firsts = {"['A'] feat ['B']": "['A'] feat ['B']", "['A',]": "A", "[true]": "[true]", "['A', None]": "A", "[1, 'x']": "1",
              "['A' , \"it's\"]": "A", "['it\\'s']": "it's", "[None]": "None", "['A'": "['A'", "['a\nb', 'c']": "a\nb", "[,]": "[,]",
              "['" + "x" * 50_000 + "']": "x" * 50_000, "[" + "'y', " * 20_000 + "]": "y"}
    got = apply(spark, list(firsts), lambda c: text.primary_artist(c, T.StringType()))
    assert got == list(firsts.values())
    assert apply(spark, ["['A', None, 2.5]", "['A'] x ['B']"], text.joined_artists) == ["A; None; 2.5", "'A'] x ['B'"]


SLUGS = {"Hello!": "hello", "Hello?": "hello", "Café": "cafe", "Straße": "strae", "\ufb01ne": "fine", "日本": "unknown",
         "": "unknown", "__a__b__": "a_b", "Ångström ½": "angstrom_12", "A-B": "a_b"}


def test_slug(spark):
    assert apply(spark, list(SLUGS), text.slug) == list(SLUGS.values())


def test_keys_numbers_and_hash(spark):
    df = spark.createDataFrame([(" Ann ", "Song "), ("", "x"), (None, "y")], "a string, t string")
    assert [r[0] for r in df.select(text.artist_track_key(F.col("a"), F.col("t"))).collect()] == ["ann||song", None, None]
    assert apply(spark, ["1", "2.5", "x", None, "NaN"], text.to_number) == [1.0, 2.5, None, None, None]
    assert apply(spark, ["abc"], text.short_hash) == ["a9993e36"]


def test_strip_takes_every_blank_and_nothing_else(spark):
    chars = spark.range(1, 0x30000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    found = chars.select("c", text.strip(F.concat("c", F.lit("a"), "c", F.lit("b"), "c")).alias("s"))
    wanted = F.regexp_replace(F.concat("c", F.lit("a"), "c", F.lit("b"), "c"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    assert found.where(~F.col("s").eqNullSafe(wanted)).isEmpty()
    assert found.where(F.length("s") == 3).count() == 29
    assert "regexp_replace" not in str(text.strip(F.col("c")))
