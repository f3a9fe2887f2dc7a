"""Text column expressions.

Blank space means every Unicode white-space character plus the four ASCII
separators, which is wider than Spark's own ``trim``.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"[\s\x1c-\x1f]"
# The characters of _BLANK one by one: trimming needs no search, which costs most where nothing is trimmed.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
_RUNS = rf"(?U){_BLANK}+"

# An item of a list literal: a quoted text, a plain number, None, True or False.
_ITEM = r"""(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?\d++(?:\.\d++)?+|None|True|False)"""
_LIST = rf"(?s)\A\[\s*+(?:{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+,?\s*+)?+\]\z"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_or_empty(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def is_bracketed(c: Column) -> Column:
    return c.startswith("[") & c.endswith("]")


def _inside(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.length(c) - 2)


def clean_text(c: Column) -> Column:
    """Null for blank; unwrap ``[..]`` dropping quotes and commas; squeeze blanks."""
    text = strip(c)
    unwrapped = F.when(is_bracketed(text), F.translate(_inside(text), "'\",", "   ")).otherwise(text)
    return F.nullif(strip(F.regexp_replace(unwrapped, _RUNS, " ")), F.lit(""))


def artist_track_key(artist: Column, track: Column) -> Column:
    """Case-folded ``artist||track``; null when either part is null or blank."""
    parts = [F.nullif(strip(F.lower(c)), F.lit("")) for c in (artist, track)]
    return F.concat(parts[0], F.lit("||"), parts[1])


def parse_list(c: Column) -> Column:
    """Array of strings from a list literal such as ``['A', "B"]``, else null.

    The whole text must be one flat list; a comma may follow its last item. Of a
    backslash and a character the character stays.
    """
    items = F.regexp_extract_all(c, F.lit(f"(?s){_ITEM}"), F.lit(0))

    def plain(item: Column) -> Column:
        quoted = item.startswith("'") | item.startswith('"')
        return F.when(quoted, F.regexp_replace(_inside(item), r"(?s)\\(.)", "$1")).otherwise(item)

    return F.when(F.regexp_like(c, F.lit(_LIST)), F.transform(items, plain))


def primary_artist(c: Column, data_type: T.DataType) -> Column:
    """First artist of an array column, or of a string that may be a list literal."""
    if isinstance(data_type, T.ArrayType):
        return strip(F.try_element_at(c, F.lit(1)).cast("string"))
    text = F.nullif(strip(c.cast("string")), F.lit(""))
    first = strip(F.try_element_at(parse_list(text), F.lit(1)))
    return F.coalesce(F.when(is_bracketed(text), first), text)


def joined_artists(c: Column) -> Column:
    """Final artist spelling: parts joined by ``"; "``, wrappers removed."""
    text = F.nullif(strip(c), F.lit(""))
    parts = F.filter(F.transform(parse_list(text), strip), lambda p: p.isNotNull() & (p != ""))
    from_list = F.when(is_bracketed(text) & (F.size(parts) > 0), F.array_join(parts, "; "))
    inner = F.nullif(strip(_inside(text)), F.lit(""))
    plain = F.when(is_bracketed(text), F.coalesce(inner, text)).otherwise(text)
    tidy = F.array_join(F.transform(F.split(plain, ";"), strip), "; ")
    return F.coalesce(from_list, F.nullif(tidy, F.lit("")))


def to_number(c: Column) -> Column:
    """Double; null for text that is no number, and for NaN."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


@F.pandas_udf(T.StringType())
def _ascii_fold(values: pd.Series) -> pd.Series:
    def fold(v):
        if v is None:
            return None
        return unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode()

    return values.map(fold)


def slug(c: Column) -> Column:
    """ASCII slug. Only text with a non-ASCII character reaches Python: Spark
    has no compatibility decomposition, everything else stays in the JVM."""
    other = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    folded = F.when(other.isNull(), c).otherwise(_ascii_fold(other))
    dashed = F.regexp_replace(F.lower(folded), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.trim(dashed, F.lit("_")), F.lit("")), F.lit("unknown"))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 8)


def edge_id(source: Column, target: Column) -> Column:
    return F.concat_ws("__", source, target)


def query_text(c: Column) -> Column:
    return F.lower(strip(c))
