"""Quality rules: a decision list learned from labelled statistics.

Statistics of whole texts are built-in column expressions. Labelled rows are cut
at quantiles; sequential covering grows one conjunction of thresholds at a time
by information gain on one part of them, prunes it on the other, keeps it if its
precision there is proven high, and removes what it covers. The rules become one
ordered conditional expression. Everything counted is a Spark aggregate; the
driver holds one count per statistic and cut.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BLANKS, free_name, sampled
from trackloom.session import cut_lineage

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Labelled rows that a fit uses at most, chosen by a hash of the id.
FIT_ROWS = 20_000
CUTS = 24
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the statistics of column text (null: no words), row by row.

    Words stand between ASCII blanks. n_repeat_words counts the words that lie in
    a window of three words which the text has twice or more: windows are hashed
    and, only where two are equal, sorted to find them. Other columns go.
    """
    text = F.coalesce("text", F.lit(""))
    plain = F.btrim(text, F.lit(BLANKS))
    words = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    kept = [F.col(c).alias(f"_{k}") for k, c in enumerate(keep)]
    names = [f"_{k}" for k in range(len(keep))]
    df = docs.select(*kept, text.alias("t"), words.alias("w"), lines.alias("l"))
    windows = F.when(F.size("w") > 2, F.transform(
        F.sequence(F.lit(0), F.size("w") - 3),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*names, "t", "w", "l", windows.alias("h"))
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    letters = F.length(_without(F.col("t"), BLANKS))
    counts = [F.size("w").cast("long").alias("n_words"), letters.cast("long").alias("word_chars"),
              (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
              (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
              F.size("l").cast("long").alias("n_lines"),
              (F.length("t") - F.length(_without(F.col("t"), UPPER))).cast("long").alias("n_upper"),
              (F.length("t") - F.length(_without(F.col("t"), "!"))).cast("long").alias("n_cries"),
              (F.length("t") - F.length(_without(F.col("t"), "0123456789"))).cast("long").alias("n_digits")]
    df = df.select(*names, *counts, pairs.alias("p"))
    twice = F.filter("p", lambda e, k: (F.get("p", k - 1)["x"] == e["x"]) | (F.get("p", k + 1)["x"] == e["x"]))
    places = F.sort_array(F.transform(twice, lambda e: e["i"]))
    done = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_cries", "n_digits"]
    df = df.select(*names, *done, places.alias("s"))
    covered = F.aggregate(
        F.transform("s", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("s", k + 1), at + 3) - at)), F.lit(0), lambda a, b: a + b)
    # A row of one: filters on the statistics stay above it and do not repeat their work.
    once = F.explode_outer(F.array(F.struct(*done, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))))
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], once.alias("_s")).select(*keep, "_s.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules compare: numbers that do not depend on a text's length, and its length."""

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {"words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"),
            "symbols": share("n_symbols", "word_chars"), "repeated_lines": share("n_dup_lines", "n_lines"),
            "repeated_words": share("n_repeat_words", "n_words"), "capitals": share("n_upper", "word_chars"),
            "cries": share("n_cries", "word_chars"), "digits": share("n_digits", "word_chars"),
            "line_words": share("n_words", "n_lines")}


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.name] > self.cut if self.above else columns[self.name] <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


def _all(rule: list[Condition], columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column(columns)
    return out


def _sure(hits: int, misses: int, z: float = 1.64) -> float:
    """Lower end of the Wilson interval of a share."""
    n = hits + misses
    if not n:
        return 0.0
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _cell_counts(rows: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> dict:
    """(name, index of the first cut that is not below the value) -> counts of bad and good rows."""
    def below(name: str) -> Column:
        return F.size(F.filter(F.lit(cuts[name]), lambda cut: cut < F.col(name)))

    places = F.array(*[F.struct(F.lit(k).alias("f"), below(n).alias("b")) for k, n in enumerate(names)])
    found = (rows.select("bad", F.explode(places).alias("x")).groupBy("x.f", "x.b")
             .agg(F.sum(F.col("bad").cast("long")).alias("y"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect())
    return {(names[r["f"]], r["b"]): (r["y"], r["n"]) for r in found}


def _best_condition(counts: dict, names: list[str], cuts: dict[str, list[float]], bad: int, good: int):
    best, base = (0.0, None, 0, 0), math.log2(bad / (bad + good))
    for name in names:
        y = n = 0
        for k, cut in enumerate(cuts[name]):
            dy, dn = counts.get((name, k), (0, 0))
            y, n = y + dy, n + dn
            for above, p, q in ((False, y, n), (True, bad - y, good - n)):
                if p and p + q < bad + good:
                    gain = p * (math.log2(p / (p + q)) - base)
                    if gain > best[0] + 1e-12:
                        best = (gain, Condition(name, above, cut), p, q)
    return best


def learn_rules(labelled: DataFrame, precision: float = 0.8, max_rules: int = 8, max_conditions: int = 3) -> list[list[Condition]]:
    """Decision list for bad rows from a table of statistics with boolean bad and
    a key column. An empty table, or one class alone, gives no rule."""
    columns = features()
    names = list(columns)
    rows = cut_lineage(labelled.select("bad", (F.pmod(F.xxhash64("key"), F.lit(3)) > 0).alias("grow"),
                                       *[c.alias(n) for n, c in columns.items()])).coalesce(4)  # about FIT_ROWS rows
    shares = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
    found = rows.agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).first()
    if found[names[0]] is None:
        return []
    cuts = {n: sorted(set(found[n])) for n in names}
    held = {n: F.col(n) for n in names}
    left, rules = F.lit(True), []
    while len(rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            counts = _cell_counts(rows.where(F.col("grow") & left & _all(rule, held)), names, cuts)
            bad = sum(v[0] for (n, _), v in counts.items() if n == names[0])
            good = sum(v[1] for (n, _), v in counts.items() if n == names[0])
            if not bad or not good:
                break
            _, condition, _, _ = _best_condition(counts, names, cuts, bad, good)
            if condition is None:
                break
            rule.append(condition)
        if not rule:
            break
        prefixes = [rule[:k + 1] for k in range(len(rule))]
        tried = rows.where(~F.col("grow") & left).agg(*[
            F.count_if(_all(p, held) & (F.col("bad") if bad_ else ~F.col("bad"))).alias(f"c{k}{bad_}")
            for k, p in enumerate(prefixes) for bad_ in (True, False)]).first()
        sure = [_sure(tried[f"c{k}True"] or 0, tried[f"c{k}False"] or 0) for k in range(len(prefixes))]
        best = max(range(len(prefixes)), key=lambda k: (sure[k], -k))
        if sure[best] < precision:
            break
        rules.append(prefixes[best])
        left = left & ~_all(prefixes[best], held)
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True (keep) unless a rule fires; the first that fires decides."""
    columns, out = features(), None
    for rule in rules:
        out = F.when(_all(rule, columns), F.lit(False)) if out is None else out.when(_all(rule, columns), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> list[list[Condition]]:
    """Rules from documents and labels (doc_id, quality 0 or 1; others are left
    out; conflicting labels of an id count as good)."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    total = known.count()
    if not total:
        return []
    sample = sampled(known, "doc_id", fit_rows, total)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most about fit_rows rows
    return learn_rules(text_statistics(rows, "doc_id", "bad").withColumnRenamed("doc_id", "key"), **options)


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the five base statistics, base_failed and kept of every row.

    A null or blank text has no words and fails. Repeated rows are judged alike;
    an empty table gives an empty result; no labels, no learned rule.
    """
    rules = fit(docs, labels, **options)
    return (text_statistics(docs, "doc_id").withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)).select("doc_id", *BASE, "base_failed", "kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows whose text passes, all columns as they were."""
    rules = fit(docs, labels, **options)
    row = free_name(docs, "_row")
    packed = docs.select(F.struct(*docs.columns).alias(row), F.col("text"))
    passed = text_statistics(packed, row).where(~base_failed() & verdict(rules))
    return passed.select(f"{row}.*")
