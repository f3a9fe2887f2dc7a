"""Personal data: patterns as seeds, and what their contexts discover.

Base entities seed the extraction. Every mention of an identifier-like token, seed
or not, has lexical contexts: the two words before it, and the word before it if
that ends as a label does. Spark scores the graph of contexts and instances to its
fixed point: a context is as good as the instances it holds, an instance as its best
context. Unseen instances are no evidence against a context. Contexts count that many
different seeds prove, or seeds together with instances that better contexts prove; what
else stands in them is discovered.
"""

import re

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import free_name, prepare, texts
from trackloom.session import cut_lineage

# Fixed values of the query. Each is the pattern asked for, written so that a run
# of letters or digits is looked at once.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = regex.compile(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

FOUND = "context"
_ANCHOR = re.compile(r"[0-9]{2,}|@")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+()/:-")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NUMBER = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]")
_EDGES = ".,;!?\"'()[]*%$#&"
# A context needs the posterior that so many different seeds give, by seeds or by
# instances that it shares with better contexts.
SEEDS = 5
SURE = (SEEDS + 1) / (SEEDS + 3)
# So large a share of a context's different instances must be seeds or lent by proved
# contexts, at 95 % sureness; else a frequent context would be proved by the few seeds
# that chance puts there.
SHARE = 0.05
# Scores that move by no more than this have settled.
SETTLED = 1e-9


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the patterns find, leftmost and without
    overlap within a kind; failing matches are dropped."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    numbers = _DIGIT.search(text) is not None
    for m in IP.finditer(text) if numbers else ():
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text) if numbers else ():
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def _shape(word: str) -> str:
    """A context word, numbers in it as 0, so that places that differ only in them are one."""
    return _NUMBER.sub("0", word.lower().strip(_EDGES)) or "."


def _context(text: str, start: int) -> list[str]:
    """Contexts of what starts there: its two words before ("^" where the text begins,
    "." for punctuation), and the word before if it labels what follows. They are
    shapes where a word of letters is among them, and as they stand otherwise."""
    before = _WORD.findall(text[max(0, start - 80):start])
    if len(before) > 1 and start > 80:
        before = before[1:]  # the first may be cut
    out = []
    plain = [w.lower().strip(_EDGES) for w in before[-2:]]
    words = [_shape(w) for w in before[-2:]]
    if start <= 80:
        words = ["^"] * (2 - len(words)) + words
    if len(words) == 2 and any(_LETTERS.search(w) and not _DIGIT.search(w) for w in words):
        out.append(" ".join(words))
    elif len(plain) == 2 and all(plain):
        out.append(" ".join(plain))
    if before and before[-1][-1] in ":=#" and len(before[-1]) > 1:
        label = before[-1].lower()
        out.append(_NUMBER.sub("0", label.lstrip(_EDGES)) if _LETTERS.search(label) else label)
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, str, list[str]]]:
    """(start, end, seed, instance, contexts) of base entities and of other
    identifier-like tokens: five or more characters, at least four of them digits,
    or with an @, apart from base entities."""
    out = [(s, e, True, text[s:e].lower(), _context(text, s)) for s, _, e in base]
    done = 0
    for m in _ANCHOR.finditer(text):
        if m.start() < done:
            continue
        start, done = m.start(), m.end()
        while start and text[start - 1] in _TOKEN:
            start -= 1
        while done < len(text) and text[done] in _TOKEN:
            done += 1
        token = text[start:done].rstrip(".:-/")
        end = start + len(token)
        if len(token) >= 5 and ("@" in token or len(_digits(token)) >= 4) and not any(s < end and start < e for s, _, e in base):
            out.append((start, end, False, token.lower(), _context(text, start)))
    return out


_SPAN = "struct<kind:string,start:bigint,end:bigint>"
_MENTION = "struct<start:bigint,end:bigint,seed:boolean,instance:string,contexts:array<string>>"


def _extract(batches):
    row = TaskContext.get().partitionId() << 40
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    seen_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.string()),
                                    ("contexts", pa.list_(pa.string()))]))
    for batch in batches:
        rows, spans, seen = [], [], []
        for text in texts(batch):
            base = base_spans(text)
            rows.append(row)
            row += 1
            spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base])
            seen.append([dict(zip(("start", "end", "seed", "instance", "contexts"), m)) for m in mentions(text, base) if m[4]])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0), pa.array(spans, spans_type),
                                          pa.array(seen, seen_type)], ["row", "doc_id", "spans", "mentions"])


def _sure(some: Column, of: Column) -> Column:
    """Lower end of the Wilson interval (one-sided, 95 %) of a share."""
    z = 1.645
    p = some / of
    return (p + z * z / (2 * of) - z * F.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def context_scores(mentioned: DataFrame, seeds: int = SEEDS, share: float = SHARE, carried: bool = False) -> DataFrame:
    """context, score (posterior that what stands in it is personal data) from
    mentions (context, instance, seed).

    A context scores (sum of trust + 1) / (instances + 3), that is Beta(1, 2) before
    anything is seen; a seed's trust is 1, another instance's the best score of its
    contexts. The scores are the fixed point of that. An instance whose best context
    is the one looked at then cancels out, so k seeds alone give (k + 1) / (k + 3),
    however many unseen instances stand beside them; only instances with a better
    context elsewhere are passed on, in rounds, until no score moves. With ``carried``, a context of
    fewer than ``seeds`` seeds is proved where enough of its instances stand in proved
    contexts too. Contexts below the score of ``seeds`` seeds lend nothing: what they
    lend could not raise another to it.

    Trusted instances must be more than chance: a context lends, and is returned, only
    while, surely, at least ``share`` of its different instances are seeds or lent.
    A context whose seeds (``carried``: and shared instances) are fewer than ``seeds``
    is left out at the start. Edges are distinct pairs, counted before anything is
    joined, so a frequent context or instance is never one task's list.
    """
    edges = cut_lineage(mentioned.groupBy("context", "instance").agg(F.max("seed").alias("seed")))
    held = edges.groupBy("instance").agg(F.count(F.lit(1)).alias("c"), F.max("seed").alias("s"))
    shared = cut_lineage(edges.join(held.where("c > 1 and not s").select("instance"), "instance").select("context", "instance"))
    counted = (edges.groupBy("context").agg(F.count(F.when(F.col("seed"), 1)).alias("k"), F.count(F.lit(1)).alias("n"))
               .join(shared.groupBy("context").agg(F.count(F.lit(1)).alias("m")), "context", "left")
               .where(F.col("k") + (F.coalesce("m", F.lit(0)) if carried else F.lit(0)) >= seeds))
    least = (seeds + 1) / (seeds + 3)
    proved = (F.col("score") >= least) & (_sure(F.col("k") + F.col("lenders"), F.col("n")) >= share)
    scored = cut_lineage(counted.select("context", "k", "n", ((F.col("k") + 1) / (F.col("k") + 3)).alias("score"),
                                        F.lit(0).cast("bigint").alias("lenders")))
    shared = cut_lineage(shared.join(scored.select("context"), "context"))
    moved = not shared.isEmpty()
    while moved:
        lending = scored.where(proved).select("context", F.col("score").alias("trust"))
        best = shared.join(lending, "context").groupBy("instance").agg(F.max("trust").alias("best"))
        lent = (shared.join(best, "instance").join(scored.select("context", "score"), "context").where("best > score")
                .groupBy("context").agg(F.sum("best").alias("lent"), F.count(F.lit(1)).alias("more")))
        more = F.coalesce("more", F.lit(0)).cast("bigint")
        after = (F.col("k") + 1 + F.coalesce("lent", F.lit(0.0))) / (F.col("k") + 3 + more)
        fresh = cut_lineage(scored.join(lent, "context", "left").select(
            "context", "k", "n", F.greatest(after, "score").alias("score"), F.greatest(more, "lenders").alias("lenders"),
            F.greatest(after - F.col("score"), F.lit(0.0)).alias("step"), (more > F.col("lenders")).alias("gained")))
        moved = not fresh.where((F.col("step") > SETTLED) | F.col("gained")).isEmpty()
        scored = fresh.drop("step", "gained")
    return scored.where(proved).select("context", "score")


def scan(docs: DataFrame, sure: float = SURE, **options) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every
    row, by start and kind: base kinds, and "context" for what was discovered.

    A null text has none; repeated rows, null ids and other columns change
    nothing; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = cut_lineage(docs.select("doc_id", "text").mapInArrow(
        _extract, f"row bigint, doc_id {kind}, spans array<{_SPAN}>, mentions array<{_MENTION}>"))
    mentioned = (held.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
                 .withColumn("context", F.explode("contexts")).drop("contexts"))
    good = cut_lineage(context_scores(mentioned, carried=True, **options).where(F.col("score") >= sure).select("context"))
    added = cut_lineage(mentioned.where("not seed").join(good, "context").groupBy("row").agg(F.collect_set(F.struct(
        F.lit(FOUND).alias("kind"), "start", "end")).alias("more")))
    order = {k: n for n, k in enumerate([*KINDS, FOUND])}
    place = lambda x: sum((F.when(x["kind"] == k, F.lit(n)).otherwise(0) for k, n in order.items()), F.lit(0))
    both = F.sort_array(F.transform(F.concat("spans", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))), lambda x: F.struct(
        x["start"].alias("start"), place(x).alias("n"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return held.join(added, "row", "left").select("doc_id", F.transform(both, lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its kind in angle brackets; spans that
    overlap are replaced as one, by the kind of the first."""
    state = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda s, x: F.when(x["end"] <= s["at"], s).when(
            x["start"] < s["at"], F.struct(s["out"].alias("out"), x["end"].alias("at"))).otherwise(F.struct(
                F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("<"),
                         x["kind"], F.lit(">")).alias("out"), x["end"].alias("at"))))
    return F.get(F.transform(F.array(state), lambda s: F.concat(
        s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))), F.lit(0))


def mask(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns, personal data in text replaced by its kind; n_chars,
    where there is such a column, counts the new text. A null text stays null."""
    row = free_name(docs, "_row")
    packed = docs.select(F.struct(*docs.columns).alias(row), "text")
    found = scan(packed.select(F.col(row).alias("doc_id"), "text"), **options)
    new = free_name(docs, "_new")
    found = found.select(F.col("doc_id").alias(row), "spans")
    text = F.col(f"{row}.text")
    changed = found.select(f"{row}.*", F.when(F.size("spans") > 0, masked(text, F.col("spans"))).otherwise(text).alias(new))
    out = [F.col(new).alias("text") if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c)
           if c == "n_chars" else F.col(c) for c in docs.columns]
    return changed.select(*out)
