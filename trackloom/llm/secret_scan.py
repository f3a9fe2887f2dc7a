"""Secret scans: patterns, and a character convolutional network for what they miss.

Candidates are whole runs of 16 or more key characters with a digit. Those that a
pattern finds are labelled findings; the network learns them, with the characters
around, against the other candidates, and its threshold is as high as recall on
held-out findings allows. The other candidates are unlabelled: they tell how many
false alarms to expect, but never raise the threshold. Every distinct candidate of
the corpus is learned or held out: shards of them learn side by side, and after each
epoch the network is the mean of theirs. Every candidate is then scored.
"""

import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import prepare, texts
from trackloom.operators.quantiles import exact_quantiles
from trackloom.session import Scope, cut_lineage

# Fixed values of the query.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

LEARNED = "learned"
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
# Windows that a task learns from between two means.
SHARD = 8_192
EPOCHS = 12
# Findings of either class below which there is nothing to learn.
LEAST = 20
# Tails of at least a fifth of the findings, so that a ratio of tails is not one of a few.
TAILS = np.linspace(0, 0.8, 33)
BEFORE, BODY, AFTER = 24, 48, 12
WIDTH = BEFORE + BODY + AFTER
LETTERS = 100  # printable ASCII, other, outside
EMBED, FILTERS, SPAN = 8, 16, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the patterns find, leftmost and without
    overlap within a kind."""
    found, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if any(c.isdigit() for c in m.group())]


def _windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Character numbers of all windows over a candidate: context, BODY of it, context."""
    out = []
    for low in range(start, max(end - BODY, start) + 1, BODY // 2):
        high = min(low + BODY, end)
        row = np.full(WIDTH, LETTERS - 1)
        for at, part in ((BEFORE - len(text[max(0, low - BEFORE):low]), text[max(0, low - BEFORE):low]),
                         (BEFORE, text[low:high]), (BEFORE + BODY, text[high:high + AFTER])):
            codes = np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.int64)
            row[at:at + len(codes)] = np.where((codes >= 32) & (codes < 127), codes - 32, LETTERS - 2)
        out.append(row)
    return out


@dataclass
class CharCnn:
    """Embedding, one convolution, the greatest response of each filter in the
    candidate and around it, and a logistic unit over both."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    threshold: float = 1.0

    @classmethod
    def fresh(cls, seed: int = 7) -> "CharCnn":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.5, (LETTERS, EMBED)), rng.normal(0, (SPAN * EMBED) ** -0.5, (SPAN * EMBED, FILTERS)),
                   np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), 0.0)

    def _forward(self, rows: np.ndarray):
        seen = self.embed[rows]
        steps = rows.shape[1] - SPAN + 1
        patches = np.concatenate([seen[:, k:k + steps] for k in range(SPAN)], axis=2)
        raw = patches @ self.kernel + self.bias
        inside = np.zeros(steps, bool)
        inside[BEFORE - SPAN // 2:BEFORE + BODY - SPAN // 2] = True
        one = np.where(inside[None, :, None], raw, -np.inf)
        two = np.where(inside[None, :, None], -np.inf, raw)
        at = np.concatenate([one.argmax(1), two.argmax(1)], axis=1)
        top = np.take_along_axis(raw, at.reshape(len(rows), 2, FILTERS), axis=1).reshape(len(rows), -1)
        pooled = np.maximum(top, 0)
        return patches, at, top, pooled, 1 / (1 + np.exp(-np.clip(pooled @ self.weight + self.offset, -30, 30)))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(rows[k:k + 1024])[-1] for k in range(0, len(rows), 1024)]) if len(rows) else np.empty(0)

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.weight, np.array([self.offset])]

    def train(self, rows: np.ndarray, truth: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed=11,
              weights: tuple[float, float] = (1.0, 1.0), moments: tuple | None = None) -> tuple:
        """``weights`` are those of the others and the findings. Returns the moments of
        the gradient (first, second, steps), from which a later call goes on."""
        rng = np.random.default_rng(seed)
        params = self.params()
        first, second, step = moments or ([np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0)
        heavy = np.where(truth == 1, weights[1], weights[0])
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), 64):
                some = order[low:low + 64]
                x = rows[some].copy()
                hide = rng.random(len(some)) < 0.3  # so that the candidate alone is learned too
                x[hide, :BEFORE] = LETTERS - 1
                x[hide, BEFORE + BODY:] = LETTERS - 1
                patches, at, top, pooled, p = self._forward(x)
                error = (p - truth[some]) * heavy[some] / len(some)
                back = error[:, None] * self.weight * (top > 0)
                taken = np.take_along_axis(patches, at[:, :, None], axis=1)
                by_filter = taken.reshape(len(some), 2, FILTERS, -1)
                back2 = back.reshape(len(some), 2, FILTERS)
                to_patch = back2[..., None] * self.kernel.T[None, None]
                grad_embed = np.zeros_like(self.embed)
                places = at.reshape(len(some), 2, FILTERS)
                for k in range(SPAN):
                    letters = x[np.arange(len(some))[:, None, None], places + k]
                    np.add.at(grad_embed, letters.ravel(), to_patch[..., k * EMBED:(k + 1) * EMBED].reshape(-1, EMBED))
                grads = [grad_embed, np.einsum("ngfp,ngf->pf", by_filter, back2), back2.sum((0, 1)), pooled.T @ error,
                         np.array([error.sum()])]
                step += 1
                for n, (value, grad) in enumerate(zip(params, grads)):
                    grad = grad + 1e-4 * value
                    first[n] = 0.9 * first[n] + 0.1 * grad
                    second[n] = 0.999 * second[n] + 0.001 * grad * grad
                    value -= rate * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
                self.offset = float(params[4][0])
        return first, second, step


def calibrated(scores: np.ndarray, truth: np.ndarray, recall: float, false_share: float) -> float:
    """Threshold that keeps ``recall`` of the findings, the highest that does so.

    The others are unlabelled: secrets that no pattern has are among them, so they
    never move the threshold. Where more of them than ``false_share`` seem to be false
    alarms, a warning says so and recall is kept.
    """
    hits, others = np.sort(scores[truth == 1]), scores[truth == 0]
    high = hits[int((1 - recall) * len(hits))]
    wrong = false_alarms(hits, others, high)
    _warn(recall, wrong, false_share)
    return float(high)


def false_alarms(hits: np.ndarray, others: np.ndarray, threshold: float) -> float:
    """Share of the others at or above the threshold, less the most that can be
    secrets which score as the findings do."""
    if not len(others):
        return 0.0
    cuts = np.append(np.quantile(hits, TAILS), threshold)
    return _excess([(others >= c).mean() for c in cuts], [(hits >= c).mean() for c in cuts])


def _excess(others: list[float], hits: list[float]) -> float:
    """By the shares of both at or above each cut, the threshold last."""
    hidden = min(o / h for o, h in zip(others, hits) if h > 0)
    return float(others[-1] - hidden * hits[-1])


def calibrated_rows(scored: DataFrame, recall: float, false_share: float) -> float:
    """``calibrated`` over all rows of a table with finding and score."""
    hits = scored.where("finding")
    n = hits.count()
    rank = int((1 - recall) * n) / max(n - 1, 1)
    found = {r["p"]: r["q"] for r in exact_quantiles(hits, [], "score", [rank, *TAILS.tolist()]).collect()}
    near = found[rank]
    # The rank itself, where rounding took the quantile beside it.
    high = hits.where(F.col("score") <= near + 1e-12).agg(F.max("score")).first()[0]
    cuts = [*(found[p] for p in TAILS.tolist()), high]
    shares = scored.groupBy("finding").agg(*[F.avg((F.col("score") >= c).cast("double")).alias(f"c{k}") for k, c in enumerate(cuts)])
    by_side = {r["finding"]: list(r[1:]) for r in shares.collect()}
    _warn(recall, _excess(by_side[False], by_side[True]) if False in by_side else 0.0, false_share)
    return high


def _warn(recall: float, wrong: float, false_share: float) -> None:
    if wrong > false_share:
        warnings.warn(f"secret scan: to find {recall:.3f} of the secrets, {wrong:.4f} of all other candidates are reported too")


def _findings(batches):
    for batch in batches:
        label, rows = [], []
        for text in texts(batch):
            base = base_spans(text)
            for start, end in candidates(text):
                label.append(any(s < end and start < e for s, _, e in base))
                rows.append(_windows(text, start, end)[0].astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.bool_()), pa.array(rows, pa.binary())], ["finding", "window"])


def _numbers(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH).astype(np.int64)


def _epoch(state: list[np.ndarray], steps: int, epoch: int, weights: tuple[float, float]):
    """One epoch over each shard, all from the same state: the network's parameters
    and both moments. Gives the state after it, in one array."""
    def run(batches):
        for batch in batches:
            out, taken = [], []
            for shard, windows, truth in zip(*(c.to_pylist() for c in batch.columns)):
                held = [x.copy() for x in state]
                k = len(held) // 3
                model = CharCnn(*held[:k - 1], float(held[k - 1][0]))
                *moments, step = model.train(_numbers(windows), np.array(truth, float), 1, seed=[11, epoch, shard], weights=weights,
                                             moments=(held[k:2 * k], held[2 * k:], steps))
                out.append(np.concatenate([x.ravel() for x in [*model.params(), *moments[0], *moments[1]]]))
                taken.append(step)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.float64())), pa.array(taken, pa.int64())], ["shard", "state", "steps"])

    return run


def learned(rows: DataFrame, sizes: dict[bool, int], epochs: int, shard: int = SHARD) -> CharCnn:
    """Network of all ``rows`` (finding, window, h: a digest), of which ``sizes`` tells how
    many are findings and how many others; both count alike. What comes out doesn't depend
    on the layout: shards go by the digest, and their means are added up in order."""
    total = sum(sizes.values())
    weights = total / (2 * sizes[False]), total / (2 * sizes[True])
    number = -(-total // shard)
    dealt = rows.groupBy((F.conv(F.substring("h", 9, 8), 16, 10).cast("long") % number).alias("shard")).agg(
        F.array_sort(F.collect_list(F.struct("h", "window", "finding"))).alias("x"))
    shards = cut_lineage(dealt.select("shard", F.col("x.window").alias("windows"), F.col("x.finding").alias("truth")).repartition(number))
    model, steps = CharCnn.fresh(), 0
    params = model.params()
    state = [*params, *(np.zeros_like(p) for p in [*params, *params])]
    ends = np.cumsum([x.size for x in state])[:-1]
    for epoch in range(epochs):
        parts = shards.mapInArrow(_epoch(state, steps, epoch, weights), "shard long, state array<double>, steps long")
        spread = parts.select("shard", "steps", F.posexplode("state").alias("at", "v")).groupBy("at").agg(
            F.array_sort(F.collect_list(F.struct("shard", "v"))).alias("x"), F.max("steps").alias("steps"))
        mean = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["v"]) / F.size("x")
        found = sorted(spread.select("at", mean.alias("v"), "steps").collect())
        flat = np.array([r["v"] for r in found])
        state = [x.reshape(old.shape) for x, old in zip(np.split(flat, ends), state)]
        steps = found[0]["steps"]
    return CharCnn(*state[:len(params) - 1], float(state[len(params) - 1][0]))


def _scores(rows: DataFrame, model: CharCnn) -> DataFrame:
    """``rows`` with the score of each window."""
    def run(batches):
        for batch in batches:
            windows = batch.column(1).to_pylist()
            found = model.scores(_numbers(windows)) if windows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["finding", "window", "h", "score"])

    return rows.select("finding", "window", "h").mapInArrow(run, "finding boolean, window binary, h string, score double")


def _doubtless(rows: DataFrame, sizes: dict[bool, int], shard: int) -> DataFrame:
    """Rows without the others that a briefly trained network takes for findings: they
    may be secrets, so they are not learned as what isn't one. All rows where they
    would be most of the others."""
    first = learned(rows, sizes, max(2, -(-2000 // sum(sizes.values()))), shard)
    scored = cut_lineage(_scores(rows, first))
    cut = exact_quantiles(scored.where("finding"), [], "score", [0.01]).first()["q"]
    doubt = ~F.col("finding") & (F.col("score") >= cut)
    return scored.where(~doubt) if 2 * scored.where(doubt).count() < sizes[False] else scored


def split_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows (finding, window, h) of all candidates of all documents: those to learn, and
    a quarter to hold out. Equal ones count once."""
    found = docs.select("text").mapInArrow(_findings, "finding boolean, window binary").distinct()
    rows = cut_lineage(found.withColumn("h", F.md5("window")))
    held = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % 4 == 0
    return rows.where(~held), rows.where(held)


def _sizes(rows: DataFrame) -> dict[bool, int]:
    return {False: 0, True: 0} | {r["finding"]: r["count"] for r in rows.groupBy("finding").count().collect()}


def fit(docs: DataFrame, recall: float = 0.95, false_share: float = 0.001, shard: int = SHARD) -> CharCnn | None:
    """Network and threshold from all documents; None if they hold too few findings of
    either class (LEAST) to learn from."""
    with Scope(docs.sparkSession):
        rows, held_out = split_windows(docs)
        sizes, held = _sizes(rows), _sizes(held_out)
        if min(sizes[side] + held[side] for side in sizes) < LEAST or not min(*sizes.values(), *held.values()):
            return None
        kept = cut_lineage(_doubtless(rows, sizes, shard))
        model = learned(kept, _sizes(kept), EPOCHS, shard)
        model.threshold = calibrated_rows(cut_lineage(_scores(held_out, model)), recall, false_share)
        return model


def _scanner(model: CharCnn | None):
    def run(batches):
        for batch in batches:
            spans, rows, owner = [], [], []
            for at, text in enumerate(texts(batch)):
                base = base_spans(text)
                spans.append([(s, k, e) for s, k, e in base])
                if model is not None:
                    for start, end in candidates(text):
                        if not any(s < end and start < e for s, _, e in base):
                            windows = _windows(text, start, end)
                            rows += windows
                            owner += [(at, start, end)] * len(windows)
            if rows:
                for (at, start, end), score in zip(owner, model.scores(np.stack(rows)).tolist()):
                    if score >= model.threshold and (not spans[at] or spans[at][-1] != (start, len(KINDS), end)):
                        spans[at].append((start, len(KINDS), end))
            names = [*KINDS, LEARNED]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"kind": names[k], "start": s, "end": e} for s, k, e in sorted(x)] for x in spans],
                                           pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "spans"])

    return run


def scan(docs: DataFrame, model: CharCnn | None = None, learn: bool = True, **options) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every
    row, by start and kind. A null text has none; repeated rows, null ids and other
    columns change nothing; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    if model is None and learn:
        model = fit(docs, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scanner(model), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
