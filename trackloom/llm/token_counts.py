"""Token counts by a word-end BPE vocabulary, most of them without any merging.

Offline proof: a vocabulary string that the merges, run on its own characters,
bring to one token, counts one wherever it is a whole pre-token, since merging
looks at nothing outside a pre-token. Pre-tokens among these strings are counted
directly; only the rest is merged.
"""

import json
import sys

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from trackloom.llm.common import prepare, text_bytes

# Distinct chunks that a task remembers; the store is emptied when it is full.
REMEMBERED = 1 << 20
LIMIT = 2048


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordEndBpe:
    """The parts of a vocabulary file: special strings, normalising, splitting, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.special = [t["content"] for t in whole["added_tokens"]]
        self.normal = normalizers.Normalizer.from_str(json.dumps(whole["normalizer"])) if hasattr(
            normalizers.Normalizer, "from_str") else _normalizer(whole["normalizer"])
        split = next(p for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.end = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.vocabulary = model["vocab"]

    def pieces(self, letters: str) -> int:
        """How many tokens a pre-token, given in byte letters, is merged to."""
        parts = [*letters]
        if not parts:
            return 0
        parts[-1] += self.end
        ranks, none = self.ranks, sys.maxsize
        scores = [ranks.get(p, none) for p in zip(parts, parts[1:])]
        while scores:
            best = min(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = ranks.get((parts[at - 1], parts[at]), none)
            if at < len(scores):
                scores[at] = ranks.get((parts[at], parts[at + 1]), none)
        return len(parts)

    def singles(self) -> set[str]:
        """Vocabulary strings, without the word end, proven to encode as one token."""
        ends = [w.removesuffix(self.end) for w in self.vocabulary if w.endswith(self.end)]
        return {w for w in ends if w and self.pieces(w) == 1}


def _normalizer(spec: dict):
    """The normalizer that a vocabulary file describes, for the kinds in use."""
    kind = spec["type"]
    if kind == "Sequence":
        return normalizers.Sequence([_normalizer(s) for s in spec["normalizers"]])
    if kind == "Replace":
        from tokenizers import Regex

        pattern = spec["pattern"]
        return normalizers.Replace(Regex(pattern["Regex"]) if "Regex" in pattern else pattern["String"], spec["content"])
    return {"NFC": normalizers.NFC, "NFD": normalizers.NFD, "NFKC": normalizers.NFKC, "Lowercase": normalizers.Lowercase}[kind]()


class ChunkCounts(dict):
    """Tokens of a blank-separated chunk of text; filled as chunks are met."""

    def __init__(self, bpe: WordEndBpe):
        super().__init__()
        self._bpe, self._singles = bpe, bpe.singles()
        self._table = {b: letter for b, letter in enumerate(bpe.letters)}

    def _plain(self, part: str) -> int:
        total = 0
        for word in self._bpe.words.findall(self._bpe.normal.normalize_str(part)):
            letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._table)
            total += 1 if letters in self._singles else self._bpe.pieces(letters)
        return total

    def __missing__(self, chunk: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        part, total = chunk.decode(), 0
        if self._bpe.specials and "<" in part:
            pieces = self._bpe.specials.split(part)
            total = len(pieces) - 1 + sum(self._plain(p) for p in pieces if p)
        else:
            total = self._plain(part)
        self[chunk] = total
        return total


def _counter(path: str):
    def run(batches):
        counts = ChunkCounts(WordEndBpe(path))
        for batch in batches:
            found = text_bytes(batch)
            totals = [sum(map(counts.__getitem__, text.split())) for text in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in found], pa.int64()),
                                              pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, in one pass.

    ``path`` is a place of the vocabulary file that every executor has. A null
    text is empty and has no tokens; repeated rows, null ids and other columns
    change nothing; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(_counter(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
