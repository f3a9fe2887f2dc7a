"""Token ids of whole texts by a word-end BPE vocabulary file of `tokenizers`.

The vocabulary's splitting drops white space and never joins what stands on both
sides of it, so a text's ids are those of its blank-separated chunks in a row. A
task encodes each distinct chunk once and joins the stored ids.
"""

import struct

import numpy as np
from tokenizers import Tokenizer

# Distinct chunks that a task remembers; the store is emptied when it is full.
REMEMBERED = 1 << 19
_MARK = "\x01"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class ChunkIds:
    """Bytes of the little-endian unsigned 32-bit ids of chunks."""

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._mark = self._tokenizer.encode(_MARK, add_special_tokens=False).ids
        self._ids: dict[bytes, bytes] = {}
        self._parts: dict[bytes, bytes] = {}

    def _alone(self, chunk: bytes) -> bytes:
        return np.array(self._tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks. Marks that end a chunk after a letter or digit are a
        pre-token of their own, so what stands before them is encoded once for all
        chunks that differ only there."""
        known, cut, wanted = self._parts, [], {}
        for chunk in chunks:
            core = chunk.rstrip(_MARKS)
            if len(core) == len(chunk) or b"<|" in chunk or not core[-1:].isalnum():
                core, tail = chunk, b""
            else:
                tail = chunk[len(core):]
                if tail not in known:
                    wanted[tail] = None
            if core not in known:
                wanted[core] = None
            cut.append((chunk, core, tail))
        self._encode(wanted)
        known[b""] = b""
        self._ids.update([(chunk, known[core] + known[tail] if tail else known[core]) for chunk, core, tail in cut])

    def _encode(self, parts: dict[bytes, None]) -> None:
        """Parts of ASCII letters alone are one pre-token each and go straight to the
        merges. Others are encoded as one text with a mark between them, or alone if
        they hold the mark themselves."""
        known, merged, others = self._parts, self._tokenizer.model.tokenize, []
        for part in parts:
            if part.isalpha():
                ids = [t.id for t in merged(part.lower().decode())]
                known[part] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(part)
        plain = [p for p in others if b"\x01" not in p] if len(self._mark) == 1 else []
        for part in others if not plain else set(others) - set(plain):
            known[part] = self._alone(part)
        for start in range(0, len(plain), 512):
            some = plain[start:start + 512]
            joined = f" {_MARK} ".join([p.decode() for p in some])
            ids = np.array(self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self._mark[0]), len(ids)).tolist()
            raw, at = ids.tobytes(), 0
            for part, end in zip(some, ends, strict=True):
                known[part] = raw[4 * at:4 * end]
                at = end + 1

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, for a bounded list of texts. The vocabulary is of lower
        case, so A-Z is lowered first, but for texts that may hold special strings."""
        split = [text.split() if b"<|" in text else text.lower().split() for text in texts]
        if len(self._ids) > REMEMBERED:
            self._ids.clear()
            self._parts.clear()
        known = self._ids
        fresh = set().union(*split).difference(known)
        if fresh:
            self._learn(list(fresh))
        return [b"".join(map(known.__getitem__, words)) for words in split]
