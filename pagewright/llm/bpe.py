"""Byte-pair encoding with a queue of merge ranks over a linked list of symbols, and decoding by vocabulary strings."""

from __future__ import annotations

import heapq
import json
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, pick

#: What the byte-level vocabulary's own pattern takes as pieces; merges never cross pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces and ids that a worker remembers, and the longest piece among them.
REMEMBERED, LONGEST = 48 << 20, 64

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: printable bytes are themselves, the others are
    numbered from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library, loaded from `path`."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        ids = said["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in said["model"]["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.first = [ids.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        added = {t["content"]: t["id"] for t in said.get("added_tokens") or []}
        self.strings = {i: spell(s) for s, i in ids.items() if s not in added} | {i: s.encode() for s, i in added.items()}
        self.added = added
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    @cached_property
    def table(self) -> list[bytes]:
        return [self.strings.get(i, b"") for i in range(max(self.strings) + 1)]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece. The queue has (rank, left symbol, pair, id); an entry whose symbols have been merged or changed
        since is stale and skipped, so a piece of n bytes takes n log n steps."""
        ids = [i for b in data if (i := self.first[b]) is not None]
        n = len(ids)
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges, queue = self.merges, []
        for k in range(n - 1):
            if found := merges.get((ids[k], ids[k + 1])):
                queue.append((found[0], k, ids[k], ids[k + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, k, left, right, made = heapq.heappop(queue)
            j = after[k]
            if ids[k] != left or j < 0 or ids[j] != right:
                continue
            ids[k], ids[j] = made, -1
            after[k] = m = after[j]
            if m >= 0:
                before[m] = k
                if found := merges.get((made, ids[m])):
                    heapq.heappush(queue, (found[0], k, made, ids[m], found[1]))
            p = before[k]
            if p >= 0 and (found := merges.get((ids[p], made))):
                heapq.heappush(queue, (found[0], p, ids[p], made, found[1]))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> bytes:
        """The piece's ids as little-endian 32-bit integers, remembered if it's short."""
        made = b"".join(i.to_bytes(4, "little") for i in self.merge(piece.encode()))
        if len(piece) <= LONGEST:
            self.held += len(made) + 200
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[piece] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of added tokens are those tokens."""
        known, out = self.known, []

        def plain(part: str) -> None:
            for piece in self.pieces(part):
                out.append(known.get(piece) or self._piece(piece))

        at = 0
        for m in self.special.finditer(text) if self.special else ():
            plain(text[at : m.start()])
            out.append(self.added[m[0]].to_bytes(4, "little"))
            at = m.end()
        plain(text[at:] if at else text)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 are replaced."""
        from array import array

        return b"".join(map(self.table.__getitem__, array("I", ids))).decode(errors="replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Loaded once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine has the public vocabulary; asked on the worker that reads it."""
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def encode_column(docs: DataFrame, id_column: str = "doc_id", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes each whole text and decodes its ids again; columns as in SCHEMA, and with_ids also ids (array of int).

    The vocabulary file must be at `path` on every worker (default: the installed public vocabulary). Null text: as empty,
    no tokens. Repeated rows are encoded each. Other columns are left out. A worker holds the vocabulary, a bounded memory
    of pieces and some MB of texts at a time, or one text.
    """

    def make():
        import hashlib

        voc = vocabulary(path or default_path())
        sha = lambda data: hashlib.sha256(data).hexdigest()

        def each(batch: pa.RecordBatch) -> dict:
            ids = [voc.encode(t or "") for t in batch.column("text").to_pylist()]
            texts = [voc.decode(i) for i in ids]
            out = {"doc_id": batch.column(id_column), "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [sha(i) for i in ids], "decoded_sha256": [sha(t.encode()) for t in texts]}
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]) // 4
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            return out

        return each

    return map_batches(pick(docs, id_column, "text"), make, SCHEMA + (", ids array<int>" if with_ids else ""), "text", most=2 << 20)
