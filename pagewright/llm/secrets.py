"""Secret scans: patterns, and the novelty of strings in sensitive context by zstandard with dictionaries."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pick

#: The patterns of the base kinds, in the order in which spans at one place are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

#: A candidate has letters and digits; a sensitive word stands in so many characters before it.
CANDIDATE, LETTER, DIGIT, BEFORE = re.compile(r"[A-Za-z0-9+/_=-]{16,}"), re.compile("[A-Za-z]"), re.compile("[0-9]"), 40
SENSITIVE = re.compile(r"key|token|secret|passw|pwd|passphrase|credential|auth|bearer|private|signature|session|cookie|salt|nonce", re.ASCII | re.IGNORECASE)
PART = re.compile("[+/_=-]+")
#: Characters of surrounding text on each side that prime the compressor, and the marginal bytes a character from which a
#: string is incompressible: random hex digits need 0.5, names made of known words far less.
AROUND, NOVEL = 2048, 0.45
#: Words that identifiers and configuration are made of; with the surroundings they are the dictionary.
IDENTIFIERS = (
    "access account action active address admin api_key application array async auth authorization backend base64 bearer boolean bucket buffer build bytes cache callback certificate "
    "channel class client cluster code column component config connection const container content context cookie count create credentials current database datetime default delete deploy "
    "description development device document domain element email enable endpoint environment error event example export expires field filename filter float format function gateway "
    "generate github global group handler hash header hostname identifier import index instance integer interface internal item json key language length license list local location "
    "logger login manager message method model module name namespace network node null number object offset option output package parameter parse password path payload permission "
    "pipeline platform plugin policy port private process production profile project property protocol provider proxy public query queue read refresh_token region register remote "
    "repository request resource response result return role route schema script secret select server service session settings signature source staging start status storage string "
    "struct success system table target task template test thread timeout timestamp token transaction type undefined update upload url user username uuid value variable version void "
    "webhook width window worker write"
)

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base kinds' matches, sorted; kinds by their place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed bytes of a string behind its surroundings, primed with a dictionary of identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        import zstandard

        words = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=words)

    def marginal(self, around: str, string: str) -> int:
        before = around.encode()
        return len(self.zstd.compress(before + string.encode())) - len(self.zstd.compress(before))

    def spans(self, text: str, taken: list[Span], around: int = AROUND, novel: float = NOVEL) -> list[Span]:
        """Incompressible candidates in sensitive context that don't overlap the spans in taken.

        Other copies of a candidate, or of a part of it that could be one, aren't surroundings: a secret that is repeated
        doesn't hide itself. Copies at the edges of the surroundings are taken away whole.
        """
        found, busy, k = [], sorted((s, e) for s, _, e in taken), 0
        for m in CANDIDATE.finditer(text):
            string, start, end = m[0], m.start(), m.end()
            if not DIGIT.search(string) or not LETTER.search(string) or not SENSITIVE.search(text, max(0, start - BEFORE), start):
                continue
            while k < len(busy) and busy[k][1] <= start:
                k += 1
            j = k
            while j < len(busy) and busy[j][0] < end and busy[j][1] <= start:
                j += 1
            if j < len(busy) and busy[j][0] < end:
                continue
            before, behind = text[max(0, start - around - len(string)) : start], text[end : end + around + len(string)]
            for copy in (string, *(x for x in PART.split(string) if len(x) >= 16 and DIGIT.search(x) and LETTER.search(x))):
                before, behind = before.replace(copy, ""), behind.replace(copy, "")
            if self.marginal(before[max(0, len(before) - around) :] + behind[:around], string) >= novel * len(string):
                found.append((start, 3, end))
        return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[Span], by: str = "[SECRET]") -> str:
    """text with every span, overlapping ones joined, replaced."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", around: int = AROUND, novel: float = NOVEL, with_redacted: bool = False) -> DataFrame:
    """Finds secrets in each whole text; columns as in SCHEMA, with_redacted also redacted, the text without them.

    base_sha256 and spans digest and list kind:start:end (code points, end exclusive) by start, then kind. The method adds
    spans of kind `novel`: strings of 16 and more characters with letters and digits, near a sensitive word, whose marginal
    bytes behind their surroundings and the identifier dictionary are at least `novel` a character.

    Null text: as empty, no spans (redacted stays null). Repeated rows are scanned each. Other columns are left out. A worker
    holds some MB of texts at a time, or one text.
    """

    def make():
        novelty = Novelty()

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "redacted")}
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = novelty.spans(text or "", base, around, novel)
                kinds = [k for _, k, _ in base]
                every = sorted(base + more)
                for c, v in (("n_assign", kinds.count(0)), ("n_access", kinds.count(1)), ("n_hex", kinds.count(2)), ("base_sha256", hashlib.sha256(written(base).encode()).hexdigest()), ("spans", written(every)), ("n_novel", len(more))):
                    out[c].append(v)
                out["redacted"].append(text if not every else redacted(text, every))
            return out | {"doc_id": batch.column(id_column)}

        return each

    return map_batches(pick(docs, id_column, "text"), make, SCHEMA + (", redacted string" if with_redacted else ""), "text", most=2 << 20)


def redact(docs: DataFrame) -> DataFrame:
    """documents with secrets replaced in their texts and n_chars the new length; all other columns stay, whatever their names.

    Null text stays null, an empty one empty; very long ones are scanned whole. Repeated rows are kept each.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text, names = f"c{docs.columns.index('text')}", plain.columns

    def make():
        novelty = Novelty()

        def each(batch: pa.RecordBatch) -> dict:
            texts = []
            for value in batch.column(text).to_pylist():
                base = base_spans(value or "")
                every = sorted(base + novelty.spans(value or "", base))
                texts.append(redacted(value, every) if every else value)
            return {c: batch.column(c) for c in names} | {text: texts}

        return each

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = map_batches(plain, make, fields, text, most=2 << 20)
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(n, F.length(text).cast(dict(plain.dtypes)[n]))
    return out.toDF(*docs.columns)
