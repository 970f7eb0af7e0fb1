"""Secret scans: trigram queries derived from each rule pick candidate texts, the rule's regex verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, fresh, in_batches, joined, text_batches, texts_of

#: A literal part of a rule is spelled out in so many strings at most; past that it is cut there.
MOST_STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches are leftmost and don't overlap; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The words of an assignment, in either case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
BASE_RULES = (
    Rule("assign", "(" + "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", w) for w in ASSIGN_WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str) -> tuple:
    """What every match of the pattern holds, over lower-cased text: ("tri", text), ("and" | "or", parts), or ("all",) if nothing is mandatory."""

    def strings(node) -> set[str] | None:
        """All strings of a node, if they are few."""
        op, arg = node
        if op is C.LITERAL:
            return {_lower(chr(arg))}
        if op is C.IN:
            out: set[str] = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    out.add(_lower(chr(x)))
                elif kind is C.RANGE and x[1] - x[0] < MOST_STRINGS:
                    out |= {_lower(chr(k)) for k in range(x[0], x[1] + 1)}
                else:
                    return None
            return out if len(out) <= MOST_STRINGS else None
        if op is C.SUBPATTERN:
            return run(arg[3])
        if op is C.BRANCH:
            parts = [run(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is C.MAX_REPEAT and (arg[0], arg[1]) == (0, 1):
            got = run(arg[2])
            return None if got is None else got | {""}
        if op is C.MAX_REPEAT and arg[0] == arg[1]:
            return run(list(arg[2]) * arg[0])
        return None

    def run(nodes) -> set[str] | None:
        held = {""}
        for node in nodes:
            got = strings(node)
            if got is None or len(held) * len(got) > MOST_STRINGS:
                return None
            held = {a + b for a in held for b in got}
        return held

    def of(held: set[str]) -> tuple:
        return _any([_all([("tri", s[k : k + 3]) for k in range(len(s) - 2)]) for s in sorted(held)])

    def walk(nodes) -> tuple:
        parts, held = [], {""}
        for node in nodes:
            got = strings(node)
            if got is not None and len(held) * len(got) <= MOST_STRINGS:
                held = {a + b for a in held for b in got}
                continue
            parts.append(of(held))
            held = got if got is not None else {""}
            if got is None:
                op, arg = node
                if op is C.SUBPATTERN:
                    parts.append(walk(arg[3]))
                elif op is C.BRANCH:
                    parts.append(_any([walk(x) for x in arg[1]]))
                elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                    parts.append(walk(arg[2]))
        return _all([*parts, of(held)])

    return walk(_parser.parse(pattern))


def _lower(c: str) -> str:
    return c.lower() if c.isascii() else c


def _all(parts: list[tuple]) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ("all",)]
    return ("all",) if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ("all",) if not parts or ("all",) in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _trigrams(query: tuple) -> set[bytes]:
    return {query[1].encode()[:3]} if query[0] == "tri" else set().union(*map(_trigrams, query[1])) if len(query) > 1 else set()


class Scanner:
    """Rules compiled, with their trigram queries; an index of a batch holds the postings of those trigrams."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.A), trigram_query(r.pattern)) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for _, _, q in self.rules:
            for t in _trigrams(q):
                self.wanted[int.from_bytes(t, "big")] = True
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def postings(self, texts: list[str]) -> dict[bytes, np.ndarray]:
        """The texts that hold each wanted trigram."""
        data, starts, _ = joined([t.encode() for t in texts], b"\0")
        code = self.fold[data]
        code = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:]
        at = np.flatnonzero(self.wanted[code])
        pairs = np.unique(code[at].astype(np.int64) << 32 | (np.searchsorted(starts, at, side="right") - 1))
        codes, first = np.unique(pairs >> 32, return_index=True)
        return {int(c).to_bytes(3, "big"): x & 0xFFFFFFFF for c, x in zip(codes, np.split(pairs, first[1:]), strict=True)} if len(pairs) else {}

    def candidates(self, query: tuple, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query[0] == "all":
            return np.arange(n)
        if query[0] == "tri":
            return postings.get(query[1].encode()[:3], np.zeros(0, np.int64))
        parts = [self.candidates(q, postings, n) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule's place, end), sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings(texts)
        for place, (rule, regex, query) in enumerate(self.rules):
            for k in self.candidates(query, postings, len(texts)).tolist():
                for m in regex.finditer(texts[k]):
                    if len(m[rule.group]) >= rule.least:
                        found[k].append((m.start(), place, m.end()))
        for spans in found:
            spans.sort()
        return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text: the id and spans, an array of (kind, start, end, value) by start, then rule.

    Each task indexes its batches by the trigrams that the rules need, intersects their postings and runs a rule's
    regex on the texts that pass; a rule without mandatory trigrams (such as hex) reads all texts. A map: no shuffle.

    start and end count code points, end exclusive. A null text counts as empty and has no spans, as do texts without
    secrets; a null id stays null; repeated rows each have a row; an empty table gives no rows; other columns are ignored;
    a very long text is scanned whole, in a batch of its own.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in text_batches(batches, "text"):
            texts = texts_of(batch, "text")
            spans = [[{"kind": rules[k].kind, "start": a, "end": b, "value": t[a:b]} for a, k, b in s] for t, s in zip(texts, scanner.scan(texts), strict=True)]
            yield emit(schema, doc_id=batch.column(0), spans=spans)

    return in_batches(src, run, "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with every secret in the text replaced by its kind in brackets; overlapping spans become one, named by the first.

    All rows and columns stay, null ids and repeated rows too; null and clean texts stay as they are; an empty table gives
    no rows; a very long text is scanned whole, in a batch of its own. length_col, if given, is set to the new length of a
    text that changed.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in text_batches(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts, out = batch.column(at).to_pylist(), []
            for t, spans in zip(texts, scanner.scan([t or "" for t in texts]), strict=True):
                parts, end, open_ = [], 0, 0
                for a, k, b in spans:
                    if a >= end:
                        parts += [t[open_:a], f"[{rules[k].kind}]"]
                    end = open_ = max(end, b)
                out.append(t if not spans else "".join([*parts, t[open_:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    if not length_col:
        return in_batches(docs, run, schema)
    before = fresh(docs, "veriloom_len")
    old = docs.withColumn(before, F.length(text_col))

    def with_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            at = batch.schema.get_field_index(length_col)
            new = pa.compute.utf8_length(batch.column(batch.schema.get_field_index(text_col)))
            same = pa.compute.coalesce(pa.compute.equal(new, batch.column(batch.schema.get_field_index(before))), pa.scalar(True))
            length = pa.compute.if_else(same, batch.column(at), new.cast(batch.schema.field(at).type))
            yield batch.set_column(at, batch.schema.field(at), length)

    return in_batches(old, with_length, old.schema).select(*docs.columns)


def secret_digest(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Per document the base kinds' counts, a sha256 of their spans, and all spans as text (kind:start:end, comma-joined)."""
    kinds = [r.kind for r in base]
    said = lambda x: F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    own = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.array_join(said(own), ","), 256).alias("base_sha256"),
        F.array_join(said(F.col("spans")), ",").alias("spans"),
    )
