"""Secret scans: trigram queries derived from the rules' regexes choose the texts on which a regex is run."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.arrow_text import pieces, text_bytes


@dataclass(frozen=True)
class Rule:
    """A regex over str; a match counts if `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base rules. Only ASCII letters have two cases. Whole runs of 32 hex digits or more are what is left
#: of all hex runs without the short ones, and spare a match for each short one.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Public formats of credentials that the base rules don't name.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"://[A-Za-z0-9._~-]{1,64}:[A-Za-z0-9._~!$-]{3,64}@"),
)

#: A query: all of its clauses hold; a clause: one of its alternatives holds; an alternative: all of its trigrams occur.
Query = list[list[frozenset[bytes]]]

#: The standard library's own parse trees: not public, but the same since Python 3.11; a test walks every kind of node.
_parser = re._parser


def trigram_query(pattern: str, most_strings: int = 64) -> Query:
    """Trigrams that every match of a pattern contains, in lower case; [] if there are none.

    Walks the parse tree with the set of strings that the literal run so far can be. A part with too many strings
    ends the run: if all of the run's strings have three characters, they make a clause.
    """

    def trigrams(s: str) -> frozenset[bytes]:
        b = s.encode()
        return frozenset(b[i : i + 3] for i in range(len(b) - 2))

    def walk(items) -> tuple[set[str] | None, Query]:
        run, clauses, exact = {""}, [], True

        def end_run() -> None:
            nonlocal run, exact
            if run and all(len(s) >= 3 for s in run):
                clauses.append([trigrams(s) for s in sorted(run)])
            run, exact = {""}, False

        def append(strings: set[str] | None) -> None:
            nonlocal run
            if strings is None or len(run) * len(strings) > most_strings:
                end_run()
                if strings is not None and len(strings) <= most_strings:
                    run = set(strings)
            else:
                run = {a + b for a, b in product(run, strings)}

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                append({chr(arg).lower()} if arg < 128 else None)
            elif name == "IN":
                append(_few(arg))
            elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
                strings, inner = walk(arg[-1] if name == "SUBPATTERN" else arg)
                append(strings)
                clauses.extend(inner if strings is None else [])
            elif name == "BRANCH":
                parts = [walk(x) for x in arg[1]]
                if all(s is not None for s, _ in parts):
                    append(set().union(*(s for s, _ in parts)))
                else:
                    end_run()
                    if all(c for s, c in parts if s is None) and all(min(map(len, s)) >= 3 for s, _ in parts if s is not None):
                        clauses.append([a for s, c in parts for a in (c[0] if s is None else map(trigrams, sorted(s)))])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, inner = arg
                strings, found = walk(inner)
                if least == 0 and most == 1 and strings is not None:
                    append(strings | {""})
                elif least == 0:
                    end_run()
                else:
                    for _ in range(min(least, 8) if strings is not None else 1):
                        append(strings)
                    clauses.extend(found if strings is None else [])
                    if least != most or least > 8:
                        end_run()
            elif name == "AT":
                continue  # an anchor matches no characters
            else:
                end_run()
        if exact:
            return run, []
        end_run()
        return None, clauses

    def _few(choices) -> set[str] | None:
        found: set[str] = set()
        for op, arg in choices:
            if str(op) == "LITERAL" and arg < 128:
                found.add(chr(arg).lower())
            elif str(op) == "RANGE" and arg[1] < 128 and arg[1] - arg[0] < 4:
                found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return found if len(found) <= 6 else None

    strings, clauses = walk(_parser.parse(pattern))
    if strings is not None and all(len(s) >= 3 for s in strings):
        clauses = [[trigrams(s) for s in sorted(strings)]]
    return clauses


class TrigramIndex:
    """An inverted index of blocks of texts over the trigrams that the rules' queries name."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = [trigram_query(r.pattern) for r in rules]
        names = sorted({t for q in self.queries for clause in q for alternative in clause for t in alternative})
        if len(names) >= 1 << 16:
            raise ValueError("the rules name over 65,535 trigrams")
        self.slots = {t: k + 1 for k, t in enumerate(names)}
        self.slot_of = np.zeros(1 << 24, np.uint16 if len(names) > 255 else np.uint8)
        for t, k in self.slots.items():
            self.slot_of[t[0] << 16 | t[1] << 8 | t[2]] = k
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each rule, which of the block's texts its query leaves; rules without trigrams leave all."""
        n = len(offsets) - 1
        postings = np.zeros((len(self.slots) + 1, n), bool)
        if len(data) > 2:
            a = self.lower[data].astype(np.uint32)
            slots = self.slot_of[a[:-2] << 16 | a[1:-1] << 8 | a[2:]]
            hits = np.flatnonzero(slots)
            text = np.searchsorted(offsets, hits, "right") - 1
            inside = hits + 2 < offsets[text + 1]
            postings[slots[hits[inside]], text[inside]] = True
        out = []
        for query in self.queries:
            left = np.ones(n, bool)
            for clause in query:
                either = np.zeros(n, bool)
                for alternative in clause:
                    either |= np.logical_and.reduce([postings[self.slots[t]] for t in alternative])
                left &= either
            out.append(left)
        return out


def found_spans(text: str, regex: re.Pattern, rule: Rule) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if len(m[rule.group]) >= rule.least]


def secret_spans(docs: DataFrame, more_rules: tuple[Rule, ...] = MORE_RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), redact_to: str | None = None) -> DataFrame:
    """Find secrets in whole texts.

    Each task indexes its texts block by block (a block: a few MB of texts): postings of the trigrams that the rules'
    regexes must contain, in lower case. A rule's Boolean query intersects and unites postings; the regex verifies the
    texts it leaves. Rules without mandatory trigrams ('hex') scan every text. No exchange; a block bounds memory.

    Returns the columns in `keep`, n_assign, n_access, n_hex (long), base_sha256 and spans: kind:start:end (code
    points, end exclusive) of matches, by start, then kind as listed, comma-joined; base_sha256 hashes the base rules'
    spans alone. Null text: empty. No secrets: zero counts, the hash of nothing, empty spans. Matches of one kind
    don't overlap; those of several kinds may. redact_to names one more column: the text with its secrets replaced.
    Empty table: no rows. Columns not in `keep` aren't read.
    """
    rules = (*BASE_RULES, *more_rules)
    narrow = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = {r.kind: k for k, r in enumerate(rules)}

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, regexes = TrigramIndex(rules), [r.compiled() for r in rules]
        for piece in pieces(batches, "_text"):
            column = piece.column(piece.schema.get_field_index("_text"))
            data, offsets = text_bytes(column)
            raw = data.tobytes()
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(piece.num_rows)]
            texts: dict[int, str] = {}
            for k, left in enumerate(index.candidates(data, offsets)):
                for i in np.flatnonzero(left).tolist():
                    if i not in texts:
                        texts[i] = raw[offsets[i] : offsets[i + 1]].decode()
                    spans[i] += [(a, k, b) for a, b in found_spans(texts[i], regexes[k], rules[k])]
            base = len(BASE_RULES)
            counts = [[sum(k == which for _, k, _ in s) for s in spans] for which in range(base)]
            joined = [",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(s)) for s in spans]
            base_joined = [",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(s) if k < base) if s else "" for s in spans]
            clean = [column]
            if any(joined):
                clean = [pa.array([redacted(texts[i], s) if s else raw[offsets[i] : offsets[i + 1]].decode() for i, s in enumerate(joined)], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [piece.column(piece.schema.get_field_index(c)) for c in keep]
                + [pa.array(c, pa.int64()) for c in counts]
                + [pa.array([hashlib.sha256(s.encode()).hexdigest() for s in base_joined]), pa.array(joined, pa.string())]
                + clean * bool(redact_to),
                names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans", *[redact_to] * bool(redact_to)],
            )

    assert len(kinds) == len(rules), "kinds must differ"
    schema = ", ".join([*(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", *[f"`{redact_to}` string"] * bool(redact_to)])
    return narrow.mapInArrow(scan, schema)


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """The text with each span, or union of overlapping spans, replaced by a mark."""
    cuts: list[list[int]] = []
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], b)
        else:
            cuts.append([a, b])
    out, at = [], 0
    for a, b in cuts:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every secret in the text replaced by a mark; columns as before, whatever their names.

    Null texts stay null; empty and very long ones are scanned whole. Repeated rows: each is returned. Empty table: no
    rows.
    """
    # the operator sees columns of its own names only
    others = [c for c in docs.columns if c != text_col]
    own = [f"_kept_{k}" for k in range(len(others))]
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(others, own)], F.col(text_col).alias("_whole"), F.col(text_col).isNull().alias("_no_text"))
    clean = secret_spans(named, text_col="_whole", keep=(*own, "_no_text"), redact_to="_clean")
    back = dict(zip(others, own))
    return clean.select(*[F.when(~F.col("_no_text"), F.col("_clean")).alias(c) if c == text_col else F.col(back[c]).alias(c) for c in docs.columns])
