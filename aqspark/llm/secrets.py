"""Secret scans: fixed patterns, and a lexer that pairs names with literals.

The lexer reads the forms that source code and configuration share: a name
(quoted or not), one of ``= : := =>``, and a value of quoted or bare terms
joined by ``+``; ``<name>value</name>`` is read the same way, and so are pairs
inside a bare value, which ends where the next sensitive pair in it begins. A
term that names an earlier constant of the same text stands for that constant's
literals; ``Bearer`` or ``Basic`` before a value is no part of it. A literal is
reported if its target's name and its own shape score at least ``THRESHOLD``
together, and so are the parts of a concatenation whose joined value does,
wherever they are written; the first ``JOINED`` characters tell the shape of a
joined value.

Values refer to the constants in them instead of copying their parts, claims are
handed down these references once, and no character belongs to two literals that
are scored in place, so the time of a scan grows with the text's length.

Defined results: null text is empty; offsets are code points, ends exclusive;
equal rows give equal rows; whole texts are read in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from aqspark.llm.common import map_batches, packed

KINDS = ("assign", "access", "hex", "named")  # fixed values: the order of kinds at one start
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
# fixed values: weight of a word in a target's name
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.9, "bearer": 0.9, "key": 0.5, "access": 0.4, "private": 0.4,
    "api": 0.4, "signing": 0.4, "encryption": 0.4, "client": 0.2,
}
# fixed values: literals that stand for no secret
PLACEHOLDER = re.compile(r"your[_-]|x{4,}|\*{3,}|\.{3}|\$\{|\$\(|%\(|\{\{|<[a-z_ -]+>", re.I)
# fixed values: words that stand for no secret if a literal is made of nothing else, but for a few digits or marks
PLAIN = re.compile(r"(?:[\W\d_]{0,4}(?:change.?me|example|placeholder|none|null|true|false|undefined))+[\W\d_]{0,4}", re.I)
THRESHOLD = 0.6
JOINED = 256  # characters of a joined value that tell its shape
QUOTES = "\"'`"
MIN_LITERAL = 8

TERM = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`|[^\s"'`,;(){}\[\]<>+|]++)"""
TARGET = re.compile(
    r"""(?P<q>["']?)(?P<name>(?<![\w.$-])[A-Za-z_][\w.-]*+)(?P=q)[\x20\t]*+(?::=|=>|[:=](?![=]))[\x20\t]*+"""
    r"""|<(?P<tag>[A-Za-z_][\w.-]*)>(?P<inner>[^<>\n]+)</(?P=tag)>"""
)
VALUE = re.compile(rf"{TERM}(?:[\x20\t]*\+[\x20\t]*{TERM})*+")
SCHEME = re.compile(r"(?:bearer|basic)[\x20\t]+([A-Za-z0-9._~+/-]+=*)", re.I)
ONE_TERM = re.compile(TERM)
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """Sum of the weights of the words in a name, at most one; the last part of a dotted name counts."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    words += ["apikey"] if "api" in words and "key" in words else []
    return min(1.0, sum(NAME_WEIGHTS.get(w, 0.0) for w in set(words)))


def literal_score(value: str) -> float:
    """Shape of a secret: long enough, without spaces, no placeholder, letters well mixed."""
    if len(value) < MIN_LITERAL or len(value.split()) != 1 or PLACEHOLDER.search(value) or PLAIN.fullmatch(value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, bits / 3.0)


class Leaf:
    """A literal: its span, and the best claims made on it."""

    __slots__ = ("start", "end", "quoted", "weight", "floor")

    def __init__(self, start: int, end: int, quoted: bool) -> None:
        self.start, self.end, self.quoted = start, end, quoted
        self.weight, self.floor = (0.0, ""), (0.0, "")  # of a target's name; of a joined value


class Node:
    """A value: literals and earlier values in turn, each held by reference."""

    __slots__ = ("parts", "weight", "floor", "joined", "pieces")

    def __init__(self, parts: list[Leaf | Node], weight: float = 0.0, name: str = "") -> None:
        self.parts, self.weight, self.floor = parts, (weight, name), (0.0, "")
        self.joined, self.pieces = "", 0


def read_values(text: str) -> list[Node]:
    """All assigned values of ``text``, each after those it refers to."""
    nodes: list[Node] = []
    constants: dict[str, Node] = {}
    longest = 0  # length of the longest constant's name
    terms: list[tuple[int, int]] = []  # of the value last read
    rest: list[Node | None] = []  # the value from each of its terms on
    term = pos = 0
    any_leaf = named_leaf = None  # bare literals that the next pair inside cuts, of plain and of sensitive names

    def made(parts, weight=0.0, name=""):
        nodes.append(Node([x for x in parts if x is not None], weight, name))
        return nodes[-1]

    def literal(start: int, end: int, quoted: bool) -> Leaf:
        scheme = SCHEME.match(text, start)
        return Leaf(*scheme.span(1), quoted) if scheme else Leaf(start, end, quoted)

    while m := TARGET.search(text, pos):
        pos = m.end()
        name = m["tag"] or m["name"]
        weight, leaf = name_score(name), None
        if m["tag"]:
            node = made([literal(*m.span("inner"), True)], weight, name)
        else:
            while term < len(terms) and terms[term][1] <= pos:
                term += 1
            if term < len(terms) and terms[term][0] <= pos and text[terms[term][0]] not in QUOTES:
                # inside a bare value, which both end together unless another pair begins
                for outer in (any_leaf, named_leaf if weight else None):
                    if outer is not None and outer.start <= m.start() < outer.end:
                        outer.end = m.start()
                leaf = literal(pos, terms[term][1], False)
                node = made([leaf, rest[term + 1]], weight, name)
            else:
                value = VALUE.match(text, pos)
                if not value:
                    continue
                terms, term = [t.span() for t in ONE_TERM.finditer(text, *value.span())], 0
                rest = [None] * (len(terms) + 1)
                for k in range(len(terms) - 1, -1, -1):
                    a, b = terms[k]
                    quoted = text[a] in QUOTES
                    known = None if quoted or b - a > longest else constants.get(text[a:b])
                    part = known or literal(a + quoted, b - quoted, quoted)
                    if k == 0 and not quoted and known is None:
                        leaf = part
                    rest[k] = made([part, rest[k + 1]])
                node = made([rest[0]], weight, name)
                # a bare value may hold further pairs, so only quoted terms are passed over
                pos = next((a for a, _ in terms if text[a] not in QUOTES), value.end())
        if weight:
            named_leaf, any_leaf = leaf, None
        elif leaf is not None:
            any_leaf = leaf
        constants[name] = node
        longest = max(longest, len(name))
    return nodes


def lexed(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, target name, score) of literals assigned to sensitive names."""
    nodes = read_values(text)
    for node in nodes:
        alone = len(node.parts) == 1
        for part in node.parts:
            if isinstance(part, Node):
                node.joined += part.joined[: JOINED - len(node.joined)]
                node.pieces += part.pieces
            elif part.quoted or alone:
                node.joined += text[part.start : min(part.end, part.start + JOINED - len(node.joined))]
                node.pieces += part.start < part.end
        node.pieces = min(node.pieces, 2)
        if node.weight[0] and node.pieces > 1:
            node.floor = (node.weight[0] * literal_score(node.joined), node.weight[1])
    leaves: dict[int, Leaf] = {}
    for node in reversed(nodes):  # what is claimed of a value is claimed of all its parts
        for part in node.parts:
            if node.weight[0] and node.weight[0] >= part.weight[0]:
                part.weight = node.weight
            reached = isinstance(part, Node) or part.quoted or len(node.parts) == 1
            if reached and node.floor[0] and node.floor[0] >= part.floor[0]:
                part.floor = node.floor
            if isinstance(part, Leaf) and part.start < part.end:
                leaves[id(part)] = part
    found: dict[tuple[int, int], tuple[float, str]] = {}
    for leaf in leaves.values():
        weight, name = leaf.weight
        own = (weight * literal_score(text[leaf.start : leaf.end]) if weight else 0.0, name)
        best = max(own, leaf.floor, key=lambda x: x[0])
        if best[0] >= THRESHOLD and best[0] > found.get((leaf.start, leaf.end), (0.0, ""))[0]:
            found[leaf.start, leaf.end] = best
    return [(*span, name, score) for span, (score, name) in found.items()]


def scan(text: str) -> list[dict]:
    """Findings by start, then kind: kind, start, end, span of the value, target name, score."""
    low, out = text.lower(), []

    def add(kind, start, end, a, b, name="", score=1.0):
        out.append({"kind": kind, "start": start, "end": end, "value_start": a, "value_end": b, "name": name, "score": score})

    if any(w in low for w in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                add("assign", *m.span(), *m.span(2), m[1])
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            add("access", *m.span(), *m.span())
    for m in HEX.finditer(text):
        add("hex", *m.span(), *m.span())
    if sum(v for w, v in NAME_WEIGHTS.items() if w in low) >= THRESHOLD and any(c in text for c in "=:<"):
        for start, end, name, score in lexed(text):
            add("named", start, end, start, end, name, score)
    return sorted(out, key=lambda f: (f["start"], KINDS.index(f["kind"]), f["end"]))


def redacted(text: str, findings: list[dict], mark: str = "[REDACTED]") -> str:
    """The text with each secret value replaced; overlapping values are replaced once."""
    out, done = [], 0
    for a, b in sorted((f["value_start"], f["value_end"]) for f in findings):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


FINDINGS = "array<struct<kind:string,start:bigint,end:bigint,value_start:bigint,value_end:bigint,name:string,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()),
                             ("value_end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def find_secrets(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ``findings`` of every row."""
    rows = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batch: pa.RecordBatch) -> dict:
        found = [scan(t.as_py() or "") for t in batch.column(1)]
        return {"_id": batch.column(0), "findings": pa.array(found, _ARROW)}

    kind = rows.schema["_id"].dataType.simpleString()
    return map_batches(rows, f"_id {kind}, findings {FINDINGS}", run).withColumnRenamed("_id", id)


def spans(findings: str = "findings", kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the findings of ``kinds``, comma-joined."""
    chosen = F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with secret values in ``text`` replaced; null stays null, all columns and rows stay."""
    rows = packed(df).select("_row", F.col("_row").getField(text).cast("string").alias("_text"))

    def run(batch: pa.RecordBatch) -> dict:
        new = [None if t is None else redacted(t, scan(t)) for t in batch.column(1).to_pylist()]
        return {"_row": batch.column(0), "_new": pa.array(new, pa.string())}

    done = map_batches(rows, StructType([rows.schema["_row"], StructField("_new", StringType())]), run)
    return done.select(*(F.col("_new").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in df.columns))
