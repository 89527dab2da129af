"""Personal data found by patterns and completed by a skip-chain conditional random field.

Base spans come from the patterns of four kinds and their checks. Further nodes are runs
of digits and spelled-out addresses that no base span covers. The nodes of a document form
a chain in text order; nodes with the same or similar content (the same last digits, the
same leading digits, the same local part) anywhere in the document are joined by skip edges,
each to the one before it, so edges grow with the nodes. Loopy message passing gives each
free node a distribution over no kind and the four kinds; base spans are fixed evidence and
always stay. A free node whose kind is likely enough is an added span.

The potentials are log ratios of counts over the whole corpus: shape and neighbouring words
given the kind, kinds of neighbours on the chain, agreement of the two ends of skip edges. A
free node has no label to count, so free nodes are counted in two groups. Those that no skip
edge links to a base span count for no kind. Twins, linked to base spans of one kind, count for
it as often as linked base spans agree, and for no kind otherwise; their shapes and words are
compared among twins and base spans only. Twins of several kinds are not counted. So neither
the number of twins nor that of other numbers in the corpus speaks against a twin. All counts
are per shape, hashed word or pair of kinds, so the table has a fixed size bound.

Defined cases: a null text is empty and has no spans; a null id is kept; repeated rows are
read each by itself. Spans do not overlap within a kind, and added ones overlap no other.
All scans are linear in the length of a text.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

# The patterns of the four kinds, written without backtracking.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])*")
_SPELLED_HOST = re.compile(r" ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+", re.IGNORECASE)
_SPELLED_AT = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)
_WORD_BEFORE = re.compile(r"([^\W\d_]{1,24})[^\w\n]{0,3}$")
_WORD_AFTER = re.compile(r"[^\w\n]{0,3}([^\W\d_]{1,24})")

#: Digits that a free number has at least.
LEAST_DIGITS = 6
CONTEXT_BUCKETS = 512
LIKELY = 0.9
ROUNDS = 12
#: Bound on the size of one learned potential.
MOST_WEIGHT = 4.0
#: Pairs that the learned pairs of kinds are mixed with, and how often the ends of their skip edges agree.
#: Only linked base spans add to the latter, and where these agree they raise it.
SMOOTHING, AGREE = 20.0, 0.98

OTHER = len(KINDS)
#: Starts the names of features as they are counted among twins and base spans.
TWIN = "twin:"


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _addresses(text: str, mark: str, host: re.Pattern) -> list[tuple[int, int]]:
    """Spans of local parts followed by ``host``, which starts with ``mark``."""
    found, low, at = [], 0, text.find(mark)
    while at >= 0:
        match = host.match(text, at)
        start = at
        if match:
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            found.append((start, match.end()))
            low = match.end()
        at = text.find(mark, max(at + 1, low))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind, then start."""
    spans = [Span(0, a, b, True) for a, b in _addresses(text, "@", _HOST)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            spans.append(Span(1, m.start(), m.end(), True))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(Span(2, m.start(), m.end(), True))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                spans.append(Span(3, m.start(), m.end(), True))
    return spans


class Node(NamedTuple):
    start: int
    end: int
    kind: int | None  # None: free
    features: tuple[str, ...]
    keys: tuple[str, ...]


def _bucket(word: str) -> int:
    return crc32(word.lower().encode()) % CONTEXT_BUCKETS


def _node(text: str, start: int, end: int, kind: int | None) -> Node:
    raw = text[start:end]
    digits = "".join(_DIGIT.findall(raw))
    marks = "".join(c for c in "@. -()+" if c in raw) + str(min(raw.count("."), 4))
    before = _WORD_BEFORE.search(text, max(0, start - 32), start)
    after = _WORD_AFTER.match(text, end, end + 32)
    letters = any(c.isalpha() for c in raw)
    features = (
        f"shape:{min(len(digits), 24)}:{marks}:{int(letters)}",
        f"before:{_bucket(before.group(1)) if before else -1}",
        f"after:{_bucket(after.group(1)) if after else -1}",
    )
    if letters:
        local = re.split(r"@| ?[(\[]at", raw, maxsplit=1)[0]
        keys = (f"a:{local.lower()}",)
    else:
        keys = (f"z:{digits[-7:]}", f"h:{digits[:12]}") if len(digits) >= 12 else (f"z:{digits[-7:]}",)
    return Node(start, end, kind, features, keys)


def nodes_of(text: str, base: list[Span]) -> list[Node]:
    """Base spans and free nodes, in text order."""
    nodes = [_node(text, s.start, s.end, s.kind) for s in base]
    taken = sorted((s.start, s.end) for s in base)
    free: list[tuple[int, int]] = []
    spelled = {m.group() for m in _SPELLED_AT.finditer(text)}
    for mark in sorted(spelled | {" " + m for m in spelled}):
        free += _addresses(text, mark, _SPELLED_HOST)
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() >= LEAST_DIGITS and len(_DIGIT.findall(m.group())) >= LEAST_DIGITS:
                free.append(m.span())
    at, last = 0, -1
    for start, end in sorted(free):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= last and (at == len(taken) or taken[at][0] >= end):
            nodes.append(_node(text, start, end, None))
            last = end
    return sorted(nodes, key=lambda n: (n.start, n.end))


def skip_edges(nodes: list[Node]) -> list[tuple[int, int]]:
    """Pairs of nodes with a key in common, each with the one before it."""
    latest: dict[str, int] = {}
    edges = set()
    for i, node in enumerate(nodes):
        for key in node.keys:
            j = latest.get(key)
            if j is not None:
                edges.add((j, i))
            latest[key] = i
    return sorted(edges)


class Potentials(NamedTuple):
    unary: dict[str, np.ndarray]
    prior: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def linked_kinds(nodes: list[Node], edges: list[tuple[int, int]]) -> list[int | None]:
    """Kinds of nodes: their own, else the one kind of base spans that skip edges lead to, OTHER for none, None for several."""
    group = list(range(len(nodes)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, j in edges:
        group[root(j)] = root(i)
    found: dict[int, set[int]] = {}
    for i, node in enumerate(nodes):
        if node.kind is not None:
            found.setdefault(root(i), set()).add(node.kind)
    kinds: list[int | None] = []
    for i, node in enumerate(nodes):
        near = found.get(root(i), {OTHER})
        kinds.append(node.kind if node.kind is not None else next(iter(near)) if len(near) == 1 else None)
    return kinds


def count_nodes(text: str, counts: Counter) -> None:
    """Add the features and pairs of kinds of one text to ``counts``; the last part of a feature's key is 1 for twins."""
    base = base_spans(text)
    nodes = nodes_of(text, base)
    edges = skip_edges(nodes)
    kinds = linked_kinds(nodes, edges)
    for node, kind in zip(nodes, kinds):
        if kind is not None:
            twin = int(node.kind is None and kind != OTHER)
            for feature in ("prior", *node.features):
                counts[feature, kind, twin] += 1
    for a, b in zip(kinds, kinds[1:]):
        if a is not None and b is not None:
            counts["chain", a, b] += 1
    for i, j in edges:
        # Patterns that meet in the same characters are no two mentions.
        if nodes[i].kind is not None and nodes[j].kind is not None and nodes[i].end <= nodes[j].start:
            counts["skip", nodes[i].kind, nodes[j].kind] += 1


def learn(docs: DataFrame) -> Potentials:
    """Potentials out of the counts over all texts."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    count_nodes(text.as_py(), counts)
        if counts:
            names, a, b = zip(*counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["feature", "a", "b", "n"],
            )

    rows = docs.select("text").mapInArrow(run, "feature string, a int, b int, n long")
    return potentials(rows.groupBy("feature", "a", "b").agg(F.sum("n").alias("n")).collect())


def potentials(rows) -> Potentials:
    """Log ratios from rows of (feature, a, b, n), smoothed."""
    size = len(KINDS) + 1
    rows = list(rows)
    same = sum(n for feature, a, b, n in rows if feature == "skip" and a == b)
    every = sum(n for feature, _, _, n in rows if feature == "skip")
    agree = (same + SMOOTHING * AGREE) / (every + SMOOTHING)
    pairs = np.zeros((size, size))
    features: dict[str, np.ndarray] = {"prior": np.zeros(size), f"{TWIN}prior": np.zeros(size)}
    for feature, a, b, n in rows:
        if feature == "chain":
            pairs[a, b] += n
        elif feature != "skip":
            if not b:
                features.setdefault(feature, np.zeros(size))[a] += n
            if b or a != OTHER:
                among_twins = features.setdefault(TWIN + feature, np.zeros(size))
                among_twins[a] += agree * n if b else n
                among_twins[OTHER] += (1 - agree) * n if b else 0
    shares = [n / n.sum() for n in (features.pop("prior") + 1, features.pop(f"{TWIN}prior") + 1)]
    unary = {}
    for feature, n in features.items():
        share = shares[feature.startswith(TWIN)]
        # P(kind | feature) against P(kind), drawn to the prior where counts are few.
        unary[feature] = np.clip(np.log((n + share) / (n.sum() + 1) / share), -MOST_WEIGHT, MOST_WEIGHT)

    def ratio(table: np.ndarray, most: float) -> np.ndarray:
        both = table + table.T
        both = both / both.sum()
        return np.clip(np.log(both / np.outer(both.sum(0), both.sum(1))), -most, most)

    # Without counts, neighbours on the chain are independent. Ends of skip edges agree, or are what they are by chance.
    share = shares[0]
    alone = np.outer(share, share)
    skip = agree * np.diag(share) + (1 - agree) * alone
    return Potentials(unary, np.log(share), ratio(pairs + SMOOTHING * alone, MOST_WEIGHT), ratio(skip, 2 * MOST_WEIGHT))


def beliefs(nodes: list[Node], model: Potentials, rounds: int = ROUNDS) -> np.ndarray:
    """Distributions over the kinds by loopy message passing, one row per node."""
    size = len(model.prior)
    unary = np.tile(model.prior, (len(nodes), 1))
    edges = skip_edges(nodes)
    kinds = linked_kinds(nodes, edges)
    for i, node in enumerate(nodes):
        if node.kind is not None:
            unary[i] = -50.0
            unary[i, node.kind] = 0.0
            continue
        for feature in node.features:
            weight = model.unary.get(feature if kinds[i] == OTHER else TWIN + feature)
            if weight is not None:
                unary[i] += weight if feature.startswith("shape") else 0.5 * weight
    pairs = [(i, i + 1, 0) for i in range(len(nodes) - 1)] + [(i, j, 1) for i, j in edges]
    total = unary.copy()
    if pairs:
        one = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
        two = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
        kind = np.array([p[2] for p in pairs] * 2)
        half = len(pairs)
        back = np.r_[np.arange(half, 2 * half), np.arange(half)]
        # Neighbours on the chain say little about the kind; skip edges say much.
        weights = np.stack([0.25 * model.chain, model.skip])[kind]
        messages = np.zeros((2 * half, size))
        for _ in range(rounds):
            sent = (total[one] - messages[back])[:, :, None] + weights
            top = sent.max(1)
            new = top + np.log(np.exp(sent - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            new = 0.5 * (new + messages)
            change = np.abs(new - messages).max()
            messages = new
            total = unary.copy()
            np.add.at(total, two, messages)
            if change < 1e-3:
                break
    total -= total.max(1, keepdims=True)
    share = np.exp(total)
    return share / share.sum(1, keepdims=True)


def find_spans(text: str, model: Potentials, likely: float = LIKELY) -> list[Span]:
    """Base and added spans by kind, then start."""
    spans = base_spans(text)
    nodes = nodes_of(text, spans)
    if len(nodes) > len(spans):
        share = beliefs(nodes, model)
        for node, row in zip(nodes, share):
            best = int(row.argmax())
            if node.kind is None and best != OTHER and row[best] >= likely:
                spans.append(Span(best, node.start, node.end, False))
    return sorted(spans)


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()),
]))


def personal_data(docs: DataFrame, model: Potentials | None = None) -> DataFrame:
    """doc_id and the spans of its text, by kind and start."""
    model = model or learn(docs)
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            found = [
                [{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "base": s.base} for s in find_spans(t.as_py() or "", model)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", SPANS)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def hide(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by the name of its kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted((s.start, s.end, s.kind) for s in spans):
        if end <= at:
            continue
        out += [text[at : max(at, start)], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Potentials | None = None) -> DataFrame:
    """All rows and columns, with personal data in ``text`` replaced; ``n_chars``, if any, of changed texts counted anew."""
    model = model or learn(docs)
    small_batches(docs.sparkSession)
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t and hide(t, find_spans(t, model)) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                kept = batch.column(chars).to_pylist()
                counted = [len(n) if n != o else k for n, o, k in zip(new, old, kept)]
                columns[chars] = pa.array(counted, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

