"""Toxicity by a learned lexicon, misspellings and the context of its terms.

Terms are words and word stems that occur in documents labelled toxic and hardly in others.
They are held in a trie, and the trie is intersected with Levenshtein automata: states are
sets of (trie node, errors), and their transitions are kept once worked out, so a known
state takes one lookup per letter. Words of five letters or more may have one error, of
nine or more two; stems have none.

Every found term is looked at in a window of words around it: inside quotation marks or in
a quoted line it counts as quoted. Sums of term weights, direct and quoted, exact and
misspelled, are the features of a logistic score that is fitted on the same labelled sample.

The sample is bounded: ``SAMPLE`` different labelled texts of each label in hash order, so a
text counts once however often it or its id is repeated; the label of a text is that of most
of its ids. Terms are chosen until no likely one is left that ``LEAST_DOCUMENTS`` documents
need, in portions of ``CANDIDATES``, so a group of near copies cannot crowd out the terms of
others; there are COVER * SAMPLE[0] / LEAST_DOCUMENTS of them at most. Scores look at nothing but the text. A null text is empty; an empty text gets
the score of a text without terms. Rows of ``labels`` without a document or with a null
label are left out; repeated rows are scored alike. Without labels of both kinds every
score is 0.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

#: Labelled documents of each label that the lexicon and the score are learned from.
SAMPLE = (3000, 6000)  # toxic, other
#: Candidates that are looked at in one go.
CANDIDATES = 6000
#: A term is in so many toxic documents at least, and so many times likelier there (natural log).
LEAST_DOCUMENTS = 4
LEAST_ODDS = 2.5
#: Lengths of stems, and the different words that a stem begins at least.
STEMS = (4, 5, 6, 7)
LEAST_WORDS = 4
#: Documents that have so many terms already don't count for another one.
COVER = 3
#: Words around a term that may hold its quotation marks.
WINDOW = 8
THRESHOLD = 0.7
#: Words and states kept per worker.
CACHE_WORDS = 150_000
CACHE_STATES = 20_000

_PARTS = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "\"“„«‘'`>", "\"”“»’'`"
FEATURES = ("direct", "direct_near", "quoted", "quoted_near", "best", "density")


def errors_allowed(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class TermAutomaton:
    """A trie of terms, matched with errors.

    ``terms``: word or stem to weight; stems end in ``*``.
    """

    def __init__(self, terms: dict[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, tuple[float, int]] = {}
        self.stem: dict[int, float] = {}
        for term, weight in terms.items():
            letters = term.removesuffix("*")
            node = 0
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            if term.endswith("*"):
                self.stem[node] = weight
            else:
                self.word[node] = (weight, errors_allowed(term))
        # The most errors that any word below a node may have.
        self.most = [self.word[n][1] if n in self.word else 0 for n in range(len(self.children))]
        for node in range(len(self.children) - 1, -1, -1):
            for child in self.children[node].values():
                self.most[node] = max(self.most[node], self.most[child])
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[float, int] | None] = []
        self.stems: list[float] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of the state that holds ``nodes`` and what missing letters lead to; -1 if it is empty."""
        queue = list(nodes.items())
        while queue:
            node, errors = queue.pop()
            if errors > nodes.get(node, 9):
                continue
            for child in self.children[node].values():
                if errors + 1 <= self.most[child] and errors + 1 < nodes.get(child, 9):
                    nodes[child] = errors + 1
                    queue.append((child, errors + 1))
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        number = self.ids.get(key)
        if number is None:
            number = self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            found = [(e, -self.word[n][0]) for n, e in nodes.items() if n in self.word and e <= self.word[n][1]]
            best = min(found, default=None)
            self.accepts.append((-best[1], best[0]) if best else None)
            self.stems.append(max((self.stem[n] for n, e in nodes.items() if not e and n in self.stem), default=0.0))
        return number

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        for node, errors in self.sets[state].items():
            child = self.children[node].get(letter)
            if child is not None and errors < after.get(child, 9):
                after[child] = errors
            if errors + 1 <= self.most[node] and errors + 1 < after.get(node, 9):
                after[node] = errors + 1  # a letter too many
            for other in self.children[node].values():  # another letter
                if errors + 1 <= self.most[other] and errors + 1 < after.get(other, 9):
                    after[other] = errors + 1
        number = self._state(after)
        self.steps[state][letter] = number
        return number

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and errors of the best term for ``word``: fewest errors, then most weight."""
        if len(self.sets) > CACHE_STATES:
            self._forget()
        state, stem = self.start, 0.0
        for letter in word:
            after = self.steps[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if state < 0:
                break
            stem = max(stem, self.stems[state])
        found = self.accepts[state] if state >= 0 else None
        if stem and (found is None or found[1] or stem > found[0]):
            return stem, 0
        return found


class TextFeatures:
    """Features of texts, with the outcome of every word kept."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.automaton = TermAutomaton(terms)
        self.cache: dict[str, tuple | int] = {}

    def word(self, raw: str):
        """(weight, errors) of the best term among the parts of a word, or 0."""
        found = [m for m in map(self.automaton.match, _PARTS.findall(raw)) if m]
        return max(found, key=lambda m: (-m[1], m[0])) if found else 0

    def __call__(self, text: str) -> list[float]:
        words = text.lower().split()
        hits = list(map(self.cache.get, words))
        if None in hits:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            for i, hit in enumerate(hits):
                if hit is None:
                    hits[i] = self.cache[words[i]] = self.word(words[i])
        out = [0.0] * len(FEATURES)
        total = 0.0
        for i, hit in enumerate(hits):
            if hit:
                weight, errors = hit
                said = quoted(words, i)
                out[2 * said + (errors > 0)] += weight
                out[4] = max(out[4], weight / (1 + errors) / (1 + said))
                total += weight / (1 + errors)
        out[:4] = [float(np.log1p(x)) for x in out[:4]]
        out[5] = 100 * total / (len(words) + 20)
        return out


def quoted(words: list[str], at: int) -> bool:
    """Whether the word at ``at`` stands between quotation marks within the window."""
    before = False
    for i in range(at, max(-1, at - WINDOW - 1), -1):
        if i < at and words[i].rstrip(".,;:!?")[-1:] in _CLOSE:
            return False
        if words[i][0] in _OPEN:
            before = True
            break
    if not before:
        return False
    return any(w.rstrip(".,;:!?")[-1:] in _CLOSE for w in words[at : at + WINDOW + 1])


class Model(NamedTuple):
    terms: dict[str, float]
    weights: list[float]
    intercept: float


def is_held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc, toxic, text) of a bounded number of different labelled texts, in hash order."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    # Ids with several texts have the one of the smallest hash, texts with several ids the first of these in hash order.
    of_ids = texts.groupBy("doc").agg(F.min("same").alias("same"))
    order = F.xxhash64(F.lit("sample"), "doc")
    groups = of_ids.join(known.withColumnRenamed("doc_id", "doc"), "doc").groupBy("same").agg(
        F.min_by("doc", F.struct(order, "doc")).alias("doc"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    groups = written(groups, "toxicity-labels")
    toxic = groups.filter(F.col("toxic") == 1).orderBy(order, "doc").limit(sample[0])
    other = groups.filter(F.col("toxic") == 0).orderBy(order, "doc").limit(sample[1])
    # At most sum(sample) rows of 20 bytes.
    found = texts.join(F.broadcast(toxic.unionByName(other)), ["doc", "same"]).dropDuplicates(["doc"])
    return written(found.select("doc", "toxic", "text"), "toxicity-sample")


def candidate_terms(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All likely terms (term, odds, gain), and the toxic documents (term, doc) that hold them."""
    sizes = sample.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("other")).first()
    words = sample.select(
        "doc", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1)))).alias("word")
    )
    # The last stem is the word itself, marked as such.
    forms = F.array(
        F.col("word"), *[F.when(F.char_length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEMS]
    )
    terms = words.select("doc", "toxic", "word", F.explode(F.array_compact(forms)).alias("term"))
    in_docs = terms.groupBy("term", "doc", "toxic").agg(F.min("word").alias("a"), F.max("word").alias("b"))
    counts = in_docs.groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other"),
        F.approx_count_distinct("a").alias("words"),
    )
    odds = F.log((F.col("toxic") + 0.25) / (sizes["toxic"] + 1)) - F.log((F.col("other") + 0.25) / (sizes["other"] + 1))
    likely = counts.withColumn("odds", odds).filter(
        (F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("odds") >= LEAST_ODDS)
        & (~F.col("term").endswith("*") | (F.col("words") >= LEAST_WORDS))
    )
    likely = written(likely.select("term", "odds", F.col("toxic").alias("gain")), "toxicity-terms")
    return likely, written(in_docs.filter("toxic = 1").join(likely.select("term"), "term").select("term", "doc"), "toxicity-holders")


def lexicon(candidates: list, documents: list, kept: dict[str, float] | None = None, covered: dict | None = None) -> dict[str, float]:
    """Terms that are needed to give every toxic document ``COVER`` of them, in the order of ``candidates``.

    Words that only a group of copies shares follow terms that cover the group already.
    ``kept`` and ``covered`` hold the outcome of earlier candidates and are added to.
    """
    kept, covered = {} if kept is None else kept, {} if covered is None else covered
    holders: dict[str, list] = {}
    for row in documents:
        for term in row["terms"]:
            holders.setdefault(term, []).append(row["doc"])
    for row in candidates:
        term = row["term"]
        if term.endswith("*") and any(term[:n] + "*" in kept for n in STEMS if n < len(term)):
            continue
        own = holders.get(term, [])
        if sum(covered.get(doc, 0) < COVER for doc in own) >= LEAST_DOCUMENTS:
            kept[term] = float(row["odds"])
            for doc in own:
                covered[doc] = covered.get(doc, 0) + 1
    return kept


def chosen_terms(sample: DataFrame, portion: int | None = None) -> dict[str, float]:
    """The lexicon, out of portions of the likely terms that the most documents need."""
    portion = portion or CANDIDATES
    likely, held = candidate_terms(sample)
    kept: dict[str, float] = {}
    covered: dict = {}
    needed = likely
    while True:
        rows = needed.orderBy(F.desc("gain"), F.desc("odds"), "term").limit(portion + 1).collect()
        best = sample.sparkSession.createDataFrame([(r["term"],) for r in rows[:portion]], "term string")
        documents = held.join(F.broadcast(best), "term").groupBy("doc").agg(F.collect_list("term").alias("terms"))
        # At most SAMPLE[0] documents and CANDIDATES terms reach the driver.
        lexicon(rows[:portion], documents.collect(), kept, covered)
        if len(rows) <= portion:
            return kept
        # What was looked at is kept, or begins with a kept stem, or too few documents need it now; so each term comes once.
        begins = [(F.char_length("term") > n) & F.concat(F.substring("term", 1, n), F.lit("*")).isin(list(kept)) for n in STEMS]
        left = likely.filter(~F.col("term").isin(list(kept)))
        for stem in begins:
            left = left.filter(~(F.col("term").endswith("*") & stem))
        full = [doc for doc, n in covered.items() if n >= COVER]
        gains = held.filter(~F.col("doc").isin(full)).groupBy("term").agg(F.count(F.lit(1)).alias("gain"))
        needed = left.drop("gain").join(gains.filter(F.col("gain") >= LEAST_DOCUMENTS), "term")


def features(docs: DataFrame, terms: dict[str, float], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``features`` array<double> of ``text``."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        of = TextFeatures(terms)
        for batch in batches:
            found = [of(t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"]
            )

    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept by Newton's method; the weights are penalised."""
    x1 = np.c_[x, np.ones(len(x))]
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + ridge @ w
        change = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), gradient)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """Lexicon and score from the labels that are not held out."""
    chosen = labelled_sample(docs, labels, sample)
    terms = chosen_terms(chosen)
    rows = features(chosen, terms, ["toxic"]).collect()
    y = np.array([r["toxic"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(terms, [0.0] * len(FEATURES), -30.0)
    weights, intercept = fit(np.array([r["features"] for r in rows], float), y)
    return Model(terms, [float(w) for w in weights], intercept)


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score``, from 0 to 1."""
    sums = F.lit(model.intercept)
    for i, weight in enumerate(model.weights):
        sums = sums + F.col("features")[i] * weight
    return features(docs, model.terms, keep).select(*keep, (1 / (1 + F.exp(-sums))).alias("score"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below ``threshold``, with all their columns."""
    model = learn(docs, labels)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = scored(row, model, ["row"]).filter(F.col("score") < threshold)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
