"""Toxicity: a lexicon learnt from labels, Levenshtein automata run over its trie, and context windows around each hit.

The lexicon holds the words whose share of toxic documents is beyond chance, and stems of inflected words, found
greedily so that each stem explains documents that earlier ones don't; neither quotation nor report counts for or
against a term. A lazily determinised product of the Levenshtein automata with the trie finds its words and their
misspellings; a misspelling that is an ordinary word of clean documents doesn't count. Entries that clean documents
hold too are counted apart, as doubtful or, if most of their documents are clean, as weak. A window around each hit
tells quotation and report from abuse, and a logistic model over the counts by kind of window gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import bounded_batches, id_and_text, keep, release

#: Labelled rows that the classifier is fitted on at most, chosen by a hash of their ids.
TRAIN_ROWS = 20_000
#: Lengths of stems; toxic documents that an entry needs.
STEMS, LEAST_DOCS = range(4, 9), 4
#: How much more of the likelihood-ratio statistic than a word a stem needs.
STEM_MARGIN = 20.0
#: Words that a Python worker remembers, moves that an automaton remembers, and code points of context on either side of a hit.
MEMORY, MOVES, WINDOW = 400_000, 200_000, 60
#: Terms that a task counts before it passes the counts on.
TERMS = 100_000

WORD = re.compile(r"\w+")
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‹": "›"}
REPORTING = frozenset("said says called calls quoted quote wrote writes word term slur insult phrase sagte nannte schrieb wort zitat dit appelé écrit mot terme citation dijo llamó escribió palabra término cita".split())
DIRECTED = frozenset("you your youre u du dein deine ihr sie tu toi vous votre tú usted eres vos".split())
KINDS = ("bare", "misspelt", "doubtful", "doubtful_misspelt", "weak", "weak_misspelt")
FEATURES = ("bare", "bare_directed", "quoted", *(k + told for k in KINDS[1:] for told in ("", "_quoted")))


def edits(entry: str, stem: bool) -> int:
    """Edits that an entry allows: none for short ones, one from five letters (stems: six), two from eight (stems: one)."""
    return (len(entry) >= 5) + (len(entry) >= 8) if not stem else int(len(entry) >= 6)


class Automaton:
    """All words within the allowed edits of some entry, as a deterministic automaton built where it is used."""

    def __init__(self, lexicon: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.most, self.ends, self.stems = [-1], [-1], [-1]
        for entry, stem in lexicon:
            k, n = edits(entry, stem), 0
            self.most[0] = max(self.most[0], k)
            for c in entry:
                if c not in self.children[n]:
                    self.children[n][c] = len(self.children)
                    self.children.append({})
                    for part in (self.most, self.ends, self.stems):
                        part.append(-1)
                n = self.children[n][c]
                self.most[n] = max(self.most[n], k)
            part = self.stems if stem else self.ends
            part[n] = max(part[n], k)
        self.any = bool(lexicon)
        self._forget()

    def _forget(self) -> None:
        """Starts the automaton anew with its first state alone."""
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.word_edits: list[int | None] = []
        self.stem_edits: list[int | None] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0)}) if self.any else -1

    def _state(self, positions: set[tuple[int, int]]) -> int:
        todo = list(positions)
        while todo:  # letters of an entry that the word lacks
            n, e = todo.pop()
            for child in self.children[n].values():
                if e + 1 <= self.most[child] and (child, e + 1) not in positions:
                    positions.add((child, e + 1))
                    todo.append((child, e + 1))
        least: dict[int, int] = {}
        for n, e in positions:
            least[n] = min(e, least.get(n, e))
        key = frozenset(least.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.word_edits.append(min((e for n, e in key if e <= self.ends[n]), default=None))
            self.stem_edits.append(min((e for n, e in key if e <= self.stems[n]), default=None))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        to = set()
        for n, e in self.states[state]:
            for letter, child in self.children[n].items():
                if (cost := e + (letter != c)) <= self.most[child]:
                    to.add((child, cost))
            if e + 1 <= self.most[n]:
                to.add((n, e + 1))
        self.moves[state, c] = new = self._state(to)
        return new

    def edits(self, word: str) -> int | None:
        """Least edits to an entry, or to a stem at the word's beginning; None if there is none."""
        if len(self.moves) > MOVES:
            self._forget()
        state, best = self.start, None
        for c in word:
            if state < 0:
                return best
            new = self.moves.get((state, c))
            state = self._move(state, c) if new is None else new
            if state >= 0 and (e := self.stem_edits[state]) is not None:
                best = e if best is None else min(best, e)
        if state >= 0 and (e := self.word_edits[state]) is not None:
            best = e if best is None else min(best, e)
        return best


@dataclass
class Model:
    lexicon: list[tuple[str, bool]] = field(default_factory=list)
    doubtful: list[tuple[str, bool]] = field(default_factory=list)
    weak: list[tuple[str, bool]] = field(default_factory=list)
    ordinary: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    bias: float = -10.0
    used: tuple[int, int] = (0, 0)


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a pair of quotation marks on the same line, both within the window, encloses the span."""
    before = text[max(0, start - WINDOW) : start].rpartition("\n")[2]
    after = text[end : end + WINDOW].partition("\n")[0]
    for mark, closing in QUOTES.items():
        at = before.rfind(mark)
        if at >= 0 and any(c in after for c in closing) and not any(c in before[at + 1 :] for c in closing):
            return mark != '"' or before.count('"') % 2 == 1
    return False


def around(text: str, start: int, end: int) -> set[str]:
    """The last six words before the span and the first three after it, within the window."""
    return set(WORD.findall(text[max(0, start - WINDOW) : start])[-6:] + WORD.findall(text[end : end + WINDOW])[:3])


def bare_words(text: str) -> set[str]:
    """The words of a text in small letters that occur in it somewhere neither quoted nor reported."""
    words = set(WORD.findall(text))
    reported = bool(words & REPORTING)
    if not reported and not any(mark in text for mark in QUOTES):
        return words
    bare: set[str] = set()
    for m in WORD.finditer(text):
        if m[0] not in bare and not (reported and around(text, m.start(), m.end()) & REPORTING) and not quoted(text, m.start(), m.end()):
            bare.add(m[0])
    return bare


class Scorer:
    """Counts a text's hits by kind of window."""

    def __init__(self, model: Model):
        release()
        self.model, self.automata = model, [Automaton(entries) for entries in (model.lexicon, model.doubtful, model.weak)]
        self.memory: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """0 for no hit, 1 for an entry itself, 2 for a misspelling of one, 3 and 4 for doubtful entries, 5 and 6 for weak ones."""
        k = self.memory.get(word)
        if k is None:
            found = [a.edits(word) for a in self.automata]
            k = next((2 * i + 1 for i, e in enumerate(found) if e == 0), 0)
            if not k and word not in self.model.ordinary:
                k = next((2 * i + 2 for i, e in enumerate(found) if e is not None), 0)
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            if len(word) <= 40:
                self.memory[word] = k
        return k

    def features(self, text: str) -> list[int]:
        text = text.lower()
        words = set(WORD.findall(text))
        memory = self.memory
        hits = {w: k for w in words if (k := memory[w] if w in memory else self.kind(w))}
        counts = dict.fromkeys(FEATURES, 0)
        for m in WORD.finditer(text) if hits else ():
            if k := hits.get(m[0]):
                near = around(text, m.start(), m.end())
                told = bool(near & REPORTING) or quoted(text, m.start(), m.end())
                counts[KINDS[k - 1] + "_quoted" * told if k > 1 else "quoted" if told else "bare_directed" if near & DIRECTED else "bare"] += 1
        return list(counts.values())


def _terms(text: str) -> set[tuple[str, bool]]:
    words = bare_words(text.lower())
    return {(w, False) for w in words if len(w) >= 4} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}


def _ratio(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """The likelihood-ratio statistic of a term's documents against the share of toxic ones, 0 unless they are more."""
    n, share = toxic + clean, all_toxic / max(1, all_toxic + all_clean)
    if n == 0 or toxic / n <= share:
        return 0.0
    part = lambda k, p: k * np.log(k / n / p) if k else 0.0
    return 2 * (part(toxic, share) + part(clean, 1 - share))


def _term_counts(sample: DataFrame, wanted: set | None) -> dict[tuple[str, bool], int]:
    """Documents by term; combined in each task, then by Spark. ``wanted`` limits the terms."""

    def rows(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], names=["term", "stem", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                n.update(_terms(t) if wanted is None else _terms(t) & wanted)
                if len(n) >= TERMS:
                    yield rows(n)
                    n.clear()
        yield rows(n)

    counts = sample.select("text").mapInArrow(run, "term string, stem boolean, n long").groupBy("term", "stem").agg(F.sum("n").alias("n"))
    return {(r["term"], r["stem"]): r["n"] for r in counts.where(F.col("n") >= (LEAST_DOCS if wanted is None else 1)).toLocalIterator()}


def learn_lexicon(sample: DataFrame) -> tuple[list[tuple[str, bool]], ...]:
    """Clear, doubtful and weak entries from ``sample(doc_id, text, toxic)``, whose size the caller has bounded.

    The statistic that an entry must reach grows with the number of terms tried, so that less than one is expected by chance.
    """
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    all_toxic, all_clean = toxic.count(), clean.count()
    tried = _term_counts(toxic, None)
    need = 2 * np.log(2 * max(1, len(tried)))
    in_clean = _term_counts(clean, set(tried)) if tried else {}

    def rating(term: tuple[str, bool], n: int) -> float:
        """What is left of the statistic beyond the need; negative if the term won't do."""
        c = in_clean.get(term, 0)
        if n < LEAST_DOCS:
            return -1.0
        return _ratio(n, c, all_toxic, all_clean) - need - STEM_MARGIN * term[1]

    good = {t for t, n in tried.items() if rating(t, n) >= 0}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(d, t) for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for t in _terms(text) & good]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([t[0] for _, t in found], pa.string()), pa.array([t[1] for _, t in found], pa.bool_())], names=["doc_id", "term", "stem"])

    where: dict[tuple[str, bool], set[int]] = {}
    for r in toxic.mapInArrow(rows, "doc_id long, term string, stem boolean").toLocalIterator() if good else ():
        where.setdefault((r["term"], r["stem"]), set()).add(r["doc_id"])
    stems, open_terms = [], {t: d for t, d in where.items() if t[1]}
    while open_terms:
        rated = {t: rating(t, len(d)) for t, d in open_terms.items()}
        best = max(rated, key=lambda t: (rated[t], len(t[0]), t[0]))
        if rated[best] < 0:
            break
        stems.append(best)
        done = open_terms.pop(best)
        open_terms = {t: left for t, d in open_terms.items() if rated[t] >= 0 and (left := d - done)}
    whole = sorted(t for t in where if not t[1])
    # A stem that only one word begins with is that word.
    stems = [t for t in stems if sum(w[0].startswith(t[0]) for w in whole) != 1]
    kinds: tuple[list[tuple[str, bool]], ...] = ([], [], [])
    kind = lambda t: 0 if t not in in_clean else 1 if tried[t] >= in_clean[t] else 2
    for t in whole + stems:
        # A word needs no entry of its own beside a stem that is as clear.
        if t[1] or not any(t[0].startswith(stem[0]) and kind(stem) <= kind(t) for stem in stems):
            kinds[kind(t)].append(t)
    return kinds


def _sketch(sample: DataFrame) -> DataFrame:
    """``sample`` with the least values of three hashes over each text's runs of three words: near copies have them all in common for the most part, other texts never."""

    def least(text: str) -> str:
        words = WORD.findall(text.lower())
        runs = {" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 2))}
        return "-".join(str(min(zlib.crc32(r, seed) * 2654435761 % 2**32 for r in runs)) for seed in (1, 2, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([least(t) for t in b.column("text").to_pylist()], pa.string())], names=[*b.schema.names, "sketch"])

    return sample.mapInArrow(run, "doc_id long, text string, toxic int, sketch string")


def _feature_rows(docs: DataFrame, model: Model, extra: str = "") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            rows = [scorer.features(t) for t in b.column("text").to_pylist()]
            others = [b.column(c) for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(rows, pa.list_(pa.int32()))], names=[*(c for c in b.schema.names if c != "text"), "hits"])

    return docs.mapInArrow(run, f"doc_id long, {extra}hits array<int>")


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``train_rows`` labelled documents outside the held-out fold, chosen by a hash of their ids.

    Of several labels of a document the largest counts, of several texts under one id the one with the least
    digest; of near copies with one label the smallest id stays. The rows depend on the tables alone, not on
    the order in which they are read.
    """
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = ids.where(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    sample = id_and_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"), F.first("toxic").alias("toxic"))
    sample = _sketch(sample).groupBy("toxic", "sketch").agg(F.min_by(F.struct("doc_id", "text"), F.col("doc_id")).alias("r"))
    return sample.select("r.doc_id", "r.text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from ``labelled_sample``: two thirds give the lexicon, the other third the weights.

    ``used`` of the model tells the labelled rows of each part. Without toxic labels the lexicon is empty and
    every score is near zero.
    """
    sample = keep(labelled_sample(bounded_batches(docs), labels, train_rows), "labelled")
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))
    first, second = sample.where(part < 2), sample.where(part == 2)
    model = Model(*learn_lexicon(first))
    if not model.lexicon + model.doubtful + model.weak:
        return model
    model.ordinary = frozenset(_misspellings(first.where("toxic = 0").select("text"), model))
    rows = sorted((r["doc_id"], r["toxic"], *r["hits"]) for r in _feature_rows(second.select("doc_id", "toxic", "text"), model, "toxic int, ").toLocalIterator())
    if rows:
        x = np.array(rows, float)
        model.weights, model.bias = _logistic(np.log1p(x[:, 2:]), x[:, 1])
    model.used = (first.count(), len(rows))
    return model


def _misspellings(texts: DataFrame, model: Model) -> list[str]:
    """Words of these texts, of bounded number, that pass for misspellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = {w for t in b.column("text").to_pylist() for w in bare_words(t.lower()) if scorer.kind(w) in (2, 4, 6)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    return [r["word"] for r in texts.mapInArrow(run, "word string").distinct().toLocalIterator()]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[tuple[float, ...], float]:
    """Weights and bias by Newton steps; a kind of hit that never occurs has weight 0."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w[:-1].tolist()), float(w[-1])


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: the remainder of crc32 of the id as text, by 5, is 0 (a null id isn't in it)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, hits`` for every row of ``docs(doc_id, text)``, whole texts.

    Null and empty texts have no hits and the score of a text without any; repeated rows and null ids are
    scored like others; an empty table gives no rows; other columns are not read.
    """
    rows = _feature_rows(id_and_text(docs), model)
    z = F.lit(float(model.bias))
    for i, w in enumerate(model.weights):
        z += F.log1p(F.col("hits")[i]) * float(w)
    rows = rows.withColumn("score", 1 / (1 + F.exp(-z)))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join("hits", ",").alias("hits"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns; where they lie, without a join."""

    @F.pandas_udf("array<int>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield texts.map(lambda t: scorer.features(t or ""))

    z = F.lit(float(model.bias))
    for i, w in enumerate(model.weights):
        z += F.log1p(F.col("__rf_hits")[i]) * float(w)
    return docs.withColumn("__rf_hits", hits("text")).where(z < 0).drop("__rf_hits")

