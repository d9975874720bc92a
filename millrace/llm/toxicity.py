"""Toxicity by a learned lexicon, a Levenshtein automaton over its trie, and context windows.

The lexicon is learned from labelled documents: words, and word beginnings shared by several such words, that occur in
toxic documents much more often than in others. The lexicon's trie is intersected with a Levenshtein automaton and made
deterministic: a state is the set of (trie node, edits so far) that a word's letters can reach, so that one table step
a letter finds exact and misspelled terms alike; most words are dead after a few letters. Each hit's context window
tells whether it stands inside quotation marks. A logistic model over counts of exact, misspelled, quoted and unquoted
hits gives the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, mix, shingles, slices, tune, words

#: Bound on the labelled rows that the lexicon and the model are fitted on (a larger set is thinned by a hash of the id).
MAX_LABELLED = 20_000
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"
#: Cells of one automaton's transition table; a lexicon that needs more is split over several.
CELLS = 1 << 24


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.array([chr(i).isalnum() for i in range(0x110000)])


class TooManyStates(Exception):
    """A lexicon whose automaton would exceed CELLS."""


@dataclass(frozen=True)
class Term:
    """A lexicon entry; stem: it stands for all words that begin with it; strength: how telling it was in training;
    edits: how many misspellings are accepted."""

    text: str
    stem: bool = False
    strength: float = 1.0

    @property
    def edits(self) -> int:
        return 0 if self.stem or len(self.text) < 5 else 1 if len(self.text) < 9 else 2


class Automaton:
    """The lexicon's trie under up to ``edits`` insertions, deletions and substitutions, as one transition table.

    classes: code point -> letter class (0 no letter, 1 a letter of no term, 2.. the terms' letters), of any script.
    table[state, class] -> state, 0 dead, 1 start. verdict[state]: 0 none, 1 exact, 2 misspelled; strength[state]: the
    strongest term's that is accepted. stems: states that accept whatever follows.
    """

    def __init__(self, terms: list[Term], cells: int | None = None) -> None:
        self.terms = terms
        letters = sorted({c for t in terms for c in t.text})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        self._classes: np.ndarray | None = None
        number = {c: i + 2 for i, c in enumerate(letters)}
        child: list[dict[int, int]] = [{}]
        ends: list[list[Term]] = [[]]
        most = [0]
        for t in terms:
            at = 0
            most[0] = max(most[0], t.edits)
            for c in t.text:
                nxt = child[at].get(number[c])
                if nxt is None:
                    nxt = child[at][number[c]] = len(child)
                    child.append({})
                    ends.append([])
                    most.append(0)
                at = nxt
                most[at] = max(most[at], t.edits)
            ends[at].append(t)

        def close(found: dict[int, int]) -> frozenset[tuple[int, int]]:
            todo = list(found)
            while todo:
                at = todo.pop()
                for nxt in child[at].values():
                    e = found[at] + 1
                    if e <= most[nxt] and e < found.get(nxt, 99):
                        found[nxt] = e
                        todo.append(nxt)
            return frozenset(found.items())

        def step(state: frozenset, c: int) -> frozenset:
            found: dict[int, int] = {}
            for at, e in state:
                for x, nxt in child[at].items():
                    cost = e + (x != c)
                    if cost <= most[nxt] and cost < found.get(nxt, 99):
                        found[nxt] = cost
                if e + 1 <= most[at] and e + 1 < found.get(at, 99):
                    found[at] = e + 1
            return close(found)

        width = len(letters) + 2
        number_of = {frozenset(): 0, (start := close({0: 0})): 1}
        states, rows, verdict, stems, strength = [frozenset(), start], [[0] * width], [0], [False], [0.0]
        i = 1
        while i < len(states):
            ok = [(e, t) for at, e in states[i] for t in ends[at] if e <= t.edits]
            held = any(t.stem for _, t in ok)
            least = min((e for e, _ in ok), default=0)
            verdict.append(0 if not ok else 1 if least == 0 else 2)
            strength.append(max((t.strength for e, t in ok if e == least), default=0.0))
            stems.append(held)
            row = [0] * width
            for c in range(1, width):
                if held:
                    row[c] = i
                    continue
                nxt = step(states[i], c)
                if nxt not in number_of:
                    if cells is not None and (len(states) + 1) * width > cells:
                        raise TooManyStates
                    number_of[nxt] = len(states)
                    states.append(nxt)
                row[c] = number_of[nxt]
            rows.append(row)
            i += 1
        self.table = np.array(rows, np.int32)
        self.verdict, self.stems, self.strength = np.array(verdict, np.int8), np.array(stems), np.array(strength)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_classes": None}  # made anew by each worker

    @property
    def classes(self) -> np.ndarray:
        if self._classes is None:
            self._classes = _letters().astype(np.int32)
            self._classes[self.letters] = np.arange(2, len(self.letters) + 2)
        return self._classes

    def find(self, text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of a lower-cased text, and the place, verdict and strength of each hit."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[cp]
        inside = kind > 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        live, at = np.arange(len(start)), start.copy()
        state = np.ones(len(start), np.int32)
        end = np.zeros(len(start), np.int32)
        while len(live):
            state = self.table[state, kind[at]]
            at = at + 1
            done = at == stop[live]
            over = done | self.stems[state]
            end[live[over]] = state[over]
            go = (state > 0) & ~over
            live, at, state = live[go], at[go], state[go]
        hit = np.flatnonzero(self.verdict[end])
        return len(start), start[hit], self.verdict[end[hit]], self.strength[end[hit]]


class Lexicon:
    """All terms, in as many automata as keep each within CELLS. Of several hits of a word the exact, then the strongest counts."""

    def __init__(self, terms: list[Term], cells: int = CELLS) -> None:
        todo, self.parts = [terms], []
        while todo:
            part = todo.pop()
            try:
                self.parts.append(Automaton(part, cells if len(part) > 1 else None))
            except TooManyStates:
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]

    def find(self, text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        found = [a.find(text) for a in self.parts]
        if len(found) == 1:
            return found[0]
        at, verdict, strength = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
        order = np.lexsort((-strength, verdict, at))
        first = order[np.concatenate([[True], np.diff(at[order]) > 0])[: len(order)]]
        return found[0][0], at[first], verdict[first], strength[first]


def quoted(text: str, at: int, window: int = 80) -> bool:
    """Whether the word at a place stands inside quotation marks of its line that open and close within the window."""
    before = text[max(0, at - window) : at].rpartition("\n")[2]
    after = text[at : at + window].partition("\n")[0]
    opened = max((before.rfind(c) for c in OPENING), default=-1)
    if opened < 0 or not any(c in after for c in CLOSING):
        return False
    mark = before[opened]
    if mark == '"':
        return before.count('"') % 2 == 1
    return not any(c in before[opened + 1 :] for c in CLOSING if c != mark)


N_FEATURES = 7


def features(auto: Automaton | Lexicon, texts: list[str | None]) -> np.ndarray:
    """For each text: log counts of exact, misspelled, quoted exact and quoted misspelled hits, the greatest and the summed
    strength of the unquoted exact ones, and their share of the words."""
    out = np.zeros((len(texts), N_FEATURES))
    low = [(t or "").lower() for t in texts]
    joined = "\n".join(low)
    starts = np.cumsum([0] + [len(t) + 1 for t in low])
    _, places, _, _ = auto.find(joined)
    if not len(places):
        return out
    for i in np.unique(np.searchsorted(starts, places, side="right") - 1):
        n, at, kind, power = auto.find(low[i])
        q = np.array([quoted(low[i], int(p)) for p in at], bool)
        exact, near = kind == 1, kind == 2
        counts = [(exact & ~q).sum(), (near & ~q).sum(), (exact & q).sum(), (near & q).sum()]
        best = power[exact & ~q]
        out[i] = [*np.log1p(counts), best.max(initial=0.0), np.log1p(best.sum()), min(20.0, 100.0 * counts[0] / max(n, 20))]
    return out


@dataclass
class Model:
    """What is fitted: the terms and the weights of the features (the constant last)."""

    terms: list[Term]
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _terms_of(text: str) -> set[str]:
    """Distinct words of a text, and their beginnings of 4 to 8 letters marked by a star."""
    out: set[str] = set()
    for w in set("".join(c if c.isalnum() else " " for c in text.lower()).split()):
        out.add(w)
        out.update(w[:k] + "*" for k in range(4, 9) if len(w) > k)
    return out


def least_count(tried: int, n_toxic: int, n_clean: int) -> float:
    """So often a word must be in toxic documents that chance would not do it for any of the words tried."""
    return float(max(3.0, 0.004 * n_toxic, np.log(2 * tried + 1) / np.log((n_toxic + n_clean) / n_toxic)))


def choose(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, tried: int | None = None) -> list[Term]:
    """Lexicon of {word or stem*: (toxic, clean documents)}. A stem accepts no misspellings; telling words that begin with
    it stay beside it with theirs. tried: how many words were looked at, all of counts if not given."""
    tried = sum(w[-1] != "*" for w in counts) if tried is None else tried
    least = least_count(tried, n_toxic, n_clean)

    def telling(t: int, c: int) -> bool:
        return t >= least and t / n_toxic >= 30 * (c + 0.5) / n_clean and t >= 5 * c

    alone = {w for w, (t, c) in counts.items() if w[-1] != "*" and telling(t, c)}
    family: dict[str, int] = Counter(w[:k] for w, (t, c) in counts.items() if w[-1] != "*" and t >= 2 and c == 0 for k in range(4, 9))
    stems: list[str] = []
    for s in sorted((s[:-1] for s, (t, c) in counts.items() if s[-1] == "*" and telling(t, c)), key=len):
        if family[s] >= 3 and not s.startswith(tuple(stems)):
            stems.append(s)
    power = lambda w: float(np.log1p(counts[w][0]) - np.log1p(counts[w][1]))
    return [Term(s, True, power(s + "*")) for s in sorted(stems)] + [Term(w, False, power(w)) for w in sorted(alone)]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the labelled rows (doc_id, label 0 or 1) of docs. Null labels, ids and texts teach nothing.

    At most about max_labelled rows, thinned by a hash of the id. Rows of one label whose texts are copies or near copies (about
    half of their 5-word shingles in common) count once for the lexicon, else one copied text would make all of its words
    terms; every row counts for the weights. Without rows of both
    labels the model is empty and scores everything 0. Other columns of docs and labels may have any name.
    """
    tune(docs.sparkSession)
    lab = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic"))
    share = min(1.0, max_labelled / max(1, lab.count()))
    some = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + (share == 1.0)))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    scratch = Scratch()
    known = scratch.keep(texts.join(F.broadcast(some), "id").select(F.monotonically_increasing_id().alias("row"), "text", "toxic"))
    try:
        return _fit(known, scratch)
    finally:
        scratch.clear()


#: Least shingles that tell how alike two labelled texts are, and orders under which near copies meet.
SKETCH, ORDERS = 64, (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x8CB92BA72F3D8DD7)


def _firsts(known: DataFrame) -> set[int]:
    """One row of each group of near copies of one label. known has max_labelled rows at most, 67 longs of each come here."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lo, hi in slices(b.column(1)):
                h, row, _ = words(b.column(1).slice(lo, hi - lo))
                for s in shingles(h, row, hi - lo, 5):
                    out.append(([int(mix(s ^ np.uint64(o)).min().view(np.int64)) for o in ORDERS], np.sort(mix(s))[:SKETCH].tobytes()) if len(s) else ([], b""))
            m = [pa.array([x[0][k] if x[0] else None for x in out], pa.int64()) for k in range(len(ORDERS))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[1] for x in out], pa.binary()), *m], names=["row", "y", "least", *(f"m{k}" for k in range(len(ORDERS)))])

    kinds = "row long, y int, least binary, " + ", ".join(f"m{k} long" for k in range(len(ORDERS)))
    got = known.mapInArrow(sign, kinds).orderBy("row").toArrow().combine_chunks()
    rows, label, least = got["row"].to_numpy(), got["y"].to_numpy(), got["least"]
    orders = [got[f"m{k}"] for k in range(len(ORDERS))]
    seen: dict[tuple, list[int]] = {}
    firsts: set[int] = set()
    sketch = lambda i: np.frombuffer(least[i].as_py(), np.int64)
    for i in range(len(rows)):
        places = [(int(label[i]), k, v.as_py()) for k, m in enumerate(orders) if (v := m[i]).is_valid]
        own = sketch(i)
        copy = any(2 * len(np.intersect1d(own, other := sketch(j), assume_unique=True)) >= min(len(own), len(other)) for p in places for j in seen.get(p, ()))
        if not copy:
            firsts.add(int(rows[i]))
            for p in places:
                seen.setdefault(p, []).append(i)
    return firsts


def _fit(known: DataFrame, scratch: Scratch) -> Model:
    """The model of (row, text, toxic) rows."""
    once = _firsts(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for b in batches:
            for r, t, y in zip(*(c.to_pylist() for c in b.columns)):
                if r in once:
                    seen[y].update(_terms_of(t))
                    n[y] += 1
        for y in (0, 1):
            rows = [("", n[y]), *seen[y].items()]
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] * y for x in part], pa.int64()), pa.array([x[1] * (1 - y) for x in part], pa.int64())], names=["term", "toxic", "clean"])

    got = known.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    got = scratch.keep(got.where("t >= 2 or term = ''"))
    whole = got.where("term = ''").first()
    tried = got.where("term <> '' and term not like '%*'").count()
    least = least_count(tried, whole.t, whole.c) if whole and whole.t and whole.c else 0
    telling = got.where((F.col("t") >= least) & (F.col("t") >= 5 * F.col("c")))  # all that choose can take
    stems = telling.where("term like '%*'").select(F.expr("left(term, length(term) - 1)").alias("stem"))
    kin = got.where("c = 0 and term not like '%*'").withColumn("stem", F.explode(F.array(*[F.substring("term", 1, k) for k in range(4, 9)])))
    kin = kin.join(stems, "stem", "left_semi").select(*got.columns)
    counts = {r.term: (r.t, r.c) for r in telling.unionAll(kin).distinct().collect()}
    if whole:
        counts[""] = (whole.t, whole.c)
    n_toxic, n_clean = counts.pop("", (0, 0))
    if not n_toxic or not n_clean:
        return Model([], np.zeros(N_FEATURES + 1))
    model = Model(choose(counts, n_toxic, n_clean, tried), np.zeros(N_FEATURES + 1))
    if not model.terms:
        model.weights[-1] = np.log(n_toxic / n_clean)
        return model
    auto = Lexicon(model.terms)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            x = np.concatenate([features(auto, texts[lo:hi]) for lo, hi in slices(b.column(0))]) if texts else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = known.select("text", "toxic").mapInArrow(measure, "x array<double>, y int").toPandas()
    model.weights = logistic(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (constant last) of an L2-regularised logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the column score (0 to 1). Null and empty texts have no hits. A column of that name is replaced."""
    tune(docs.sparkSession)
    if not model.terms:
        p = 0.0 if not model.weights.any() else float(model.probability(np.zeros((1, N_FEATURES)))[0])
        return docs.withColumn(name, F.lit(p))
    auto = Lexicon(model.terms)
    weights = model.weights

    @F.pandas_udf("double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model([], weights)
        for s in parts:
            texts = [t if isinstance(t, str) else "" for t in s]
            size = np.cumsum([0] + [len(t) for t in texts])
            out, lo = [np.zeros(0)], 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + (1 << 20), side="right")) - 1)
                out.append(m.probability(features(auto, texts[lo:hi])))
                lo = hi
            yield pd.Series(np.concatenate(out), dtype="float64")

    return docs.withColumn(name, judge(column(text)))
