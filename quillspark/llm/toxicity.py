"""Toxicity: logistic regression on word presence with a counterfactual penalty.

In each labelled text that names a group, the identity term is swapped for others of its language and
for a neutral noun, and the loss adds the squared change of the text's own log odds over these pairs,
so a mention of a group moves a score no further than a neutral noun does.  A swap replaces every
occurrence of the term in the text; words and stems that the text still has otherwise don't change.
An L1 term keeps only words that carry the label; it is the weaker, the more surely a word's share
differs between the classes.

The fit reads a bounded sample: at most `max_rows` labelled rows, chosen by a hash of doc_id, of whose
texts at most `max_terms` terms are swapped, each `copies` times and once for a neutral noun.  Its
features are all words of the sample that stand in three texts or more and whose share differs between
the classes by `LEAST_SURE` standard errors or more.  Scoring reads every whole text.

Defined results: null or empty text scores as the intercept alone; a null doc_id is never held out, nor
learnt from; of repeated labels the greatest counts, of repeated documents the greatest text; labels
other than 0 and 1 are ignored; with no usable label, or one class only, every score is the
share of label 1 (0 without labels); where no labelled text names a group there is nothing to even
out, and `Model.pairs` is 0; repeated rows score alike; other columns are never read.
"""

from __future__ import annotations

import math
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage_table, with_columns

#: Identity terms by language, and the neutral nouns that stand in for them.
IDENTITY = {
    "en": """asian asians black blacks brown white whites arab arabs african africans latino latinos hispanic hispanics european europeans
american americans mexican mexicans chinese indian indians muslim muslims christian christians jew jews jewish hindu hindus
buddhist buddhists catholic catholics atheist atheists woman women man men girl girls boy boys gay gays lesbian lesbians
bisexual transgender trans queer straight immigrant immigrants refugee refugees disabled deaf blind elderly old young""".split(),
    "de": """asiaten schwarze schwarzen weiße weißen araber afrikaner europäer amerikaner mexikaner chinesen inder muslim muslime
muslimen christ christen jude juden hindus buddhisten katholiken atheisten frau frauen mann männer mädchen junge jungen schwule
lesben bisexuelle transgender migranten einwanderer flüchtling flüchtlinge behinderte gehörlose blinde alte junge""".split(),
    "fr": """asiatiques noir noirs blanc blancs arabe arabes africain africains européens américains mexicains chinois indiens
musulman musulmans chrétien chrétiens juif juifs hindous bouddhistes catholiques athées femme femmes homme hommes fille filles
garçon garçons gay gays lesbiennes bisexuels transgenres immigré immigrés migrants réfugié réfugiés handicapés sourds aveugles vieux jeunes""".split(),
    "es": """asiáticos negro negros blanco blancos árabe árabes africano africanos europeos americanos mexicanos chinos indios
musulmán musulmanes cristiano cristianos judío judíos hindúes budistas católicos ateos mujer mujeres hombre hombres niña niñas
niño niños gay gays lesbianas bisexuales transgénero inmigrante inmigrantes refugiado refugiados discapacitados sordos ciegos viejos jóvenes""".split(),
}
NEUTRAL = {"en": "person people someone somebody".split(), "de": "mensch menschen leute jemand".split(), "fr": "personne personnes gens quelqu'un".split(), "es": "persona personas gente alguien".split()}
_EDGE = string.punctuation + "«»“”„‘’…¿¡–—"
HELD_OUT_MOD = 5
STEMS = (4, 5, 6, 7)
#: Standard errors between the classes' shares from which a word's L1 penalty falls.
SURE = 4.0
#: Standard errors from which a word is a feature at all.
LEAST_SURE = 4.0
_TOKEN = re.compile(r"\S+")


def words_of(text: str) -> set[str]:
    """The distinct words of a text, lower case, without punctuation at either end; and the first four to
    seven characters of longer ones, as `word*`, for stems that take many endings."""
    words = {w.strip(_EDGE) for w in set(text.lower().split())} - {""}
    out = set(words)
    for k in STEMS:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


def swap_term(text: str, term: str, other: str) -> str:
    """The text with every occurrence of a term, whatever its case and the punctuation around it, swapped."""

    def one(m):
        token = m[0]
        word = token.strip(_EDGE)
        return token.replace(word, other) if word.lower() == term else token

    return _TOKEN.sub(one, text)


def counterfactuals(text: str, terms: dict[str, list[str]], neutral: dict[str, list[str]], copies: int, max_terms: int) -> list[str]:
    """Copies of a text with one identity term swapped.  Which terms and which others is told by a hash of both."""
    said = {t.strip(_EDGE).lower() for t in text.split()}
    out = []
    order = lambda term, xs: sorted(xs, key=lambda x: (zlib.crc32(f"{len(text)} {term} {x}".encode()), x))
    for lang, names in terms.items():
        for term in order("", said & set(names))[:max_terms]:
            others = order(term, set(names) - {term})[:copies] + order(term, neutral.get(lang, []))[:1]
            out += [swap_term(text, term, other) for other in others]
    return out


def remainder(doc_id: str, mod: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def _texts(rows: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in rows.column(rows.schema.get_field_index(column)).to_pylist()]


class Model:
    """weight by word, an intercept, and how many counterfactual pairs the fit saw."""

    def __init__(self, weights: dict[str, float], intercept: float, pairs: int = 0):
        self.weights, self.intercept, self.known, self.pairs = weights, intercept, frozenset(weights), pairs

    def score(self, text: str) -> float:
        z = self.intercept + sum(self.weights[w] for w in sorted(words_of(text) & self.known))
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


class Rows:
    """A sparse matrix by (row, column, value)."""

    def __init__(self, at: list[list[int]], values: list[list[float]] | None, columns: int):
        self.shape = len(at), columns
        self.row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        self.column = np.array([k for a in at for k in a], np.int64)
        self.value = np.array([v for r in values for v in r], float) if values is not None else np.ones(len(self.column))

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * v[self.column], minlength=self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * r[self.row], minlength=self.shape[1])


def objective(x: Rows, y: np.ndarray, d: Rows, l1: np.ndarray, swap: float, w: np.ndarray, intercept: float) -> float:
    """Mean log loss + l1 |w| + swap * mean over the texts of the squared changes of their log odds."""
    z = x.times(w) + intercept
    return float((np.logaddexp(0, z) - y * z).mean() + (l1 * np.abs(w)).sum() + swap * (d.times(w) ** 2).sum() / len(y))


def penalties(x: Rows, y: np.ndarray, l1: float) -> np.ndarray:
    """Each word's L1 penalty."""
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    p1, p0, p = x.back(y) / n1, x.back(1 - y) / n0, (x.back(np.ones(len(y))) + 1) / (len(y) + 2)
    sure = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return l1 * np.minimum(1, (SURE / np.maximum(sure, 1e-9)) ** 2)


def solve(x: Rows, y: np.ndarray, d: Rows, l1: np.ndarray, swap: float, steps: int) -> tuple[np.ndarray, float]:
    """Minimises the objective by accelerated proximal gradient steps.  d: for each swapped copy, its features
    less the text's own.  Classes aren't evened out, as a score is the share of label 1."""
    n = len(y)
    dense = np.zeros(x.shape, np.float32)
    dense[x.row, x.column] = x.value
    dense = np.concatenate([dense, np.ones((n, 1), np.float32)], 1)  # the intercept, without a penalty
    l1 = np.append(l1, 0.0)

    def pull(v):
        return np.append(2 * swap / n * d.back(d.times(v[:-1])), 0.0) if d.shape[0] else 0.0

    v = np.ones(len(l1))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = v / np.linalg.norm(v)
        v = dense.T @ (dense @ v.astype(np.float32)) / (4 * n) + pull(v)
    step = 1 / (1.05 * float(np.linalg.norm(v)))
    w = np.zeros(len(l1))
    v, t = w, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(dense @ v.astype(np.float32), -30, 30))) - y) / n
        new = v - step * (dense.T @ r.astype(np.float32) + pull(v))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        if (v - new) @ (new - w) > 0:  # the momentum points uphill
            u = 1.0
        v = new + (t - 1) / u * (new - w)
        w, t = new, u
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 8000, l1: float = 4e-4, swap: float = 1.0, steps: int = 600, terms: dict[str, list[str]] = IDENTITY, neutral: dict[str, list[str]] = NEUTRAL, copies: int = 4, max_terms: int = 8) -> Model:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0.  `terms` and `neutral` hold identity
    terms and neutral nouns by language, in lower case."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (remainder("doc_id", HELD_OUT_MOD) != 0))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    seen = stage_table(chosen.groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("y", "text"), "toxicity_sample")
    count = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.0
        return Model({}, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))

    def tally(batches):
        """(word, rows of label 1, rows of label 0), added up in the task as far as memory goes."""
        at: dict[str, list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(at), pa.string()), pa.array([v[1] for v in at.values()], pa.int64()), pa.array([v[0] for v in at.values()], pa.int64())], ["word", "a", "b"])
            at.clear()
            return out

        for rows, _, _ in slices(batches, "text"):
            for y, t in zip(rows.column(0).to_pylist(), _texts(rows, "text")):
                for w in words_of(t):
                    at.setdefault(w, [0, 0])[y] += 1
                if len(at) > 200_000:
                    yield flush()
        if at:
            yield flush()

    by_word = seen.mapInArrow(tally, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    sure = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    named = [x for lists in (terms, neutral) for names in lists.values() for x in names]
    words = sorted({r["word"] for r in by_word.where((F.col("a") + F.col("b") >= 3) & (sure >= LEAST_SURE)).select("word").collect()} | set(named))
    index = {w: k for k, w in enumerate(words)}

    def features(batches):
        for rows, _, _ in slices(batches, "text"):
            found, swapped = [], []
            for t in _texts(rows, "text"):
                mine = {index[w] for w in words_of(t) if w in index}
                found.append(sorted(mine))
                copied = ({index[w] for w in words_of(c) if w in index} for c in counterfactuals(t, terms, neutral, copies, max_terms))
                swapped.append([[*sorted(c - mine), -1, *sorted(mine - c)] for c in copied])  # what a swap adds, and what it takes
            yield with_columns(rows, ["y"], f=pa.array(found, pa.list_(pa.int32())), swapped=pa.array(swapped, pa.list_(pa.list_(pa.int32()))))

    data = seen.mapInArrow(features, "y int, f array<int>, swapped array<array<int>>").collect()
    data = sorted((r["y"], list(r["f"]), [list(s) for s in r["swapped"]]) for r in data)  # the order of rows must not sway the fit
    x, y = Rows([f for _, f, _ in data], None, len(words)), np.array([y for y, _, _ in data], float)
    pairs = [s for _, _, swaps in data for s in swaps]
    d = Rows([[k for k in s if k >= 0] for s in pairs], [[1.0] * s.index(-1) + [-1.0] * (len(s) - 1 - s.index(-1)) for s in pairs], len(words))
    w, intercept = solve(x, y, d, penalties(x, y, l1), swap, steps)
    return Model({words[k]: float(w[k]) for k in np.flatnonzero(np.abs(w) > 1e-9)}, intercept, len(pairs))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: one row for each row of docs."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for rows, _, _ in slices(batches, "text"):
            yield with_columns(rows, ["doc_id"], score=pa.array([model.score(t) for t in _texts(rows, "text")], pa.float64()))

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.withColumnRenamed("doc_id", doc_id)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""

    def run(batches):
        for rows, _, _ in slices(batches, text):
            yield rows.filter(pa.array([model.score(t) < threshold for t in _texts(rows, text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
