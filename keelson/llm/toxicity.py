"""Toxicity by weak supervision.

Voters are terms and patterns. A term is a whole word, or a stem with a number: it fires where that
many words that begin with the stem stand within WINDOW words of each other, however long the text
around them is. Terms come from a fixed lexicon and from labelled texts that may be learned from; so
does the number of each stem. A generative label model estimates by expectation-maximisation how
often each voter fires on either class and which voters go together within the classes; votes that
repeat each other share one vote's weight. Labels only start the estimate. A linear classifier is
trained on its posterior labels and scores every whole text from its voters' hits. Its scale is then
set on the labelled texts: CUT lies where it tells their labels apart best.

The model is fitted on about PER_CLASS labelled texts of each class, chosen by a hash of doc_id, and
SAMPLE_BYTES of them at most; all texts are scored. Inputs of a score are the text alone. Defined
results: null and empty texts hit nothing and get the score of such; documents with contradicting
labels are not learned from; without labels every score is 0; repeated rows get the same score;
columns of other names pass through, a column named like the score keeps its name.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices
from .langid import bounded_sample, bounded_texts, held_out

PER_CLASS, SAMPLE_BYTES = 2500, 128 << 20
#: Terms mined at most; lengths of stems; words that a stem's hits stand within; the most hits that are asked for.
VOTERS, STEMS, WINDOW, HITS = 160, (3, 4, 5, 6, 7, 8), 100, 5
#: Scores from here on count as toxic; the classifier is scaled to it. A clean text that is flagged costs FALSE missed ones.
CUT, FALSE = 0.7, 4
#: English insults that vote even where no label shows them.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "bastard", "asshole", "bitch", "dumbass", "imbecile", "cretin", "retard", "whore", "slut", "vermin")
#: Patterns over the text as it stands.
PATTERNS = (r"(?i)\byou(?:'re| are) (?:an? )?(?:\w+ )?(?:idiot|moron|loser|clown|scum|trash)", r"(?i)\b(?:shut up|go to hell|drop dead|kill yourself|hate you)\b", r"!{3,}", r"\b[A-Z]{5,}(?: [A-Z]{4,}){2,}")
WORDS = re.compile(r"[^\W\d_]+")


def prefixes(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) > n]


def densest(at: list[int]) -> int:
    """The most of the ascending places ``at`` that stand within WINDOW words, counted up to HITS."""
    return next((k for k in range(HITS, 1, -1) if any(b - a < WINDOW for a, b in zip(at, at[k - 1 :]))), 1)


def stem_hits(words: list[str], stems) -> dict[str, int]:
    """For each of ``stems`` that words begin with: how many of these stand close together."""
    of = {w: found for w in set(words) if (found := [s for s in prefixes(w) if s in stems])}
    at: dict[str, list[int]] = {}
    if of:
        for i, w in enumerate(words):
            for s in of.get(w, ()):
                at.setdefault(s, []).append(i)
    return {s: densest(places) for s, places in at.items()}


def terms_of(words: list[str], stems) -> set[str]:
    """Words, and stems marked by as many stars as they have hits or fewer."""
    return set(words) | {s + "*" * k for s, most in stem_hits(words, stems).items() for k in range(1, most + 1)}


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS) + 2))
    bias: float = -30.0
    accuracy: dict[str, tuple[float, float]] = field(default_factory=dict)  # voter: how often it fires on toxic, on clean
    correlated: list[tuple[str, str]] = field(default_factory=list)  # voters that go together within the classes

    def __post_init__(self):
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.stems = {t.rstrip("*") for t in self.terms if t[-1] == "*"}
        self.patterns = [re.compile(p) for p in PATTERNS]

    def votes(self, text: str) -> tuple[list[int], int]:
        """Voters that fire, and the hits of the words and stems behind them."""
        words = WORDS.findall(text.lower())
        terms = terms_of(words, self.stems)
        fired = {self.place[t] for t in terms & self.place.keys()}
        of = {self.terms[i].rstrip("*"): self.terms[i][-1] == "*" for i in fired}
        hits = sum(next((k for k in range(HITS, 1, -1) if stem and s + "*" * k in terms), 1) for s, stem in of.items())
        return [*fired, *(len(self.terms) + i for i, p in enumerate(self.patterns) if p.search(text))], hits

    def features(self, texts: list[str]) -> np.ndarray:
        n = len(self.terms) + len(PATTERNS)
        x = np.zeros((len(texts), n + 2))
        for row, t in zip(x, texts):
            fired, hits = self.votes(t)
            row[fired] = 1
            row[n] = np.log1p(hits)
            row[n + 1] = hits > 0
        return x

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.weights + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def echoes(term: str, rows: list[int], chosen: str, chosen_rows: set[int]) -> bool:
    """Whether a term says what a chosen one says: one's letters begin the other's, and they share nearly all texts."""
    a, b = term.rstrip("*"), chosen.rstrip("*")
    shared = len(chosen_rows.intersection(rows))
    return (a.startswith(b) or b.startswith(a)) and shared >= 0.8 * (len(rows) + len(chosen_rows) - shared)


def find_terms(toxic: list[list[str]], clean: list[list[str]]) -> list[str]:
    """Terms of toxic texts that clean ones lack, chosen greedily until each toxic text has three or no term helps."""
    least = max(4, 0.002 * len(toxic))
    ratio = len(clean) / max(1, len(toxic))
    heads = [Counter(s for words in texts for s in {s for w in set(words) for s in prefixes(w)}) for texts in (toxic, clean)]
    stems = {s for s, n in heads[0].items() if n >= least and n * ratio >= 2 * heads[1][s]}
    in_toxic: dict[str, list[int]] = {}
    for i, words in enumerate(toxic):
        for t in terms_of(words, stems):
            in_toxic.setdefault(t, []).append(i)
    in_toxic = {t: rows for t, rows in in_toxic.items() if len(rows) >= least}
    in_clean: Counter[str] = Counter()
    for words in clean:
        in_clean.update(terms_of(words, stems) & in_toxic.keys())
    holds = {t: rows for t, rows in in_toxic.items() if len(rows) * ratio >= 20 * (in_clean[t] + 0.2 * ratio)}
    need = np.full(len(toxic), 3)
    chosen: list[str] = []
    while holds and len(chosen) < VOTERS:
        gain = {t: int((need[rows] > 0).sum()) - 5 * in_clean[t] for t, rows in holds.items()}
        best = max(gain, key=lambda t: (gain[t], -t.count("*"), len(t), t))
        if gain[best] < least:
            break
        chosen.append(best)
        rows_of = set(holds.pop(best))
        need[list(rows_of)] -= 1
        holds = {t: rows for t, rows in holds.items() if gain[t] >= least and not echoes(t, rows, best, rows_of)}
    return chosen


def label_model(fires: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the class of each row, how often voters fire by class (2 x voters), and which go together.

    A last voter is added, against: it fires where no other does. ``start`` is the posterior that the
    rounds begin with. Two voters go together where their votes' correlation within the classes exceeds
    0.2 and four times what so many rows show by chance; of such votes on one row, each counts the less.
    """
    fires = np.column_stack([fires, fires.sum(axis=1) == 0]).astype(float)
    post = start.astype(float)
    noise = max(0.2, 4 / np.sqrt(max(1, len(fires))))
    for _ in range(rounds):
        mass = np.stack([1 - post, post])
        rate = (mass @ fires + [[0.02], [0.2]]) / (mass.sum(axis=1, keepdims=True) + 2)
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        prior = np.clip(post.mean(), 0.01, 0.99)
        left = fires - mass.T @ rate
        cov = left.T @ left / len(fires)
        dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        together = np.clip(cov / np.outer(dev, dev), 0, 1)
        together[together < noise] = 0
        np.fill_diagonal(together, 1)
        shared = np.maximum(fires @ together, 1)  # of each vote: the votes of the row that go with it
        evidence = (fires * np.log(rate[1] / rate[0]) / shared).sum(axis=1)  # a voter that does not fire abstains
        post = sigmoid(evidence + np.log(prior / (1 - prior)))
    return post, rate, together > 0


def train(x: np.ndarray, target: np.ndarray, steps: int = 30, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic weights and bias by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + keep, x.T @ (p - target) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def scaled(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of z such that CUT tells the labels apart best, and scores follow their frequency.

    The cut is the middle of the widest gap of least cost; a clean text above costs as much as FALSE
    toxic ones below. The slope is the likeliest of those that are tried, the shift fixed by the cut.
    """
    values = np.unique(z)
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    gaps = np.concatenate([[0], np.diff(values), [0]])
    cost = [int(((z <= c) & (labels == 1)).sum() + FALSE * ((z > c) & (labels != 1)).sum()) for c in cuts]
    cut = float(cuts[max(range(len(cuts)), key=lambda i: (-cost[i], gaps[i]))])
    at = float(np.log(CUT / (1 - CUT)))

    def likelihood(slope: float) -> float:
        p = np.clip(sigmoid(slope * (z - cut) + at), 1e-6, 1 - 1e-6)
        return float(np.log(np.where(labels == 1, p, 1 - p)).sum())

    slope = max((2.0 ** (k / 2) for k in range(-8, 17)), key=likelihood)
    return slope, at - slope * cut


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """labels: doc_id, toxic; the sample's ids, of bounded number, are broadcast, so texts are not shuffled."""
    clear = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").drop("other")
    chosen = bounded_sample(clear, "toxic", per_class)
    found = bounded_texts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")), 2 * per_class, SAMPLE_BYTES)
    clean, toxic = found.get(0, []), found.get(1, [])
    if not clean or not toxic:
        return Model()
    split = [[WORDS.findall(t.lower()) for t in ts] for ts in (toxic, clean)]
    model = Model(list(dict.fromkeys([*find_terms(*split), *LEXICON])))
    x = model.features([*toxic, *clean])
    y = np.array([1] * len(toxic) + [0] * len(clean))
    voters = len(model.terms) + len(PATTERNS)
    post, rate, together = label_model(x[:, :voters], np.where(y == 1, 0.9, 0.1))
    weights, bias = train(x, post)
    slope, shift = scaled(x @ weights + bias, y)
    model.weights, model.bias = slope * weights, slope * bias + shift
    names = [*model.terms, *PATTERNS]
    model.accuracy = {n: (rate[1, i], rate[0, i]) for i, n in enumerate(names)}
    model.correlated = [(names[i], names[j]) for i, j in zip(*np.nonzero(np.triu(together[:voters, :voters], 1)))]
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with score (double), without the text unless it is kept."""
    sent = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, model.bias))
    own = fresh("__text", docs.columns)
    out = fresh("score", docs.columns)
    kept = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches):
        m = Model(*sent.value)
        for batch in slices(batches, 512):
            scores = m.scores([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], out])

    schema = docs.select(*kept).withColumn(out, F.lit(0.0)).schema
    return docs.select(*kept, F.col(text_col).cast("string").alias(own)).mapInArrow(run, schema)


def learnable(rows: DataFrame) -> DataFrame:
    """Rows whose labels may be learned from."""
    return rows.filter(~held_out("doc_id", 3, 1))
