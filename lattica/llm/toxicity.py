"""Toxicity by weak supervision.

Voters are a lexicon's words, patterns that match their starts, and patterns
that know no word (masked curses, a second person beside a lexicon's word).  A
voter votes toxic where it matches; one more votes clean where none does.  A
generative label model estimates each voter's accuracies by expectation
maximisation, and the pairwise correlations of either sign that the label
doesn't explain, by which it weighs voters that repeat or exclude each other.
No gold label enters that model.  A linear classifier over hashed words and
word starts is trained on its posterior labels and scores whole texts.

Gold labels choose voters and balance the sample, no more: a word of the lexicon
that clean rows have nearly as often is left out, and words and word starts that
toxic rows have far more often than clean ones extend it, as a corpus has
insults, and languages, that no list knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_bucket, known, through
from lattica.llm.ftrl import Ftrl, sigmoid
from lattica.llm.quality import FIT_BYTES, bounded, labelled_sample

#: Labelled rows that voters are found in and models are fitted on: so many of either label at most.
SAMPLE = 3072
#: Characters of the word starts that patterns match.
STARTS = (4, 5, 6, 7)
VOTERS = 400
EPOCHS = 12
LIFT = 6
REJECT = 0.5

#: Times as often among toxic examples as among clean ones that a voter of the lexicon must occur.
VETTED = 5
#: And a term that is mined from the labelled rows.
MINED = 50
#: The share of clean examples, at least one of them, that a voter may match without a further test, as labels err.
STRAY = 0.001
#: Correlations smaller than this are taken for chance.
LEAST_RHO = 0.1
#: The share of a vote that voters which exclude each other get back at most.
EXCLUDED = 0.5

#: Common insults in four languages, one meaning each as far as there are such.
LEXICON = (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles cretin cretins stupid stupidity dimwit halfwit nitwit dunce "
    "simpleton dumbass jackass asshole bastard bastards bitch scum scumbag trash vermin parasite filth filthy lowlife deadbeat "
    "loser losers clown clowns jerk creep weirdo freak pathetic worthless useless disgusting repulsive vile despicable "
    "contemptible brainless braindead ignorant coward cowards pervert sicko lunatic psycho bullshit "
    "dummkopf vollidiot trottel depp deppen schwachkopf volltrottel arschloch mistkerl drecksack abschaum missgeburt versager "
    "taugenichts widerlich ekelhaft erbärmlich wertlos hirnlos schwachsinnig blödmann schlampe hurensohn "
    "imbécile imbéciles crétin crétins abruti abrutie connard connasse salaud salope ordure raclure débile minable pathétique "
    "dégoûtant répugnant méprisable bouffon enfoiré "
    "imbécil imbéciles estúpido estúpida gilipollas cabrón pendejo escoria basura patético patética asqueroso asquerosa "
    "despreciable inútil payaso perdedor cobarde cretino"
).split()
#: Second persons that stand beside an insult, and a curse whose middle is masked.
SECOND = "you your you're youre ur du dich ihr tu toi vous tú eres usted".split()
MASKED = re.compile(rb"[A-Za-z][*#@$%]{2,}[A-Za-z]")

#: ASCII other than letters and digits is no part of a word.
_BLANK = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes) -> set[bytes]:
    """A text's distinct words in lower case, and the starts of longer ones in bytes, marked by a star."""
    run = text.decode("utf-8", "replace").lower().encode().translate(_BLANK).split()
    words = set(run)
    found = words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in STARTS))
    if not words.isdisjoint(_INSULTS) and any((a in _SECOND and b in _INSULTS) or (b in _SECOND and a in _INSULTS) for a, b in _near(run)):
        found.add(b"<second person>")
    if MASKED.search(text):
        found.add(b"<masked>")
    return found


_INSULTS, _SECOND = {w.encode() for w in LEXICON}, {w.encode() for w in SECOND}


def _near(run: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of words at most three apart."""
    for gap in (1, 2, 3):
        yield from zip(run, run[gap:], strict=False)


def lexicon_terms(lexicon: list[str]) -> set[bytes]:
    """The lexicon's words, the starts that patterns match, and the patterns without words."""
    words = {w.lower().encode() for w in lexicon}
    starts = set().union(*({w[:n] + b"*" for w in words if len(w) > n} for n in STARTS[1:]))
    return words | starts | {b"<second person>", b"<masked>"}


def find_voters(rows: list[np.ndarray], labels: np.ndarray, size: int, most: int = VOTERS) -> np.ndarray:
    """Terms that toxic examples have at least MINED times as often as clean ones, strongest first."""
    def counts(label: int) -> np.ndarray:
        own = [r for r, y in zip(rows, labels, strict=True) if y == label]
        return np.bincount(np.concatenate(own), minlength=size) if own else np.zeros(size, np.int64)

    toxic, clean = counts(1), counts(0)
    n, m = max(int(labels.sum()), 1), max(int((1 - labels).sum()), 1)
    usual = (toxic >= max(4, 0.02 * n)) & (toxic / n >= MINED * clean / m) & (toxic / n >= 5 / (m + 1))
    strength = np.where(usual, toxic * np.log(((toxic + 0.5) / (n + 1)) / ((clean + 0.5) / (m + 1))), 0.0)
    order = np.lexsort((np.arange(size), -strength))[:most]
    return order[strength[order] > 0]


def _vetted(voters: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The lexicon's voters without those that mean something else in these texts."""
    hits = {label: np.sum([np.isin(voters, r, assume_unique=True) for r, y in zip(rows, labels, strict=True) if y == label] or [np.zeros(len(voters), bool)], axis=0) for label in (0, 1)}
    n, m = max(int(labels.sum()), 1), max(int((1 - labels).sum()), 1)
    return voters[(hits[1] / n >= VETTED * hits[0] / m) & (hits[1] > 0)]


def _adding(voters: np.ndarray, times: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The voters that hardly any clean examples have, and of the others those that add to purer ones.

    A start shared with a harmless word is as frequent among toxic examples as
    the insult that it begins.  So a voter that clean examples have must occur
    ``times`` as often among the toxic ones where no purer voter matches.
    """
    if not len(voters):
        return voters
    hits = np.array([np.isin(voters, at, assume_unique=True) for at in rows])
    toxic = labels == 1
    n, m = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    clean = hits[~toxic].sum(axis=0)
    kept = clean <= max(1, STRAY * m)
    silent = ~hits[:, kept].any(axis=1)
    for k in np.lexsort((np.arange(len(voters)), clean)):
        if not kept[k]:
            own = hits[:, k] & silent
            more = int((own & toxic).sum())
            if more and more / n >= times[k] * int((own & ~toxic).sum()) / m:
                kept[k] = True
                silent &= ~hits[:, k]
    return voters[kept]


@dataclass
class LabelModel:
    """Vote rates of each voter among toxic and clean texts, the prior, and the discount for correlated voters."""

    toxic: np.ndarray
    clean: np.ndarray
    prior: float
    discount: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.toxic / self.clean) * self.discount
        silent = np.log((1 - self.toxic) / (1 - self.clean)) * self.discount
        return sigmoid(np.log(self.prior / (1 - self.prior)) + votes @ fired + (1 - votes) @ silent)


def fit_label_model(votes: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation maximisation from the voters alone: votes is texts by voters, the last column votes clean.

    Starts from whether any voter says toxic.  Each round re-estimates the vote
    rates and the correlations, of either sign, that remain within the labels.
    A voter is divided by its summed positive correlations, itself included, so
    copies share one vote; what it excludes gives up to half of a share back,
    as far as a whole vote.
    """
    votes = votes.astype(float)
    q = np.clip((votes[:, :-1].sum(axis=1) > 0).astype(float), 0.05, 0.95)
    model = None
    for _ in range(rounds):
        prior = float(np.clip(q.mean(), 0.01, 0.99))
        toxic = (q @ votes + 0.1) / (q.sum() + 1)
        clean = ((1 - q) @ votes + 0.01) / ((1 - q).sum() + 1)
        toxic, clean = np.clip(toxic, 1e-4, 1 - 1e-4), np.clip(clean, 1e-4, 1 - 1e-4)
        left = (q[:, None] * (votes - toxic)).T @ (votes - toxic) + ((1 - q)[:, None] * (votes - clean)).T @ (votes - clean)
        spread = np.sqrt(np.maximum(np.diag(left), 1e-9))
        rho = left / np.outer(spread, spread)
        rho[np.abs(rho) < LEAST_RHO] = 0
        np.fill_diagonal(rho, 1)
        repeats, excludes = np.maximum(rho, 0).sum(axis=1), np.maximum(-rho, 0).sum(axis=1)
        model = LabelModel(toxic, clean, prior, np.minimum(1, (1 + EXCLUDED * excludes / (1 + excludes)) / repeats))
        new = model.posterior(votes)
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
    return model


def _telling(rows: list[np.ndarray], posterior: np.ndarray, size: int) -> np.ndarray:
    """Terms that probably toxic texts have at least LIFT times as often as others: the classifier's features."""
    toxic, clean = np.zeros(size), np.zeros(size)
    for at, p in zip(rows, posterior, strict=True):
        toxic[at] += p
        clean[at] += 1 - p
    rate = (toxic + 0.1) / (posterior.sum() + 1)
    return (toxic >= 2) & (rate >= LIFT * (clean + 0.1) / ((1 - posterior).sum() + 1))


def _packed(texts: list) -> dict:
    return {"terms": [b"\t".join(sorted(_terms(text))) for text in known(texts)]}


def train(found: list[tuple[bytes, int]], lexicon: list[str] | None = None) -> tuple[float, dict[bytes, float]] | None:
    """The classifier's bias and its weights by term, from texts' terms (between tabs) and labels; None without voters or texts."""
    numbers: dict[bytes, int] = {}
    split = [([numbers.setdefault(t, len(numbers)) for t in terms.split(b"\t") if t], label) for terms, label in found]
    # The same order of rows and terms on any cluster.
    names = sorted(numbers)
    place = np.empty(len(names), np.int64)
    for k, name in enumerate(names):
        place[numbers[name]] = k
    ready = sorted(((np.sort(place[np.array(at, np.int64)]), label) for at, label in split), key=lambda row: (row[1], row[0].tobytes()))
    rows, y = [at for at, _ in ready], np.array([label for _, label in ready])
    if not rows:
        return None
    wanted = lexicon_terms(LEXICON if lexicon is None else lexicon)
    voters = np.array([k for k, name in enumerate(names) if name in wanted], np.int64)
    if lexicon is None:
        listed = _vetted(voters, rows, y)
        voters = np.union1d(listed, find_voters(rows, y, len(names))).astype(np.int64)
        voters = _adding(voters, np.where(np.isin(voters, listed), VETTED, MINED), rows, y)
    if not len(voters):
        return None
    votes = np.array([np.isin(voters, at, assume_unique=True) for at in rows])
    votes = np.column_stack([votes, ~votes.any(axis=1)])
    posterior = fit_label_model(votes).posterior(votes.astype(float))
    usable = _telling(rows, posterior, len(names))
    vectors = [(np.concatenate([[0], own]), np.ones(len(own) + 1)) for own in (at[usable[at]] + 1 for at in rows)]
    weights = Ftrl(len(names).bit_length() + 1, alpha=0.3, l1=1.0, l2=0.5).fit(vectors, posterior, EPOCHS).weights()
    return float(weights[0]), {names[k]: float(weights[k + 1]) for k in range(len(names)) if weights[k + 1]}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon: list[str] | None = None, most: int = FIT_BYTES) -> tuple[float, dict[bytes, float]] | None:
    """train() on at most ``sample`` labelled rows of either label, of ``most`` bytes together, that aren't held out."""
    found = []
    for label in (0, 1):
        own = labelled_sample(docs, labels.where(F.col("toxic") == label), "toxic", sample)
        rows = bounded(through(own, "terms binary", lambda: _packed, kept=["label"]), "terms", "terms", most // 2)
        found += [(bytes(r["terms"]), r["label"]) for r in rows]
    return train(found, lexicon)


def score(texts: list[bytes], model: tuple[float, dict[bytes, float]] | None) -> list[float]:
    if model is None:
        return [0.0] * len(texts)
    bias, weights = model
    usable = weights.keys()
    return [float(sigmoid(bias + sum(weights[t] for t in sorted(usable & _terms(text))))) for text in texts]


def with_toxicity(docs: DataFrame, labels: DataFrame, name: str, sample: int = SAMPLE, lexicon: list[str] | None = None) -> DataFrame:
    """docs and the score of each row's own text in a further column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, lexicon))
    work = lambda: lambda texts: {name: score(known(texts), shared.value)}
    return through(docs.withColumn("text", F.col("text").cast("string")), f"`{name}` double", work, kept=docs.columns)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = REJECT, sample: int = SAMPLE, lexicon: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) and labels (doc_id, toxic, ...) to (doc_id, held_out, score, predicted), a row per row.

    Models are fitted on the labelled rows whose crc32(doc_id as text) mod 5 is
    not 0: at most ``sample`` of either label.  ``lexicon`` replaces LEXICON.

    Defined cases: null, empty and blank texts have the bias alone and so one
    score; labels that are null or neither 0 nor 1, and ids without a text, are
    no examples; rows that share a doc_id are one example; without voters every
    score is 0.  A row without doc_id is
    scored, and held out is false.  An empty table gives an empty result;
    further columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_toxicity(narrow, labels, "score", sample, lexicon).select(
        "doc_id",
        F.coalesce(crc_bucket() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
