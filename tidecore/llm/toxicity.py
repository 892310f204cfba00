"""Toxicity classifier with counterfactual regularisation.

A text is scored by its sentence that scores highest. A sentence is the set of its
words and of their beginnings, hashed, so that inflected forms of a known stem count. While learning, identity terms in the labelled sentences are
swapped for one another and left out, with their beginnings, and every difference in score between a sentence and its swapped
form is penalised, so that naming a group says nothing by itself.

The project has no records of texts with toxicity labels, so this operator is
general: it works on any table of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tidecore.llm.hashing import U
from tidecore.llm.labelled import sample_texts, score_texts
from tidecore.llm.memory import give_back
from tidecore.llm.runs import LETTER, Runs, slices

# Labelled texts the classifier is fitted on, at most.
TRAIN_TEXTS = 5000
SIEVE_BITS, BUCKET_BITS = 20, 24
# Beginnings of words that are features beside the words, in bytes.
PREFIXES = (4, 5, 6)
# Words that take part: at least so many texts, and so strongly tied to the label (chi square).
LEAST_TEXTS, LEAST_CHI, MOST_WORDS = 3, 15.0, 4096
ROUNDS, STEPS, RATE, DECAY, SWAP_WEIGHT = 3, 500, 0.05, 1e-5, 4.0
# Terms that name groups, swapped for one another. A parameter of the operator.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "muslim", "muslims", "christian", "christians",
    "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "black", "white", "asian", "latino",
    "african", "european", "american", "mexican", "arab", "gay", "lesbian", "straight", "bisexual",
    "transgender", "immigrant", "immigrants", "refugee", "refugees", "disabled", "blind", "deaf",
    "old", "young", "poor", "rich",
)


@dataclass
class ToxicityModel:
    """Hashes of the words that count (ascending), their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; null and empty texts have no words."""
        out = []
        for runs in slices(texts):
            best, _ = best_sentences(runs, self.words, self.weights)
            out.append(best + self.bias)
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_toxicity(
    texts: DataFrame, labels: DataFrame, learnable: Column, carry: tuple[str, ...] = (), identity_terms: tuple[str, ...] = IDENTITY_TERMS
) -> DataFrame:
    """Score every text of ``(u, text)`` for toxicity: ``(u, score)``, one row per row.

    ``labels``: ``(u, label)`` with label 1 for toxic; only rows of ``texts`` for which
    ``learnable`` holds are learned from, ``TRAIN_TEXTS`` of them at most. A score is
    between 0 and 1, higher where label 1 is likelier, and depends on the text alone.
    The columns ``carry`` come along unchanged. Null and empty texts get the score of a text without words; equal texts equal scores;
    other columns are ignored. Without usable labels every score is 0.5. Whole texts are read.
    """
    sample, label = sample_texts(texts, labels, learnable, TRAIN_TEXTS)
    model = fit(sample, np.array(label, np.float64), identity_terms)
    del sample
    give_back()  # the driver trains more than one model
    return score_texts(texts, model.score if model else lambda t: np.full(len(t), 0.5), carry)


def _words(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Words and their beginnings: their place among the runs, and their hashes."""
    at = np.flatnonzero(runs.kind == LETTER)
    places, hashes = [at], [runs.hash[at]]
    for size in PREFIXES:
        at, own = runs.prefixes(size)
        places.append(at)
        hashes.append(own)
    return np.concatenate(places), np.concatenate(hashes)


def _known(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each hash among ``words``, or -1; a bit set sorts most of them out."""
    out = np.full(len(hashes), -1)
    shift = U(64 - SIEVE_BITS)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[words >> shift] = True
    maybe = np.flatnonzero(sieve[hashes >> shift])
    at = np.minimum(np.searchsorted(words, hashes[maybe]), max(len(words) - 1, 0))
    good = words[at] == hashes[maybe] if len(words) else np.zeros(0, bool)
    out[maybe[good]] = at[good]
    return out


def best_sentences(runs: Runs, words: np.ndarray, weights: np.ndarray):
    """Highest sum of the weights of a sentence's different words for each text (0 without
    words), and ``(text, word)`` of the words of that sentence."""
    at, hashes = _words(runs)
    word = _known(hashes, words)
    known = word >= 0
    at, word = at[known], word[known]
    best = np.zeros(runs.texts)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(word):
        return best, nothing
    pair = np.unique(runs.sentence[at].astype(np.int64) * len(weights) + word)
    sentence, word = pair // len(weights), pair % len(weights)
    names, first = np.unique(sentence, return_index=True)
    total = np.add.reduceat(weights[word], first)
    text = runs.row[np.searchsorted(runs.sentence, names)]
    order = np.lexsort((names, -total, text))
    top = order[np.diff(text[order], prepend=-1) != 0]
    sentences = runs.sentence[np.flatnonzero(np.diff(runs.sentence, prepend=-1))]
    have = np.bincount(runs.row[np.searchsorted(runs.sentence, sentences)], minlength=runs.texts)
    with_words = np.bincount(text, minlength=runs.texts)
    low = np.where(have > with_words, 0.0, -np.inf)  # a sentence without known words scores 0
    best[text[top]] = np.maximum(total[top], low[text[top]])
    of = np.full(int(names.max()) + 1, -1)
    chosen = top[total[top] >= low[text[top]]]
    of[names[chosen]] = text[chosen]
    owner = of[sentence]
    return best, (owner[owner >= 0], word[owner >= 0])


def fit(texts: pa.Array, label: np.ndarray, identity_terms: tuple[str, ...] = IDENTITY_TERMS) -> ToxicityModel | None:
    """Fit on labelled texts: sentences of a text are chosen anew in every round."""
    y = (label >= 0.5).astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    chosen, odds = _select(texts, y)
    terms = [np.unique(_words(runs)[1]) for term in identity_terms for runs in slices(pa.array([term]))]
    words = np.union1d(chosen, np.concatenate(terms)) if terms else chosen
    weights = np.zeros(len(words))
    weights[np.searchsorted(words, chosen)] = odds
    identity = [np.searchsorted(words, own) for own in terms if len(own)]
    for own in identity:
        weights[own] = 0
    bias = 0.0
    for _ in range(ROUNDS):
        owner, word, base = [], [], 0
        for runs in slices(texts):  # read anew in every round: runs take many times the texts' memory
            _, (o, w) = best_sentences(runs, words, weights)
            owner.append(o + base), word.append(w)
            base += runs.texts
        weights, bias = _train(np.concatenate(owner), np.concatenate(word), y, len(words), identity)
    return ToxicityModel(words, weights, bias)


def _different(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of the different words and beginnings of each text of a slice."""
    at, own = _words(runs)
    order = np.lexsort((own, runs.row[at]))
    row, own = runs.row[at][order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    return row[new], own[new]


def _select(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words tied to the label, and their log odds.

    A first pass counts texts per hash bucket, so that the second keeps few of the words that are too rare.
    """
    p, n = y.sum(), len(y) - y.sum()
    least = min(LEAST_TEXTS, max(1, p // 4))
    shift = U(64 - BUCKET_BITS)
    count = np.zeros(1 << BUCKET_BITS, np.uint8)
    for runs in slices(texts):
        own, times = np.unique(_different(runs)[1] >> shift, return_counts=True)
        count[own] = np.minimum(count[own] + times, 255)
    words, every, a, base = np.zeros(0, U), np.zeros(0), np.zeros(0), 0
    for runs in slices(texts):
        row, own = _different(runs)
        keep = count[own >> shift] >= least
        row, own = row[keep], own[keep]
        both, of = np.unique(np.concatenate([words, own]), return_inverse=True)
        total, positive = np.zeros(len(both)), np.zeros(len(both))
        total[of[: len(words)]], positive[of[: len(words)]] = every, a
        total += np.bincount(of[len(words) :], minlength=len(both))
        positive += np.bincount(of[len(words) :], y[base + row], minlength=len(both))
        words, every, a = both, total, positive
        base += runs.texts
    b = every - a
    chi = len(y) * (a * (n - b) - b * (p - a)) ** 2 / np.maximum(p * n * every * (len(y) - every), 1e-9)
    use = np.flatnonzero((every >= least) & (chi >= LEAST_CHI))
    use = np.sort(use[np.argsort(-chi[use], kind="stable")[:MOST_WORDS]])
    odds = np.log((a + 0.5) / (p - a + 0.5)) - np.log((b + 0.5) / (n - b + 0.5))
    return words[use], odds[use]


def _train(owner, word, y, width, identity) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam; a swap of identity terms should not change a logit.

    ``identity``: the features of each term, which are the word and its beginnings. For a
    sentence with identity term s, every swap to a term t changes the logit by the sum over
    the features of t less that over those of s. The penalty is the mean square of these
    differences over all swaps, and the square of what leaving the term out changes: swaps
    alone would leave all terms raised alike.
    """
    n = len(y)
    theta = np.zeros(width + 1)  # weights, then the bias
    terms = len(identity)
    features = np.concatenate([np.zeros(0, np.int64), *identity])
    of = np.repeat(np.arange(terms), [len(own) for own in identity])
    seen = np.bincount(word, minlength=width) / n
    uses = np.array([seen[own].min() for own in identity])  # sentences that name each term
    pull = uses[:, None] + uses[None, :]
    balance = np.where(y > 0, max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9)) ** -0.5
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        z = theta[width] + np.bincount(owner, theta[word], minlength=n)
        d = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        slope = np.append(np.bincount(word, d[owner], minlength=width) + DECAY * theta[:width], d.sum())
        if terms:
            own = np.bincount(of, theta[features], minlength=terms)
            push = SWAP_WEIGHT * 2 * (((own[:, None] - own[None, :]) * pull).sum(1) / max(terms - 1, 1) + own * uses)
            slope[:width] += np.bincount(features, push[of], minlength=width)
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:width], float(theta[width])
