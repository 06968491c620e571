"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector (words frequent in training) and as the mean vector of its
hashed character trigrams, so unseen forms of known stems are recognised.  Two recurrent
passes read a window of words, attention weighs its positions, and a logistic unit gives
the window's score.  A document is cut into overlapping windows, all of which are
scored; its score is the largest.

Trained in numpy on the driver, from a bounded sample of the labelled rows outside the
held-out fold.  Labels are of documents: in training a toxic document lends the window that
the model so far finds most toxic, a clean one random windows and its most suspicious one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmetry.llm.common import WORD, crc_remainder
from cellmetry.session import cut_lineage

#: Labelled rows of each label that are read for training, at most: those of smallest hash.
TRAIN_TOXIC, TRAIN_CLEAN = 2_500, 5_000
WINDOW, STRIDE = 32, 24
MAX_WORDS = 20_000
TRIGRAMS = 1 << 13
WORD_DIM = CHAR_DIM = HIDDEN = 12
EPOCHS, LEAST_STEPS, BATCH, RATE = 3, 240, 128, 0.01
#: Distinct words whose inputs a task keeps; it starts anew beyond them.
MAX_SEEN = 200_000

_WORDS = re.compile(WORD)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def plain_word(word: str) -> str:
    """Lower case without punctuation at the ends; junk alone stays as it is."""
    return (_EDGES.sub("", word) or word).lower()


def trigram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of words in spaces, and the first trigram of each word."""
    data = np.frombuffer(
        (" " + " ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8
    ).astype(np.int64)
    middle = data[1:-1] != 32
    code = (data[:-2] * 7919 + data[1:-1] * 104729 + data[2:] * 1299709) % TRIGRAMS
    starts = np.flatnonzero(middle & (data[:-2] == 32))
    return code[middle], np.cumsum(middle)[starts] - 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters by name, and the row of each known word (0 is any other)."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, vocabulary: dict[str, int], rng: np.random.Generator) -> Network:
        h, d = HIDDEN, WORD_DIM + CHAR_DIM

        def drawn(*shape: int) -> np.ndarray:
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        p = {
            "word": (0.1 * rng.normal(size=(len(vocabulary) + 1, WORD_DIM))).astype(np.float32),
            "char": (0.1 * rng.normal(size=(TRIGRAMS, CHAR_DIM))).astype(np.float32),
            "attend": drawn(2 * h, h), "weigh": drawn(h), "out": drawn(2 * h),
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            p |= {f"W{side}": drawn(d, 3 * h), f"U{side}": drawn(h, 3 * h)}
            p[f"c{side}"] = np.zeros(3 * h, np.float32)
        return cls(vocabulary, p)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of plain words, and their word rows, trigrams and first trigrams."""
        rows = np.array([self.vocabulary.get(w, 0) for w in words])
        grams, first = trigram_rows(words)
        sizes = np.diff(np.append(first, len(grams)))
        mean = np.add.reduceat(self.p["char"][grams], first, axis=0) / sizes[:, None]
        return np.concatenate([self.p["word"][rows], mean], axis=1), rows, grams, first

    def side(self, side: str, projected: np.ndarray, at: np.ndarray, keep: list | None = None):
        """Hidden states (windows, positions, h) of one pass over the rows ``at``.

        Row 0 of ``projected`` stands for no word and leaves the state as it is.
        """
        n, t = at.shape
        h, hidden = HIDDEN, np.zeros((n, HIDDEN), np.float32)
        states = np.empty((n, t, h), np.float32)
        U = self.p[f"U{side}"]
        for i in range(t) if side == "f" else range(t - 1, -1, -1):
            x, here = projected[at[:, i]], at[:, i, None] > 0
            u = hidden @ U
            gates = sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            if keep is not None:
                keep.append((i, hidden, z, r, new, u[:, 2 * h :], here))
            hidden = np.where(here, new + z * (hidden - new), hidden)
            states[:, i] = hidden
        return states

    def pooled(self, states: np.ndarray, at: np.ndarray):
        """Logits of windows, with the parts that training needs."""
        hidden = np.tanh(states @ self.p["attend"])
        score = np.where(at > 0, hidden @ self.p["weigh"], np.float32(-1e9))
        weight = np.exp(score - score.max(1, keepdims=True)) * (at > 0)
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, states)
        return pooled @ self.p["out"] + self.p["bias"][0], hidden, weight, pooled

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]

    def logits(self, projected: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        states = [self.side(s, v, at) for s, v in zip("fb", projected)]
        return self.pooled(np.concatenate(states, axis=2), at)[0]

    def window_logits(self, words: list[str], at: np.ndarray) -> np.ndarray:
        """Logits of windows that hold 1 + place in plain words, 0 for none."""
        x = self.inputs(words)[0] if words else np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        none = np.zeros((1, 3 * HIDDEN), np.float32)
        return self.logits([np.concatenate([none, v]) for v in self.project(x)], at)

    def gradients(
        self, words: list[str], at: np.ndarray, y: np.ndarray, times: float = 1
    ) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss; ``at`` holds 1 + place in words, 0 for none.

        Windows of label 1 count ``times`` times.
        """
        p, h, n = self.p, HIDDEN, len(y)
        x, rows, grams, first = self.inputs(words)
        kept = {"f": [], "b": []}
        states = []
        for s, v in zip("fb", self.project(x)):
            v = np.concatenate([np.zeros((1, 3 * h), np.float32), v])
            states.append(self.side(s, v, at, kept[s]))
        states = np.concatenate(states, axis=2)
        logit, hidden, weight, pooled = self.pooled(states, at)
        g: dict[str, np.ndarray] = {}
        d_logit = ((sigmoid(logit) - y) * np.where(y, times, 1) / n).astype(np.float32)
        g["bias"], g["out"] = d_logit.sum(keepdims=True), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nh,nth->nt", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_hidden = d_score[..., None] * p["weigh"] * (1 - hidden**2)
        g["weigh"] = np.einsum("nt,nth->h", d_score, hidden)
        g["attend"] = np.einsum("ntk,nth->kh", states, d_hidden)
        d_states = weight[..., None] * d_pooled[:, None] + d_hidden @ p["attend"].T
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            U, d_U = p[f"U{s}"], np.zeros_like(p[f"U{s}"])
            d_proj = np.zeros((len(words) + 1, 3 * h), np.float32)
            carry = np.zeros((n, h), np.float32)
            for i, before, z, r, new, inner, here in reversed(kept[s]):
                d = carry + d_states[:, i, k * h : (k + 1) * h]
                mine = np.where(here, d, 0)
                d_new = mine * (1 - z) * (1 - new**2)
                d_z = mine * (before - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_U += before.T @ d_u
                carry = np.where(here, mine * z, d) + d_u @ U.T
                np.add.at(d_proj, at[:, i], np.concatenate([d_z, d_r, d_new], axis=1))
            d_proj = d_proj[1:]
            g[f"U{s}"], g[f"c{s}"], g[f"W{s}"] = d_U, d_proj.sum(0), x.T @ d_proj
            d_x += d_proj @ p[f"W{s}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], rows, d_x[:, :WORD_DIM])
        sizes = np.diff(np.append(first, len(grams)))
        np.add.at(g["char"], grams, np.repeat(d_x[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        return g


class Scorer:
    """Scores texts with a network, keeping the inputs of words it has seen."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        none = np.zeros((1, 3 * HIDDEN), np.float32)
        self.projected, self.size = [none.copy(), none.copy()], 1

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Row numbers of all words of each text."""
        split = [_WORDS.findall(t) for t in texts]
        if self.size > MAX_SEEN:
            self.clear()
        rows = self.rows
        new = list(dict.fromkeys(w for words in split for w in words if w not in rows))
        for start in range(0, len(new), 50_000):
            part = new[start : start + 50_000]
            x, *_ = self.network.inputs([plain_word(w) for w in part])
            for i, v in enumerate(self.network.project(x)):
                if self.size + len(part) > len(self.projected[i]):
                    grown = np.zeros((2 * (self.size + len(part)), 3 * HIDDEN), np.float32)
                    grown[: self.size] = self.projected[i][: self.size]
                    self.projected[i] = grown
                self.projected[i][self.size : self.size + len(part)] = v
            rows.update(zip(part, range(self.size, self.size + len(part))))
            self.size += len(part)
        return [np.fromiter((rows[w] for w in words), np.int32, len(words)) for words in split]

    def window_logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of the texts, and the first window of each text."""
        rows = self.words(texts)
        at, first = windows(rows)
        out = np.empty(len(at))
        for start in range(0, len(at), 4096):
            out[start : start + 4096] = self.network.logits(self.projected, at[start : start + 4096])
        return out, first

    def scores(self, texts: list[str]) -> np.ndarray:
        logits, first = self.window_logits(texts)
        return sigmoid(np.maximum.reduceat(logits, first)) if len(texts) else np.zeros(0)


def windows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows over the words of texts (0 where a window has none), and the
    first window of each text; a text without words has one empty window."""
    counts = np.array([max(1, -(-max(0, len(r) - WINDOW) // STRIDE) + 1) for r in rows], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(rows) else np.zeros(0, np.int64)
    at = np.zeros((int(counts.sum()), WINDOW), np.int32)
    for r, n, f in zip(rows, counts, first):
        padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
        padded[: len(r)] = r
        at[f : f + n] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
    return at, first


def train_network(texts: list[str], labels: np.ndarray, seed: int = 11) -> Network:
    """Fit on texts and labels 0 or 1; without both labels the score is their share."""
    rng = np.random.default_rng(seed)
    # Texts as numbers of their plain words, 1 for the first; few strings are kept.
    number: dict[str, int] = {}
    numbered: dict[str, int] = {}
    rows = []
    for text in texts:
        found = []
        for w in _WORDS.findall(text):
            i = numbered.get(w)
            if i is None:
                i = numbered[w] = number.setdefault(plain_word(w), len(number) + 1)
            found.append(i)
        rows.append(np.array(found, np.int32))
    del numbered
    known, n, n1 = list(number), len(texts), int(labels.sum())
    del number
    toxic, clean = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for r, y in zip(rows, labels):
        (toxic if y else clean)[np.unique(r)] += 1
    a, b = toxic[1:], clean[1:]
    frequent = [i for i in np.lexsort((np.arange(len(known)), -(a + b))) if a[i] + b[i] >= 3]
    frequent = frequent[:MAX_WORDS]
    network = Network.start({known[i]: k + 1 for k, i in enumerate(frequent)}, rng)
    if not 0 < n1 < n:
        network.p["out"][:] = 0
        share = (n1 + 0.5) / (n + 1)
        network.p["bias"][:] = np.log(share / (1 - share))
        return network

    # One input starts as the log-odds of words and trigrams among toxic texts.
    def odds(a, b):
        return np.clip(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n - n1 + 1)), -4, 4) / 2

    grams, first = trigram_rows(known) if known else (np.zeros(0, np.int64),) * 2
    sizes = np.diff(np.append(first, len(grams)))
    per = [np.bincount(grams, np.repeat(v, sizes), TRIGRAMS) for v in (a, b)]
    network.p["char"][:, 0] = odds(*per)
    network.p["word"][1:, 0] = odds(a[frequent], b[frequent])

    # Windows over the words of the sample; the first choice is by log-odds.
    at, start = windows(rows)
    ends = np.append(start[1:], len(at))
    word_odds = np.concatenate([[0], np.where(a + b >= 3, odds(a, b), 0)])
    char_odds = np.add.reduceat(network.p["char"][grams, 0], first) / sizes if known else []
    per_word = np.maximum(0, word_odds + np.concatenate([[0], char_odds])).astype(np.float32)
    del grams, first, sizes, word_odds, char_odds
    strength = per_word[at].sum(1)

    def gathered(choice: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The words of some windows, and the windows as 1 + place in them."""
        used, local = np.unique(at[choice], return_inverse=True)
        words = [known[i - 1] for i in used if i]
        return words, local.reshape(len(choice), WINDOW) + (len(words) == len(used))

    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // (n1 + 3 * (n - n1))))
    weight = np.float32(min(5, max(1, (n - n1) / n1)))  # of toxic windows
    step = 0
    for epoch in range(epochs):
        chosen, target = [], []
        for i, y in enumerate(labels):
            own = strength[start[i] : ends[i]]
            best = start[i] + int(np.argmax(own))
            picks = {best} if y else {best, *rng.integers(start[i], ends[i], 2).tolist()}
            chosen += sorted(picks)
            target += [y] * len(picks)
        order, target = rng.permutation(len(chosen)), np.array(target, np.float32)
        chosen = np.array(chosen)
        for s in range(0, len(order), BATCH):
            pick = order[s : s + BATCH]
            words, local = gathered(chosen[pick])
            if not words:
                continue
            g = network.gradients(words, local, target[pick], weight)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v * min(1, 1 / max(norm, 1e-9))
                m, q = moment[k]
                m += 0.1 * (v - m)
                q += 0.01 * (v * v - q)
                rate = RATE * (1 if epoch < epochs - 1 else 0.3)
                network.p[k] -= (
                    rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
                ).astype(np.float32)
        if epoch < epochs - 1:
            for s in range(0, len(at), 4096):
                words, local = gathered(np.arange(s, min(len(at), s + 4096)))
                strength[s : s + 4096] = network.window_logits(words, local)
    return network


def train_toxicity(
    docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN
) -> Network:
    """Fit on labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0).

    At most ``toxic`` and ``clean`` rows of each label, those of smallest hash of the id.  Null
    ids and labels other than 0 and 1 are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(crc_remainder("doc_id", 5) != 0)
    known = known.select(F.col("doc_id").alias("l_id"), F.col("toxic").alias("y"))
    order = [F.xxhash64("l_id"), "l_id"]
    sample = (
        known.where("y = 1").orderBy(*order).limit(toxic)
        .unionByName(known.where("y = 0").orderBy(*order).limit(clean))
    )
    sample = cut_lineage(sample)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = (
        texts.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
        .select("doc_id", "text", "y")
        .limit(2 * (toxic + clean))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["text"]))
    texts, y = [r["text"] for r in rows], np.array([r["y"] for r in rows], int)
    del rows
    return train_network(texts, y)


def toxicity_scores(docs: DataFrame, network: Network) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Null texts count as empty; an empty text is one empty window and has a score.  Null ids
    are kept and count as the empty text in the fold.  Repeated rows get equal scores.
    Other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(
        "doc_id",
        (crc_remainder("doc_id", 5) == 0).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                score = scorer.scores(part.column(2).to_pylist()).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
