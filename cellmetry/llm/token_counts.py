"""Token counts under a unigram model, scored once per shared prefix of a trie.

The model is a vocabulary of byte strings; a piece of rank r has probability proportional
to 1 / (r + 1).  The best segmentation of a pre-token is the one of highest product; its
forward score at a position depends on the bytes before it only, so every node of a trie
has one forward score, and pre-tokens with a common prefix share it.  A node also has
the number of pieces of its best segmentation, which is the count of a pre-token that
ends there.

The distinct new pre-tokens of a few hundred texts make a trie, visited depth first in
sorted order: only the path to the current node is held.  Nothing is shuffled.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmetry.llm.token_file import _BREAK

#: Words whose counts a Python worker keeps; beyond them those met again.
MAX_SEEN = 300_000
#: Texts whose new pre-tokens make one trie.
TEXTS = 500
_SHIFT = 32  # counts of pre-tokens and of pieces travel as one number


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64 and rank a line), by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return [base64.b64decode(piece) for piece, _ in sorted(pairs, key=lambda p: int(p[1]))]


class UnigramTrie:
    """Counts of best segmentations over the trie of sorted pre-tokens."""

    def __init__(self, pieces: list[bytes]) -> None:
        total = math.log(math.fsum(1 / (r + 1) for r in range(len(pieces))))
        self.scores = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
        if any(bytes([b]) not in self.scores for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.longest = max(map(len, pieces))
        self.nodes = 0  # scored so far

    def counts(self, words: list[bytes]) -> list[int]:
        """Pieces of the best segmentation of each of the sorted pre-tokens.

        ``best`` and ``count`` hold the path of the trie to the current node; a word
        leaves it where it parts from the word before.  The longer last piece wins a tie.
        """
        score, longest = self.scores.get, self.longest
        best, count, before, out = [0.0], [0], b"", []
        for word in words:
            shared, least = 0, min(len(before), len(word))
            while shared < least and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                top, n = -math.inf, 0
                for start in range(d - longest if d > longest else 0, d):
                    own = score(word[start:d])
                    if own is not None and best[start] + own > top:
                        top, n = best[start] + own, count[start] + 1
                best.append(top)
                count.append(n)
            self.nodes += len(word) - shared
            out.append(count[-1])
            before = word
        return out


def met_again(seen: dict, again: set[str], most: int) -> dict:
    """The words of a full cache that were met more than once, none where they are too many."""
    return {w: seen[w] for w in again} if len(again) <= most else {}


class Counter:
    """Counts of words that a Python worker has met, each with the space before it.

    Pre-tokens never go over a single space between two characters that are no white
    space, so a text may be cut there.
    """

    def __init__(self, ranks: str, pattern: str) -> None:
        self.trie, self.split = UnigramTrie(read_ranks(ranks)), regex.compile(pattern).findall
        self.seen: dict[str, int | None] = {}
        self.again: set[str] = set()

    def pieces(self, pieces: list[str]) -> dict[str, int]:
        """Both counts of pieces of text, through one trie of their pre-tokens."""
        words = [[w.encode("utf-8", "surrogatepass") for w in self.split(p)] for p in pieces]
        sorted_words = sorted({w for ws in words for w in ws})
        n = dict(zip(sorted_words, self.trie.counts(sorted_words)))
        return {p: len(ws) << _SHIFT | sum([n[w] for w in ws]) for p, ws in zip(pieces, words)}

    def texts(self, texts: list[str]) -> list[int]:
        """Both counts of whole texts."""
        if len(self.seen) > MAX_SEEN:
            self.seen, self.again = met_again(self.seen, self.again, MAX_SEEN // 2), set()
        seen = self.seen
        cut = [t.split(" ") for t in texts]
        met = set().union(*cut)
        new = met.difference(seen)
        self.again |= met - new
        odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        found = self.pieces([" " + w for w in new - odd])
        seen.update((p[1:], c) for p, c in found.items())
        seen.update(dict.fromkeys(odd))  # None: cannot be cut off
        heads = [c[0] if c[0] and not c[0][-1].isspace() else None for c in cut]
        first = self.pieces(list({h for h in heads if h is not None}))
        out = []
        for text, words, head in zip(texts, cut, heads):
            try:
                if head is None:
                    raise TypeError
                out.append(first[head] + sum(map(seen.__getitem__, words[1:])))
            except TypeError:
                parts = _BREAK.split(text)
                parts = parts[:1] + [" " + p for p in parts[1:]]
                n = self.pieces(list(set(parts)))
                out.append(sum(n[p] for p in parts))
        return out


@cache
def task_counter(ranks: str, pattern: str) -> Counter:
    """The counter of this Python worker, shared by the tasks that it runs."""
    return Counter(ranks, pattern)


def count_tokens(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens of the whole text.

    ``ranks`` is the path of the vocabulary, ``pattern`` splits texts into pre-tokens.
    Null and empty texts count 0; null ids are kept; repeated rows are counted each; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = task_counter(ranks, pattern)
        for batch in batches:
            both = []
            for start in range(0, batch.num_rows, TEXTS):
                both += counter.texts(batch.column(1).slice(start, TEXTS).to_pylist())
            counts = [[n >> _SHIFT for n in both], [n & ((1 << _SHIFT) - 1) for n in both]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n, pa.int64()) for n in counts)],
                names=["doc_id", "n_pretokens", "n_tokens"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
