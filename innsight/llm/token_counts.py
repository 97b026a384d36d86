"""Token counts under a unigram model, by dynamic programming over a trie.

A text is cut into pre-tokens; the token count of a pre-token is the number of
pieces on its best segmentation (highest sum of piece scores, then fewest
pieces).  Distinct pre-tokens are inserted in a trie of bytes.  The best score
of a prefix depends on the prefix alone, so it is computed once per trie node,
from the nodes above it, and shared by every pre-token that starts with it.
The node where a pre-token ends stores its count; a text's count is the sum
over its pre-tokens.

Texts are taken in batches of ``BATCH_BYTES``.  A worker remembers the counts of
the pre-tokens it has met and puts only new ones into a trie, which is scored
depth by depth with whole-array operations in parts of ``CELLS`` bytes; it
forgets them beyond ``MAX_KNOWN`` (memory stays bounded, counts do not depend on
it).  A pre-token longer than ``LONG`` bytes gets the same recurrence without a
trie.  Nothing is shuffled.

Scores: the vocabulary's merge ranks under Zipf's law (log of 1 / (rank x
harmonic number)); the 256 single bytes, which make every text segmentable, come
after all merges.

Defined results: null or empty text has 0 pre-tokens and 0 tokens; repeated
rows are counted each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.util import POWERS, batches_of_bytes

MAX_KNOWN = 1_000_000
BATCH_BYTES = 4 << 20
CELLS = 1 << 20
LONG = 2048


def zipf_scores(path: str) -> dict[bytes, float]:
    """Scores of the pieces of a rank file (base64 piece and rank a line)."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(a) for a, _ in sorted((line.split() for line in f if line.strip()), key=lambda x: int(x[1]))]
    order = [p for p in pieces if len(p) > 1] + [bytes([b]) for b in range(256)]
    norm = math.log(sum(1 / r for r in range(1, len(order) + 1)))
    return {p: -math.log(r) - norm for r, p in enumerate(order, 1)}


class PretokenTrie:
    """Token counts of pre-tokens; new ones are scored together, over their trie."""

    def __init__(self, scores: dict[bytes, float], max_known: int = MAX_KNOWN):
        self.known: dict[str, int] = {}  # pre-token -> count at its terminal node
        self._max = max_known
        # Scores of the pieces, and -inf for endings of pieces that are none: the look back stops at what is neither.
        tails = {p[i:]: -math.inf for p in scores for i in range(len(p))} | scores
        self._tails, self._longest = tails, max(map(len, tails))
        raw = b"".join(tails)
        ends = np.cumsum([len(t) for t in tails])
        table, width = _padded(raw, ends)
        keys = _prefix_hashes(table)[np.arange(len(width)), width]
        order = np.argsort(keys)
        self._keys, self._values = keys[order], np.array(list(tails.values()))[order]
        if (self._keys[1:] == self._keys[:-1]).any():
            raise ValueError("two piece endings share a hash")

    def add(self, pretokens: set[str]) -> None:
        """Learn the counts of ``pretokens`` that are not known."""
        if len(self.known) > self._max:
            self.known.clear()
        new = sorted((w.encode(), w) for w in pretokens if w not in self.known)
        self.known.update((w, self._score_long(raw)) for raw, w in new if len(raw) > LONG)
        new = [x for x in new if len(x[0]) <= LONG]
        chunk, size = [], 0
        for raw, word in new:
            width = max(size, len(raw))
            if chunk and (len(chunk) + 1) * width > CELLS:
                self._score(chunk)
                chunk, width = [], len(raw)
            chunk.append((raw, word))
            size = width
        if chunk:
            self._score(chunk)

    def _score_long(self, raw: bytes) -> int:
        """The same recurrence for one very long pre-token, without a trie."""
        best, count = [0.0], [0]
        for end in range(1, len(raw) + 1):
            top, pieces = -math.inf, 0
            for start in range(end - 1, -1, -1):
                s = self._tails.get(raw[start:end])
                if s is None:
                    break
                s += best[start]
                if s > top or s == top and count[start] + 1 < pieces:
                    top, pieces = s, count[start] + 1
            best.append(top)
            count.append(pieces)
        return count[-1]

    def _score(self, words: list[tuple[bytes, str]]) -> None:
        """Forward scores of the trie of ``words`` (sorted), depth by depth: each node once."""
        table, width = _padded(b"".join(r for r, _ in words), np.cumsum([len(r) for r, _ in words]))
        hashes = _prefix_hashes(table)
        n, deepest = len(words), int(width.max())
        same = (table[1:] == table[:-1]) & (np.arange(deepest) < np.minimum(width[1:], width[:-1])[:, None])
        shared = np.concatenate([[-1], np.where(same.all(1), deepest, same.argmin(1))])  # common prefix with the word before
        best, count = np.full((n, deepest + 1), -np.inf), np.zeros((n, deepest + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, deepest + 1):
            live = np.flatnonzero(width >= end)
            is_new = shared[live] < end
            node = live[is_new]  # the first word through each node at this depth
            top, pieces = np.full(len(node), -np.inf), np.zeros(len(node), np.int64)
            at, look = np.arange(len(node)), node
            for length in range(1, min(end, self._longest) + 1):
                start = end - length
                key = hashes[look, end] - hashes[look, start] * POWERS.upto(length + 1)[length]
                slot = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
                hit = self._keys[slot] == key
                at, look, slot = at[hit], look[hit], slot[hit]
                if not len(at):
                    break
                s = best[look, start] + self._values[slot]
                k = count[look, start] + 1
                better = (s > top[at]) | (s == top[at]) & (k < pieces[at])
                top[at[better]], pieces[at[better]] = s[better], k[better]
            group = np.cumsum(is_new) - 1
            best[live, end], count[live, end] = top[group], pieces[group]
        self.known.update(zip((w for _, w in words), count[np.arange(n), width].tolist()))


def _padded(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words laid side by side in ``raw`` as rows of a zero-padded table, and their lengths."""
    width = np.diff(ends, prepend=0)
    table = np.zeros((len(width), int(width.max())), np.uint8)
    table[np.arange(table.shape[1]) < width[:, None]] = np.frombuffer(raw, np.uint8)
    return table, width


def _prefix_hashes(table: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of every prefix of every row."""
    out = np.zeros((table.shape[0], table.shape[1] + 1), np.uint64)
    base = POWERS.upto(2)[1]
    for i in range(table.shape[1]):
        out[:, i + 1] = out[:, i] * base + table[:, i].astype(np.uint64) + np.uint64(1)
    return out


@lru_cache(maxsize=2)
def _worker_trie(path: str) -> PretokenTrie:
    return PretokenTrie(zipf_scores(path))


def token_counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_pretokens, n_tokens (longs)."""

    def run(batches: Iterator) -> Iterator:
        import public_tokenizers
        import pyarrow as pa
        import regex

        trie, split = _worker_trie(ranks_path), regex.compile(public_tokenizers.PATTERN).findall
        for b in batches_of_bytes(batches, "_text", BATCH_BYTES):
            found = [split(cell.as_py() or "") for cell in b.column(1)]
            trie.add(set().union(*found))
            tokens = [sum(map(trie.known.__getitem__, words)) for words in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, found), pa.int64()), pa.array(tokens, pa.int64())], ["_id", "n_pretokens", "n_tokens"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([source.schema["_id"], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
