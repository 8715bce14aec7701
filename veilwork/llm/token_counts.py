"""Token counts by greedy longest match, without building pieces.

The vocabulary becomes a trie. A node's failure link leads to the node where matching goes on after the
pieces that end inside it are given out, and beside it stands how many pieces those are. One pass over a
word's bytes then gives its number of pieces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.bpe import byte_letters
from veilwork.llm.shared import broadcast_parameter, once_per_worker

#: Words whose count a Python worker keeps; the memory is dropped when it is full.
WORD_MEMORY = 400_000
#: Longer words, in bytes, seldom come again and are not kept.
LONG_WORD = 32


def byte_level_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file of the tokenizers library; a piece that begins with a space begins a word."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    return [bytes(letters[c] for c in piece) for piece in vocab]


class LongestMatch(dict):
    """Counts of words, remembered; a word is matched behind the marker."""

    def __init__(self, pieces: Iterable[bytes], marker: bytes):
        super().__init__()
        self.trie: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    is_piece.append(False)
                node = self.trie[node][c]
            is_piece[node] = node > 0
        # Breadth first: the link of a node needs those of nodes less deep.
        n = len(self.trie)
        self.link, self.popped = [-1] * n, [0] * n
        level = [0]
        while level:
            below = []
            for node in level:
                for c, to in self.trie[node].items():
                    below.append(to)
                    if is_piece[to]:
                        self.link[to], self.popped[to] = 0, 1
                        continue
                    at, popped = self.link[node], self.popped[node]
                    while at >= 0 and c not in self.trie[at]:
                        popped += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[to], self.popped[to] = self.trie[at][c], popped
            level = below
        self.start, self.start_count = self._walk(0, marker)

    def _walk(self, node: int, text: bytes) -> tuple[int, int]:
        trie, link, popped = self.trie, self.link, self.popped
        count = 0
        for c in text:
            to = trie[node].get(c, -1)
            while to < 0:
                count += popped[node]
                node = link[node]
                if node < 0:
                    return -1, 0
                to = trie[node].get(c, -1)
            node = to
        return node, count

    def __missing__(self, word: bytes) -> int:
        """The number of pieces; a word that greedy matching cannot cover is one unknown token."""
        node, count = self._walk(self.start, word) if self.start >= 0 else (-1, 0)
        if node >= 0:
            count += self.start_count
            while node > 0:
                count += self.popped[node]
                node = self.link[node]
        out = count if node == 0 else 1
        if len(self) >= WORD_MEMORY:
            self.clear()
        if len(word) <= LONG_WORD:
            self[word] = out
        return out


def count_tokens(df: DataFrame, pieces: Iterable[bytes], text: str = "text", marker: bytes = b" ", words: str = "n_words", tokens: str = "n_tokens") -> DataFrame:
    """Add the number of words (runs of other characters than ASCII white space) and of greedy word pieces.

    Each word is matched behind `marker`, so pieces that begin with it begin words. A word that the pieces
    cannot cover by longest match from the left is one unknown token; no pieces at all make every word
    unknown. Null and empty texts have no words. All rows and other columns stay; columns of the two names
    are replaced. Texts are counted whole, in their own tasks, without a shuffle.
    """
    pieces = sorted(set(pieces))
    digest = hashlib.sha256(b"".join(len(p).to_bytes(4, "big") + p for p in pieces) + marker).hexdigest()
    shared = broadcast_parameter(df.sparkSession, pieces, sum(map(len, pieces)))

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = once_per_worker(("pieces", digest), lambda: LongestMatch(shared.value, marker))
        get = match.__getitem__
        for batch in batches:
            out = np.zeros((2, len(batch)), np.int64)
            for i, v in enumerate(batch):
                if found := (v.as_py() or b"").split():
                    out[0, i], out[1, i] = len(found), sum(map(get, found))
            yield pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["words", "tokens"])

    counts = F.arrow_udf(count, "struct<words:long,tokens:long>")(F.col(f"`{text}`").cast("binary"))
    kept = [c for c in df.columns if c.lower() not in (words.lower(), tokens.lower())]
    both = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), counts.alias("counts"))
    return both.select("row.*", F.col("counts.words").alias(words), F.col("counts.tokens").alias(tokens))
