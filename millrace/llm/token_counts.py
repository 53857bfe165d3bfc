"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenizing takes, at each place of a word, the longest vocabulary piece
that fits. The vocabulary's trie is extended by failure links: where the trie has no edge
for the next character, the link says in which state matching goes on, and how many pieces
are popped on the way. Both are computed once, breadth first, so a word is counted in one
pass that never looks back and never builds a piece.

The automaton is a few flat arrays whose size the vocabulary bounds; tasks build it once
per Python worker from the vocabulary file. Counting is a map over documents. Words repeat,
so counts of words are kept in a cache that is emptied when it is full.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_arrow

#: Marks the end of a word in the vocabulary file (a fixed value of its format).
END = "</w>"
_WORD = re.compile(WORD)
_CACHE = 200_000


class Automaton:
    """Trie over byte symbols with failure links and popped-piece counts. Pieces of ``free``
    are popped without being counted."""

    def __init__(self, pieces: list[tuple[int, ...]], free: frozenset[tuple[int, ...]] = frozenset()):
        self.edges: list[dict[int, int]] = [{}]
        whole, cost = [False], [1]
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    whole.append(False)
                    cost.append(1)
                at = nxt
            whole[at] = True
            cost[at] = int(piece not in free)
        n = len(self.edges)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = [0]
        for at in queue:
            for c, child in self.edges[at].items():
                queue.append(child)
                if whole[child]:
                    self.fail[child], self.pops[child] = 0, cost[child]
                    continue
                # pieces popped when the string of `at` was cut, and on until c can follow
                z, popped = self.fail[at], self.pops[at]
                while z >= 0 and c not in self.edges[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[child], self.pops[child] = self.edges[z][c], popped

    def count(self, symbols: list[int]) -> int:
        """Pieces of greedy longest match over the symbols; -1 where no piece fits."""
        edges, fail, pops = self.edges, self.fail, self.pops
        at = n = 0
        for c in symbols:
            nxt = edges[at].get(c)
            while nxt is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
                nxt = edges[at].get(c)
            at = nxt
        while at > 0:
            n += pops[at]
            at = fail[at]
        return n if at == 0 else -1


@lru_cache(2)
def automaton(path: str) -> Automaton:
    """From the vocabulary of a tokenizers file whose pieces end words with ``</w>``.

    Pieces are written in the byte alphabet of byte-level files; a piece becomes its bytes,
    and the end of a word the symbol 256. Where no piece takes the end, it counts nothing."""
    alphabet = byte_alphabet()
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    pieces = []
    for piece in vocabulary:
        body, ends = piece.removesuffix(END), piece.endswith(END)
        if body and all(c in alphabet for c in body):
            pieces.append(tuple(alphabet[c] for c in body) + ((256,) if ends else ()))
    pieces += [(b,) for b in range(256)] + [(b, 256) for b in range(256)]
    return Automaton([*pieces, (256,)], frozenset([(256,)]))


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as itself, other bytes as 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text.

    Words are runs of anything but ASCII white space, lower-cased; each is cut greedily
    into the longest pieces; one that ends a word fits only there. Null and empty texts have 0
    of both. Repeated rows and null ids are counted each; very long words take one pass. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    cache: dict[str, int] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = automaton(vocabulary)
        words, tokens = [], []
        for t in batch.column(1).to_pylist():
            found = _WORD.findall(t.lower()) if t else []
            n = 0
            for w in found:
                k = cache.get(w)
                if k is None:
                    k = machine.count([*w.encode("utf-8", "surrogatepass"), 256])
                    if len(cache) >= _CACHE:
                        cache.clear()
                    if len(w) <= 64:
                        cache[w] = k
                n += k
            words.append(len(found))
            tokens.append(n)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, n_words long, n_tokens long")
