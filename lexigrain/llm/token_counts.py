"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie.  Every node that can't go on has a failure link: the
pieces that greedy longest match would cut from the node's text are popped, and
the link leads to the node of what is left.  Only the number of popped pieces is
kept at a node, so a text is counted in one pass, without building pieces or
going back.  A word that can't be cut into pieces counts as one unknown token.

Two kinds of vocabularies: with an end mark (`low</w>`: pieces that end a word,
whose last character is another symbol than inside a word) or with a continuation mark (`##ing`: pieces after the first).

Words are cut from the lower-cased text by ``pattern``; counts of words are kept
by each worker, up to ``CACHE`` of them.

Defined results: null, empty and blank texts have 0 words and tokens; each input
row gives a row; an empty table gives an empty result; a long word costs time in
proportion to its length; other columns are never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
CACHE = 800_000
MARK = "\0"  # follows the last character of a word, as one symbol with it


class Automaton:
    """Nodes are numbers; next[node] maps symbols to nodes."""

    def __init__(self, pieces: list[str], end_mark: str = "", continuation: str = ""):
        self.end_mark = bool(end_mark)
        self.next: list[dict] = [{}]
        self.is_piece = [False]
        self.parent: list[tuple[int, object]] = [(-1, None)]
        self.root = 0
        self.inner = self._node(-1, None) if continuation else 0
        for piece in pieces:
            ended = end_mark and piece.endswith(end_mark)
            text = piece.removesuffix(end_mark) if ended else piece
            start = self.root
            if continuation and text.startswith(continuation):
                start, text = self.inner, text.removeprefix(continuation)
            if text:
                self._add(start, [*text[:-1], text[-1] + MARK] if ended else [*text])
        self._link()

    def _node(self, parent: int, symbol) -> int:
        self.next.append({})
        self.is_piece.append(False)
        self.parent.append((parent, symbol))
        return len(self.next) - 1

    def _add(self, node: int, symbols: list) -> None:
        for s in symbols:
            if s not in self.next[node]:
                self.next[node][s] = self._node(node, s)
            node = self.next[node][s]
        self.is_piece[node] = True

    def _link(self) -> None:
        """Failure links, breadth first: fail[node] (-1: none) and the pieces popped on the way."""
        size = len(self.next)
        self.fail, self.popped = [-1] * size, [0] * size
        level = [n for start in {self.root, self.inner} for n in self.next[start].values()]
        while level:
            for v in level:
                u, s = self.parent[v]
                if self.is_piece[v]:
                    self.fail[v], self.popped[v] = self.inner, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and s not in self.next[z]:
                    z, n = self.fail[z], n + self.popped[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][s], n
            level = [n for v in level for n in self.next[v].values()]

    def count(self, word: str) -> int:
        """Pieces of a word; -1: it has none."""
        node, n, following = self.root, 0, self.next
        for s in [*word[:-1], word[-1] + MARK] if self.end_mark and word else word:
            while s not in following[node]:
                if self.fail[node] < 0:
                    return -1
                n += self.popped[node]
                node = self.fail[node]
            node = following[node][s]
        while node not in (self.root, self.inner):
            if self.fail[node] < 0:
                return -1
            n += self.popped[node]
            node = self.fail[node]
        return n


def byte_symbols() -> dict[int, str]:
    """The visible character of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[list[str], str]:
    """Pieces and end mark of a tokenizer file in JSON."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return list(model["vocab"]), model.get("end_of_word_suffix") or ""


def count_tokens(docs: DataFrame, pieces: list[str], *, end_mark: str = "", continuation: str = "", byte_level: bool = False, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown (words) of every document; the vocabulary is a few MB and broadcast."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((pieces, end_mark, continuation))
    key = ("automaton", hash((tuple(pieces), end_mark, continuation, byte_level, pattern)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cache = worker_cache()
        if key not in cache:
            cache[key] = (Automaton(*shared.value), regex.compile(pattern).findall, {})
        automaton, cut, known = cache[key]
        visible = byte_symbols()

        def of(word: str) -> int:
            n = automaton.count("".join(map(visible.__getitem__, word.encode("utf-8", "replace"))) if byte_level else word)
            known[word] = n
            return n

        def run(text: str) -> tuple[int, int, int]:
            """Words, tokens and unknown words between two white spaces."""
            counts = [known[w] if w in known else of(w) for w in cut(text)]
            bad = counts.count(-1)
            made = known[" " + text] = (len(counts), sum(counts) + 2 * bad, bad)
            return made

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if len(known) > CACHE:
                    known.clear()
                n = [0, 0, 0]
                for r in text.lower().split() if text else ():
                    a, b, c = known.get(" " + r) or run(r)
                    n[0] += a
                    n[1] += b
                    n[2] += c
                out.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in range(3))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return source.mapInArrow(scan, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
