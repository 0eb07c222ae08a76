"""Word-piece token counts with a linear longest-match automaton.

The vocabulary is a trie with one root for pieces that begin a word and one
for pieces that continue it.  A failure link leads from a node to the node
that is reached once the pieces matched so far are popped; how many pieces
that pops is stored with the link.  One pass over a word's characters, with
the popped counts added up, gives the number of greedy longest-match pieces
without building a piece.

Words are runs of letters, digits and underscores, or single other
characters; white space separates and is dropped.  A word that greedy matching cannot
cover counts as one unknown token.  There is no limit on a word's length.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_WORD = re.compile(r"\w+|[^\w\s]")


def load_pieces(path: str, word_mark: str = "▁") -> tuple[list[str], list[str]]:
    """(starting, continuing) pieces of a sentence-piece model file: those with
    the word mark begin a word, the others continue one.  Control, unknown
    and byte entries are no pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    start, inner = [], []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        if piece.startswith(word_mark):
            start.append(piece[len(word_mark):])
        else:
            inner.append(piece)
    # a single character may stand alone as well as continue a word
    start += [p for p in inner if len(p) == 1]
    return sorted({p for p in start if p and word_mark not in p}), sorted({p for p in inner if p and word_mark not in p})


class Automaton:
    """step[node] maps a character to the next node; fail[node] is the failure
    link (None: the word can't be covered) and popped[node] the number of
    pieces that following it completes."""

    START, INNER = 0, 1

    def __init__(self, starting: list[str], continuing: list[str]):
        self.step: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((self.START, starting), (self.INNER, continuing)):
            for piece in pieces:
                node = root
                for ch in piece:
                    if ch not in self.step[node]:
                        self.step[node][ch] = len(self.step)
                        self.step.append({})
                        whole.append(False)
                    node = self.step[node][ch]
                whole[node] = True
        self.fail: list[int | None] = [None] * len(self.step)
        self.popped = [0] * len(self.step)
        layer = [self.START, self.INNER]
        while layer:  # by depth: a link depends on shorter prefixes only
            below = []
            for parent in layer:
                for ch, node in self.step[parent].items():
                    below.append(node)
                    if whole[node]:
                        self.fail[node], self.popped[node] = self.INNER, 1
                        continue
                    at, n = self.fail[parent], self.popped[parent]
                    while at is not None and ch not in self.step[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at is not None:
                        self.fail[node], self.popped[node] = self.step[at][ch], n
            layer = below

    def count(self, word: str) -> int:
        """Greedy pieces of a word; 0 if it can't be covered."""
        step, fail, popped = self.step, self.fail, self.popped
        node = n = 0
        for ch in word:
            nxt = step[node].get(ch)
            while nxt is None:
                n += popped[node]
                node = fail[node]
                if node is None:
                    return 0
                nxt = step[node].get(ch)
            node = nxt
        while node != self.INNER:
            n += popped[node]
            node = fail[node]
            if node is None:
                return 0
        return n


def token_counts(docs: DataFrame, pieces: tuple[list[str], list[str]], *, text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id",), cache_words: int = 400_000) -> DataFrame:
    """``keep`` columns with n_words, n_tokens and n_unknown (long) per row.

    A null text counts as empty (all zero).  Rows are independent, so equal
    rows give equal counts and nothing is shuffled.  The pieces (a public
    vocabulary, bounded by its file) are broadcast; a worker keeps the counts
    of up to ``cache_words`` words at a time, which changes no result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    state: dict = {}

    def count(batches):
        if "automaton" not in state:
            state["automaton"] = Automaton(*shared.value)
        matched = state["automaton"].count
        known: dict[str, int] = {}
        for pdf in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in pdf.pop("_text"):
                words = _WORD.findall(text) if text else []
                if len(known) > cache_words:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = matched(w)
                got = [known[w] for w in words]
                unknown = got.count(0)
                n_words.append(len(words))
                n_tokens.append(sum(got) + unknown)
                n_unknown.append(unknown)
            yield pdf.assign(n_words=n_words, n_tokens=n_tokens, n_unknown=n_unknown)

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInPandas(count, f"{schema}, n_words long, n_tokens long, n_unknown long")
