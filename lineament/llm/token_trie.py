"""Token counts by dynamic programming over a trie.

A unigram model gives each piece of a vocabulary a log-probability; a word's
tokens are its most probable segmentation.  Words that begin alike share the
work: distinct words are put into a trie whose nodes keep the best score of the
prefix they stand for, found once from the scores of the nodes above.  The count
of tokens on the best path is kept where a word ends.  Texts are then sums over
their words.

The vocabulary is a public one and isn't trained.  Its file has merge ranks and
no probabilities, so those are estimated: how often each piece occurs in all of
the texts, as the file's own tokenizer cuts them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineament.llm.words import bounded, pieces, trim

#: Distinct words and trie nodes that a task keeps; beyond them it begins anew, which changes no count.
WORDS, NODES = 250_000, 400_000
SPACE = "▁"


class Model:
    """Scores of pieces, by text, and what a character outside of them costs.

    `back` is the pieces' trie read from their ends: by last character, a node
    of two: the score of the piece that ends here, or None, and the characters before.
    """

    def __init__(self, scores: dict[str, float], unknown: float | None = None):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - 10 if unknown is None else unknown
        self.back: dict[str, list] = {}
        for piece, score in scores.items():
            at, node = self.back, None
            for c in reversed(piece):
                node = at.setdefault(c, [None, {}])
                at = node[1]
            if node is not None:
                node[0] = score


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def text_pieces(path: str) -> dict[int, str]:
    """The pieces of text of a sentencepiece file; bytes, controls and the unknown piece are none."""
    p = _processor(path)
    return {i: p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))}


def _piece_counts(path: str, text: str):
    def run(batches):
        p, words, counts = _processor(path), Counter(), Counter()

        def cut():
            for ids, n in zip(p.encode([*words], num_threads=1), words.values()):
                for i in ids:
                    counts[i] += n
            words.clear()

        for b in pieces(batches, text):
            for t in b.column(text).to_pylist():
                words.update((t or "").split())
            if len(words) > WORDS:
                cut()
        cut()
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], names=["piece", "n"])
        trim()

    return run


def estimated_model(docs: DataFrame, path: str, text: str = "text") -> Model:
    """log((n + 1) / (N + V)) for each of the V pieces of text, n its occurrences in all texts and N their sum.

    A task counts distinct words and cuts each once; no more than the
    vocabulary's rows reach the driver.
    """
    rows = bounded(docs).select(text).mapInArrow(_piece_counts(path, text), "piece long, n long")
    known = text_pieces(path)
    found = {r["piece"]: r["n"] for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    total = sum(found.get(i, 0) for i in known) + len(known)
    return Model({piece: math.log((found.get(i, 0) + 1) / total) for i, piece in known.items()})


class Trie:
    """Words seen so far; by node, the best score of its prefix and the tokens on that path."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        #: (node << 21 | character) -> node
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        """Tokens of a word; a character that no piece covers counts as its UTF-8 bytes.

        Of segmentations with the same score the one with fewer tokens counts.
        """
        child, score, tokens = self.child, self.score, self.tokens
        path, node = [0], 0
        for end, c in enumerate(word):
            key = node << 21 | ord(c)
            node = child.get(key)
            if node is None:
                node = child[key] = len(score)
                s, t = self._best(word, end, c, path)
                score.append(s)
                tokens.append(t)
            path.append(node)
        return tokens[node]

    def _best(self, word: str, end: int, c: str, path: list[int]) -> tuple[float, int]:
        model, score, tokens = self.model, self.score, self.tokens
        last = path[end]
        best, fewest = -math.inf, 0
        if c not in model.scores:
            best, fewest = score[last] + model.unknown, tokens[last] + len(c.encode("utf-8", "replace"))
        at, start = model.back.get(c), end
        while at is not None:
            if at[0] is not None:
                s, t = score[path[start]] + at[0], tokens[path[start]] + 1
                if s > best or s == best and t < fewest:
                    best, fewest = s, t
            start -= 1
            at = at[1].get(word[start]) if start >= 0 else None
        return best, fewest


def _counted(model: Model, names: list[str], text: str):
    def run(batches):
        trie, known = Trie(model), {}
        for b in pieces(batches, text):
            rows = [(t or "").split() for t in b.column(text).to_pylist()]
            if len(known) > WORDS:
                known.clear()
            if len(trie.score) > NODES:
                trie.clear()
            for w in {w for r in rows for w in r if w not in known}:
                known[w] = trie.count(SPACE + w)
            words = np.array([len(r) for r in rows], np.int64)
            tokens = np.array([sum(map(known.__getitem__, r)) for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(words), pa.array(tokens)], names=[*names, "__n_pretokens", "__n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs without the text, with __n_pretokens and __n_tokens of the whole text.

    Pre-tokens are what white space separates, each with the sign for a space
    before it.  Counts are those of the most probable segmentation under
    estimated_model(), not those of the file's own tokenizer.  A null text has
    none, nor has an empty one; rows that repeat each count, in the estimate
    too; an empty table gives no rows; a text of any length is counted whole.  A
    task keeps one trie of its distinct words, of bounded size, and there is no
    shuffle but of the vocabulary's counts.  A column of docs named like one of
    the two results is replaced by it.
    """
    names = [n for n in docs.columns if n != text and n.lower() not in ("__n_pretokens", "__n_tokens")]
    shape = T.StructType([*(docs.schema[n] for n in names), T.StructField("__n_pretokens", T.LongType()), T.StructField("__n_tokens", T.LongType())])
    return bounded(docs).select(*names, text).mapInArrow(_counted(estimated_model(docs, model_path, text), names, text), shape)
