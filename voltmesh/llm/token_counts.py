"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens (operator 8).

The distinct pre-tokens are sorted over ranges of words, so that a task walks its part of their trie depth first: forward scores of
a shared prefix stay on a stack, over batches too, and are computed once; the count at a pre-token's end is its terminal count.
The vocabulary is that of a tokenizer file; the probabilities of its pieces are fitted here, on all distinct pre-tokens weighted by how often they
stand in the corpus, by ROUNDS rounds of Viterbi training over the same walk. Counts then meet the documents through the distinct-word table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, flat, strings
from .words import HOT, WordTable, row_key, word_counts

SPACE = "▁"
#: Rounds of training from the starting scores.
ROUNDS = 2


class Unigram:
    """Pieces of a sentencepiece vocabulary and their log probabilities.

    Its file orders pieces by frequency but has ranks for scores; training starts from Zipf's law over them: a piece of rank r
    (from 1) has the probability 1 / (r * H), H the sum of 1 / r. ``fitted`` gives the model of counts of pieces, each
    raised by one. A character without a piece is spelled in UTF-8 bytes, each a token of the least likely piece's score less ``penalty``.
    """

    def __init__(self, path: str, penalty: float = 10.0):
        known = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [known.id_to_piece(i) for i in range(known.get_piece_size()) if not (known.is_control(i) or known.is_unknown(i) or known.is_byte(i))]
        total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
        self.penalty = penalty
        self._set({p: -math.log(r) - total for r, p in enumerate(pieces, 1)})
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another character: texts cannot be cut before spaces")
        inner = {c for p in pieces if len(p) > 1 for c in p}
        #: ASCII characters that no longer piece holds: a pre-token of their own.
        self.alone = [c for c in range(128) if chr(c) not in inner and chr(c) != " "]

    def _set(self, score: dict[str, float]) -> None:
        self.score, self.byte = score, min(score.values()) - self.penalty

    def fitted(self, counts: dict[str, int]) -> Unigram:
        """This model with the probabilities of pieces that were counted so often."""
        total = math.log(sum(counts.values()) + len(self.score))
        made = object.__new__(Unigram)
        made.penalty, made.alone = self.penalty, self.alone
        made._set({p: math.log(counts.get(p, 0) + 1) - total for p in self.score})
        return made


class Walk:
    """Best scores of words that come one by one: what a word shares with the one before it is on the stack and not computed again."""

    def __init__(self, model: Unigram):
        self.model, self.before, self.computed = model, "", 0
        self.tails = {p[i:] for p in model.score for i in range(len(p))}
        # of each prefix: best score, the fewest tokens at that score, where the last token begins
        self.top, self.tokens, self.back = [0.0], [0], [0]

    def to(self, word: str) -> int:
        """Tokens of a pre-token (spaces in it count as the piece alphabet's space mark): the best score, then the fewest tokens."""
        word = word.replace(" ", SPACE)
        top, tokens, back, score, tails, byte = self.top, self.tokens, self.back, self.model.score, self.tails, self.model.byte
        shared = 0
        for a, b in zip(self.before, word, strict=False):
            if a != b:
                break
            shared += 1
        del top[shared + 1 :], tokens[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, fewest, begin = -math.inf, 0, end - 1
            start = end - 1
            while start >= 0 and (part := word[start:end]) in tails:  # beyond that no piece ends here
                s = score.get(part)
                if s is not None:
                    s += top[start]
                    if s > best or s == best and tokens[start] + 1 < fewest:
                        best, fewest, begin = s, tokens[start] + 1, start
                start -= 1
            if word[end - 1] not in score:
                size = len(word[end - 1].encode("utf-8", "replace"))
                s = top[end - 1] + size * byte
                if s > best:
                    best, fewest, begin = s, tokens[end - 1] + size, end - 1
            top.append(best)
            tokens.append(fewest)
            back.append(begin)
        self.computed += len(word) - shared
        self.before = word
        return tokens[-1]

    def pieces(self) -> list[str]:
        """The pieces of the word at hand, the last first; bytes are left out."""
        out, end = [], len(self.before)
        while end:
            start = self.back[end]
            if (part := self.before[start:end]) in self.model.score:
                out.append(part)
            end = start
        return out


def fit(counts: DataFrame, model: Unigram, rounds: int = ROUNDS) -> Unigram:
    """The model trained on (word, n) rows, all of them in each round: what comes back to the driver is a count of each piece of the vocabulary."""
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary

        def used(batches, shared=shared):
            walk, found = Walk(shared.value), {}
            for batch in batches:
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    walk.to(word)
                    for p in walk.pieces():
                        found[p] = found.get(p, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        total = counts.mapInArrow(used, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        model = model.fitted(dict(zip(total.column("piece").to_pylist(), total.column("n").to_pylist(), strict=True)))
        shared.unpersist()
    return model


class PreTokens:
    """Cuts texts before each run of spaces and around the characters that no piece joins; a space opens each text."""

    def __init__(self, alone: list[int]):
        self.alone = np.zeros(256, bool)
        self.alone[alone] = True

    def __call__(self, column: pa.Array):
        body, at = flat(column)
        sizes = np.diff(at)
        more = (sizes > 0).astype(np.int64)
        to = np.concatenate([[0], np.cumsum(sizes + more)])
        text = np.full(to[-1], 32, np.uint8)
        own = np.ones(to[-1], bool)
        own[to[:-1][sizes > 0]] = False
        text[own] = body
        before = np.concatenate([[0], text[:-1]]).astype(np.uint8) if len(text) else text
        start = ((text == 32) & (before != 32)) | self.alone[text] | self.alone[before]
        start[to[:-1][sizes > 0]] = True
        begin = np.flatnonzero(start)
        counts = np.diff(np.searchsorted(begin, to))
        yield np.arange(len(sizes)), strings(text, np.append(begin, len(text))), counts


def count_tokens(docs: DataFrame, path: str, text: str = "text", hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """docs without the text, with n_pretokens and n_tokens (long) of the whole text.

    Null and empty texts have none; repeated rows stay; an empty table gives an empty one; an input column named like an
    added one (or ``rest``, ``known``, ``far``) raises ValueError. Probabilities follow the corpus given, so counts of one text can differ between corpora.
    """
    if both := {"n_pretokens", "n_tokens", "rest", "known", "far"} & set(docs.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
    scratch = Scratch(docs.sparkSession, "tokens")
    model = Unigram(path)
    alone = model.alone
    split = lambda: PreTokens(alone)
    counts = scratch.save(word_counts(docs, text, split).repartitionByRange("word").sortWithinPartitions("word"), "counts")
    shared = docs.sparkSession.sparkContext.broadcast(fit(counts, model, rounds))

    def encoder():
        walk = Walk(shared.value)
        return lambda words: pa.array([walk.to(w) for w in words], pa.int64())

    words = WordTable(docs, text, split, encoder, "long", scratch, hot, counts)
    source = docs.select("*", row_key(docs).alias("__key"))

    def emit(codes, ends, values):
        own = np.concatenate([values.to_numpy(zero_copy_only=False).astype(np.int64), [0]])[codes]
        reach = np.concatenate([[0], np.cumsum(own)])[ends]
        return [pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(reach), pa.int64())]

    coded = words.coded(source, emit, "n_pretokens long, known long")
    # repeated rows share a key: their other words count once for each of them
    rest = words.far(source, "__key").groupBy(F.col("__key").alias("__far")).agg((F.sum("value") / F.count_if(F.col("pos") == 0)).cast("long").alias("far"))
    joined = coded.drop("rest").join(rest, F.col("__key") == F.col("__far"), "left")
    return joined.withColumn("n_tokens", F.col("known") + F.coalesce("far", F.lit(0))).drop("known", "far", "__key", "__far")
