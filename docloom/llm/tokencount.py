"""Token counts under a unigram model, by dynamic programming shared along a trie.

Pieces and their order come from a public sentencepiece vocabulary; a piece's probability
follows its rank (Zipf-Mandelbrot).  The best segmentation of a pre-token ends in pieces of
its last characters, so its forward scores for a prefix hold for every pre-token that starts
with it.  Distinct pre-tokens are walked in sorted order, which is a depth-first walk of
their trie: scores of the shared prefix stay, only the new characters are computed, and the
count at the last character is kept for the pre-token.

Defined cases: a null text has no pre-tokens and no tokens; a character that no piece has
counts as its UTF-8 bytes; of equally good segmentations the one of fewer tokens counts;
repeated rows count alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Shift of the rank in the Zipf-Mandelbrot law.
RANK_SHIFT = 2.7
#: What a fallback byte scores below the least likely piece.
BYTE_PENALTY = 10.0
#: Start mark of a pre-token in the vocabulary.
MARK = "▁"
#: Pre-tokens that a Python worker remembers with their counts; the table is emptied when it is full.
PRE_TOKENS_KEPT = 500_000
#: Characters of text whose pre-tokens are counted together.
TEXT_AT_ONCE = 4_000_000


class Unigram:
    """Scores of pieces, and counts of pre-tokens found so far."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        size = pieces.GetPieceSize()
        usable = [i for i in range(size) if not (pieces.IsByte(i) or pieces.IsControl(i) or pieces.IsUnknown(i) or pieces.IsUnused(i))]
        ranked = sorted(usable, key=lambda i: (-pieces.GetScore(i), i))
        whole = math.log(sum(1 / (r + RANK_SHIFT) for r in range(len(ranked))))
        self.scores = {pieces.IdToPiece(i): -math.log(r + RANK_SHIFT) - whole for r, i in enumerate(ranked)}
        self.longest = max(map(len, self.scores), default=1)
        self.byte = min(self.scores.values(), default=0.0) - BYTE_PENALTY
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.found = np.zeros(0)

    def count(self, ordered: list[str]) -> Iterator[tuple[int, float]]:
        """Tokens and score of each pre-token; the list is sorted, so neighbours share prefixes."""
        scores, longest, byte = self.scores, self.longest, self.byte
        best, tokens, before = [0.0], [0], ""
        for word in ordered:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode())
                top, least = best[end - 1] + n * byte, tokens[end - 1] + n
                for start in range(max(0, end - longest), end):
                    score = scores.get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and tokens[start] + 1 < least:
                            top, least = score, tokens[start] + 1
                best.append(top)
                tokens.append(least)
            before = word
            yield tokens[-1], best[-1]

    def look_up(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        new = sorted((MARK + w.decode(), w) for w in set(words) if w not in index)
        if new:
            n = len(index)
            index.update((w, n + k) for k, (_, w) in enumerate(new))
            found = list(self.count([s for s, _ in new]))
            self.counts = np.concatenate([self.counts, np.array([c for c, _ in found], np.int64)])
            self.found = np.concatenate([self.found, np.array([s for _, s in found])])
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


_MODELS: dict[str, Unigram] = {}


def count_all(texts: list[str | None], model: Unigram) -> list[tuple[int, int, float]]:
    """Pre-tokens, tokens and score of each text."""
    rows: list[tuple[int, int, float]] = []
    start = 0
    while start < len(texts):
        cuts, size = [], 0
        while start + len(cuts) < len(texts) and size < TEXT_AT_ONCE:
            text = texts[start + len(cuts)] or ""
            cuts.append(text.encode().split())
            size += len(text)
        if len(model.index) > PRE_TOKENS_KEPT:
            model.clear()
        at = model.look_up([w for c in cuts for w in c])
        last = 0
        for cut in cuts:
            own = at[last : last + len(cut)]
            last += len(cut)
            rows.append((len(cut), int(model.counts[own].sum()), float(model.found[own].sum())))
        start += len(cuts)
    return rows


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(path) or _MODELS.setdefault(path, Unigram(path))
        for batch in batches:
            rows = count_all(batch.column(1).to_pylist(), model)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and score (log-probability of the best segmentation) of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_counted(model), f"doc_id {kind}, n_pretokens bigint, n_tokens bigint, score double")
