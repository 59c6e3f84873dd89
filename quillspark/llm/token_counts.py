"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary matches that end at each
character; the dynamic program carries the best score and its number of pieces
only, no path. Ties go as in the tokenizers library's unigram model: the match
that starts first stays unless another's score is strictly higher, an unknown
character costs the lowest score less 10, runs of unknown characters and of the
unknown piece's own text fuse, and fused runs count as their bytes, or as one if a piece has
their text. No piece crosses the start of a word, and scores
are whole numbers, so sums are exact in doubles and each distinct word is counted
once in a worker.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import SPACE, CodeBook, flat_text, spaced_words, steps, tidy

UNKNOWN_PENALTY = 10.0
#: Bytes of text that one step counts.
STEP_TEXT = 1 << 20


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a SentencePiece file, taken as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(len(model))]


class Counter:
    """Counts pieces of texts under a unigram vocabulary with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0) -> None:
        import ahocorasick

        if any(s != int(s) for _, s in pieces) or SPACE not in dict(pieces) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces):
            raise ValueError("scores must be whole numbers, and the space mark a piece that stands only at the start of others")
        self.score = dict(pieces)
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in self.score.items():
            self.automaton.add_word(p, (len(p), s, p == pieces[unknown_id][0]))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.score))
        self.book = CodeBook(np.int64)  # pieces and score of each word

    def viterbi(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best path."""
        n = len(word)
        best, pieces, run = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # run: unknown characters at the path's end
        done, single = 0, False
        reached = [True] + [False] * n
        at = [0, *itertools.accumulate(1 if c < "\x80" else len(c.encode()) for c in word)]

        def fused(start: int, end: int) -> int:
            """Pieces of a run of unknown characters: one if it is in the vocabulary, else its bytes."""
            if start == end:
                return 0
            return 1 if end - start <= self.longest and word[start:end] in self.score else at[end] - at[start]

        def unknown(end: int) -> None:
            score = best[end - 1] + self.unknown
            if not reached[end] or score > best[end]:
                start = end - 1 - run[end - 1]
                best[end], pieces[end], run[end], reached[end] = score, pieces[end - 1] - fused(start, end - 1) + fused(start, end), end - start, True

        for last, (length, s, is_unknown) in self.automaton.iter(word):
            end = last + 1
            while done < end - 1:  # positions where a single character has no match
                done += 1
                if not single:
                    unknown(done)
                single = False
            score = best[end - length] + s
            if not reached[end] or score > best[end]:
                best[end], pieces[end], run[end], reached[end] = score, pieces[end - length] + 1, 0, True
                if is_unknown:  # its text joins a run of unknown characters
                    start = end - length - run[end - length]
                    pieces[end], run[end] = pieces[end - length] - fused(start, end - length) + fused(start, end), end - start
            if length == 1:
                single = True
        while done < n:
            done += 1
            if not single:
                unknown(done)
            single = False
        return pieces[n], best[n]

    def _of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.viterbi(w.decode().replace(" ", SPACE)) for w in words]
        return np.array(found, np.float64).astype(np.int64).ravel(), np.full(len(words), 2)

    def count(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each text; null counts as empty."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        found, counts = spaced_words(texts)
        both, _ = self.book.look_up(found, self._of_words)
        total = np.r_[np.zeros((1, 2), np.int64), np.cumsum(both.reshape(-1, 2), axis=0)][np.r_[0, np.cumsum(counts)]]
        total = np.diff(total, axis=0)
        return total[:, 0], total[:, 1].astype(np.float64)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The vocabulary of a file, loaded once in each worker."""
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) for each row of ``docs``.

    Null and empty texts have no tokens and score 0; repeated and null ids are
    counted row by row; other columns aren't read; an empty table gives none. No
    shuffle.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType(), False), T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in tidy(batches, c.book):
            _, offsets = flat_text(batch.column(1))
            for a, b in steps(offsets, STEP_TEXT):
                n, score = c.count(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(score)], names=[id_col, "n_tokens", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
