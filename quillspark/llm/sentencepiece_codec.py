"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A worker splits texts into words (runs of the space mark followed by other
characters; no piece of the vocabulary crosses such a boundary, which is
checked), and encodes each distinct word once. All new words of a batch lie in
one flat symbol array; every round finds each word's best pair by a segmented
minimum of ranks, merges its leftmost occurrence in all words at once, compacts
the array, and drops words that have no pair left. Where no merge gives rise to a
pair of the same or a better rank, all disjoint occurrences in a word merge in one
round, which gives what merging them one by one gives. Words of many
symbols (texts without spaces) are cut, again and again, at boundaries that no
piece of the vocabulary crosses, so that their parts go through the rounds side by
side.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import SPACE, CodeBook, flat_text, mix, odd_powers, ranges, spaced_words, steps, tidy

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_RANK = np.iinfo(np.int32).max
#: Words of more symbols are cut where no piece can cross, before the first round and after every ``CUT_ROUNDS``.
CUT_FROM, CUT_ROUNDS = 64, 16
BASE = 0x5851F42D4C957F2D  # odd

SCHEMA = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


@dataclass
class Merges:
    """Pair table of a BPE vocabulary over symbol numbers."""

    keys: np.ndarray  # left * size + right, ascending
    made: np.ndarray
    rank: np.ndarray  # of each symbol; NO_RANK where it is no result of a merge
    together: np.ndarray  # all occurrences may merge in one round
    size: int

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, or -1."""
        top = self.size - 1  # in no pair
        key = np.minimum(left, top).astype(np.int64) * self.size + np.minimum(right, top)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], -1) if len(self.keys) else np.full(len(key), -1, np.int64)

    def run(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges in all words until none has a pair left; ``word`` ascends."""
        first_word, place = word, np.arange(len(symbols))
        end = place + 1
        sums, back = self._sums(symbols)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rounds = 0
        while len(symbols):
            if rounds % CUT_ROUNDS == 0:
                word = self._cut(word, place, end, sums, back)
            rounds += 1
            made = self.find(symbols[:-1], symbols[1:])
            made[word[:-1] != word[1:]] = -1
            rank = np.full(len(symbols), NO_RANK, np.int32)
            rank[:-1] = np.where(made >= 0, self.rank[made], NO_RANK)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(word)])
            best = np.minimum.reduceat(rank, first)
            live = best < NO_RANK
            made = np.r_[made, -1]
            if not live.all():
                keep = np.repeat(live, count)
                done.append((symbols[~keep], place[~keep]))
                symbols, word, rank, made, place, end = (x[keep] for x in (symbols, word, rank, made, place, end))
                best, count = best[live], count[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, count))
            segment = np.repeat(np.arange(len(count)), count)[hit]
            # every second of a run of touching hits
            new = np.r_[True, segment[1:] != segment[:-1]]
            touch = np.r_[False, (hit[1:] == hit[:-1] + 1) & ~new[1:]]
            start = np.maximum.accumulate(np.where(touch, -1, np.arange(len(hit))))
            even = (np.arange(len(hit)) - start) % 2 == 0
            take, owner, lead = hit[even], segment[even], new[even]
            if not self.together[made[take]].all():
                alone = self._alone(symbols, word, made, take, best[owner])
                mixed = np.zeros(len(count), bool)
                mixed[owner[alone]] = True
                take = take[~mixed[owner] | lead]
            symbols, end = symbols.copy(), end.copy()
            symbols[take], end[take] = made[take], end[take + 1]
            keep = np.ones(len(symbols), bool)
            keep[take + 1] = False
            symbols, word, place, end = (x[keep] for x in (symbols, word, place, end))
        symbols = np.concatenate([s for s, _ in done] or [symbols])
        place = np.concatenate([p for _, p in done] or [place])
        order = np.argsort(place)
        return symbols[order], first_word[place[order]]

    def _alone(self, symbols: np.ndarray, word: np.ndarray, made: np.ndarray, take: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Which merges give rise to a pair of the same or a better rank, so that their word's other hits must wait.

        Leftmost first, a merged symbol meets what is left of it as merged, and what
        is right of it as it was.
        """
        n = len(symbols)
        merged = np.full(n + 1, -1, np.int64)
        merged[take + 1] = made[take]  # where the second of two symbols stood
        before, behind = take - 1, np.minimum(take + 2, n - 1)
        left = np.where(merged[before] >= 0, merged[before], symbols[before])
        found = [self.find(left, made[take]), self.find(made[take], symbols[behind])]
        inside = [(take > 0) & (word[before] == word[take]), (take + 2 < n) & (word[behind] == word[take])]
        return np.logical_or(*(ok & (z >= 0) & (self.rank[z] <= best) for z, ok in zip(found, inside, strict=True)))

    def _sums(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums from which the hash of a range of characters follows, and the inverse powers of its base."""
        n = len(symbols)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(1)) * odd_powers(n, BASE), out=out[1:])
        return out, odd_powers(n, pow(BASE, -1, 1 << 64))

    def know(self, pieces: list[list[int]]) -> None:
        """Takes the vocabulary as rows of character symbols."""
        self.longest = max(map(len, pieces), default=0)
        out = []
        for p in pieces:
            sums, _ = self._sums(np.array(p, np.int64))
            out.append(sums[-1])
        self.pieces = np.unique(np.array(out, np.uint64))

    def _cut(self, word: np.ndarray, place: np.ndarray, end: np.ndarray, sums: np.ndarray, back: np.ndarray) -> np.ndarray:
        """``word`` with long words cut where no piece of the vocabulary crosses, so that their parts merge apart.

        Symbols to come are pieces that begin and end where present symbols do, so
        parts of a word can't meet at a boundary inside none of these. Pieces are
        known by hash: a false hit leaves a boundary uncut, and no result differs.
        """
        change = np.r_[True, word[1:] != word[:-1]]
        first = np.flatnonzero(change)
        count = np.diff(np.r_[first, len(word)])
        if count.max() <= CUT_FROM:
            return word
        inside = np.repeat(count > CUT_FROM, count)
        covered = np.zeros(len(word) + 1, np.int32)
        at = np.flatnonzero(inside)
        for k in range(1, self.longest):
            at = at[at + k < len(word)]
            at = at[(word[at + k] == word[at]) & (end[at + k] - place[at] <= self.longest)]
            if not len(at):
                break
            key = (sums[end[at + k]] - sums[place[at]]) * back[place[at]]
            near = np.minimum(np.searchsorted(self.pieces, key), len(self.pieces) - 1)
            hit = at[self.pieces[near] == key]
            covered[hit] += 1
            np.subtract.at(covered, hit + k, 1)
        open_ = np.cumsum(covered[:-1]) == 0
        change[1:] |= (open_ & inside)[:-1]
        return np.cumsum(change)


class Codec:
    """Encoder and decoder of one SentencePiece BPE model with the identity normaliser."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, spec = model.normalizer_spec, model.trainer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("this codec takes BPE models with an identity normaliser that keeps white space")
        pieces = list(model.pieces)
        if any(p.type in (USER, UNUSED) for p in pieces) or any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in pieces if p.type == NORMAL):
            raise ValueError("this codec takes vocabularies without user-defined or unused pieces, whose pieces hold the space mark only at their start")
        self.prefix = norm.add_dummy_prefix
        self.n = len(pieces)
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.end = next((i for i, p in enumerate(pieces) if p.type == CONTROL and p.piece == "</s>"), None)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.fallback = spec.byte_fallback
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        number = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        chars = {c for p in number for c in p} - number.keys()
        symbol = number | {c: self.n + k for k, c in enumerate(sorted(chars))}
        size = self.n + len(chars) + 1  # the last stands for any other character
        self.other = size - 1
        scores = np.array([p.score for p in pieces], np.float32)
        order = np.unique(-scores)
        rank = np.full(size, NO_RANK, np.int32)
        rank[: self.n] = np.searchsorted(order, -scores)
        table = {symbol[p[:k]] * size + symbol[p[k:]]: i for p, i in number.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        keys = np.array(sorted(table), np.int64)
        made = np.array([table[k] for k in keys.tolist()], np.int64)
        _, back, times = np.unique(rank[: self.n], return_inverse=True, return_counts=True)
        together = np.ones(size, bool)
        together[: self.n] = times[back] == 1
        for part in (keys // size, keys % size):
            worse = part[(part < self.n) & (rank[made] <= rank[part])]
            together[worse] = False
        self.merges = Merges(keys, made, rank, together, size)
        self.merges.know([[symbol[c] for c in p] for p in number if len(p) > 1])
        top = max((ord(c) for c in symbol if len(c) == 1), default=0)
        self.of_char = np.full(top + 2, self.other, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        # for decoding
        raw = [b"" if p.type == CONTROL else b" \xe2\x81\x87 " if p.type == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in pieces]
        self.out_len = np.array([len(x) for x in raw], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(raw), np.uint8)
        kind = np.array([p.type for p in pieces])
        self.is_byte, self.is_control = kind == BYTE, kind == CONTROL
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in pieces])
        self.book = CodeBook()
        self.space, self.stride = symbol.get(SPACE, -1), 1 << 40
        # where the longest piece of space marks always comes first of a run, whatever follows, runs may part there
        longest = max((len(p) for p in number if not p.strip(SPACE)), default=0)
        runs = [self.merges.run(np.full(n, self.space), np.zeros(n, np.int64))[0] for n in range(longest, 5 * longest)]
        if longest > 1 and all(len(r) and r[0] == number[SPACE * longest] for r in runs):
            self.stride = longest

    def encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word and how many there are."""
        words = [w.decode().replace(" ", SPACE) for w in raw]
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        symbols = self.of_char[np.minimum(points, len(self.of_char) - 1)].astype(np.int64)
        # characters outside the vocabulary stand for themselves: numbers from size on never merge
        strange = symbols >= self.n
        tagged = symbols * (1 << 21) + points  # carries the code point of single characters
        whole, owner = self._merge(tagged, symbols, word)
        sym, point = whole >> 21, whole & ((1 << 21) - 1)
        strange = sym >= self.n
        count = np.ones(len(sym), np.int64)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in point[strange].tolist()]
        if self.fallback:
            count[strange] = [len(x) for x in raw]
        out = np.repeat(sym, count).astype(np.int32)
        if strange.any():
            if self.fallback:
                out[np.repeat(strange, count)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            else:
                out[strange] = self.unknown
                run = strange & np.r_[False, strange[:-1]] & np.r_[False, owner[1:] == owner[:-1]]
                out, owner, count = out[~run], owner[~run], count[~run]
        sizes = np.bincount(np.repeat(owner, count), minlength=len(words))
        return out, sizes

    def _merge(self, tagged: np.ndarray, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds; single characters keep their code point in the low bits."""
        # strange characters get numbers beyond the table, so that their code points survive
        strange = symbols >= self.n
        lone = symbols == self.other
        own = np.where(lone, self.merges.size + np.arange(len(symbols)), symbols)
        # a long run of space marks parts after each ``stride``
        space = symbols == self.space
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        count = np.diff(np.r_[first, len(word)])
        at = np.arange(len(word)) - np.repeat(first, count)
        left = np.repeat(np.add.reduceat(space.astype(np.int64), first), count) - at
        part = np.cumsum((at == 0) | (space & (at % self.stride == 0) & (left >= self.stride)))
        done, owner = self.merges.run(own, part)
        owner = word[np.searchsorted(part, owner)]
        out = done << 21
        at_lone = done >= self.merges.size
        out[at_lone] = tagged[done[at_lone] - self.merges.size]
        named = (done >= self.n) & ~at_lone
        if named.any():  # a known character that is no piece of its own
            back = np.zeros(self.merges.size, np.int64)
            back[symbols[strange & ~lone]] = tagged[strange & ~lone] & ((1 << 21) - 1)
            out[named] |= back[done[named]]
        return out, owner

    def encode(self, texts: pa.Array | list[str | None], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their n + 1 offsets; null counts as empty."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        found, counts = spaced_words(texts, self.prefix)
        flat, size = self.book.look_up(found, self.encode_words)
        ends = np.r_[0, np.cumsum(size)][np.cumsum(counts)]
        if end:
            flat = np.insert(flat, ends, self.end)
            ends = ends + np.arange(1, len(ends) + 1)
        return flat, np.r_[0, ends]

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id sequences; bytes that are no UTF-8 become U+FFFD each."""
        size = self.out_len[flat].copy()
        start = self.out_at[flat].copy()
        n = np.diff(offsets)
        if self.prefix:  # the first piece that is no control symbol loses its first space mark
            plain = np.flatnonzero(~self.is_control[flat])
            lead = np.searchsorted(plain, offsets[:-1])
            ok = lead < len(plain)
            lead = plain[lead[ok]]
            lead = lead[(lead < offsets[1:][ok]) & self.spaced[flat[lead]]]
            size[lead] -= 1
            start[lead] += 1
        data = self.out[ranges(start, size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][offsets].tolist()
        out = []
        for k in range(len(n)):
            try:
                out.append(data[ends[k] : ends[k + 1]].decode())
            except UnicodeDecodeError:
                out.append(self._decode_slow(flat[offsets[k] : offsets[k + 1]], start[offsets[k] : offsets[k + 1]], size[offsets[k] : offsets[k + 1]]))
        return out

    def _decode_slow(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> str:
        out, run = [], b""

        def flush(run: bytes) -> str:
            text, k = "", 0
            while k < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        text += run[k : k + width].decode()
                        k += width
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    text += "�"
                    k += 1
            return text

        for i, a, n in zip(ids.tolist(), start.tolist(), size.tolist(), strict=True):
            piece = self.out[a : a + n].tobytes()
            if self.is_byte[i]:
                run += piece
            else:
                out += [flush(run), piece.decode()]
                run = b""
        return "".join(out) + flush(run)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The model of a file, loaded once in each worker."""
    return Codec(path)


#: Bytes of text that one vectorised step encodes.
STEP_TEXT = 1 << 20


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """One row (id, ids array<int>, decoded string) for each row of ``docs``.

    ``ids`` are those of the sentencepiece library without sampling, with the end
    id last if ``end``; ``decoded`` is its decode(ids). Null and empty texts give
    no ids but the end id, and an empty decoded text. Rows with equal or null ids
    are encoded one by one, other columns are not read, an empty table gives an
    empty result. ``model_path`` must exist on every executor. No shuffle.
    """
    schema = T.StructType([docs.schema[id_col], *SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in tidy(batches, c.book):
            _, offsets = flat_text(batch.column(1))
            for a, b in steps(offsets, STEP_TEXT):
                flat, at = c.encode(batch.column(1).slice(a, b - a), end)
                decoded = c.decode(flat, at)
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
