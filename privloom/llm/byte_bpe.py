"""Byte-level BPE by monoid tree reduction.

The encodings of strings form a monoid: ``join(encode(a), encode(b)) == encode(a + b)``. A sequence of tokens
is the encoding of its bytes exactly if each adjacent pair is the encoding of that pair's bytes; so ``join`` re-encodes
a window around the seam, growing it until the pairs at its two ends are stable, and the tokens outside stay as
they are. ``encode`` splits into halves and joins up the tree; ``decode`` concatenates up the tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable

import numpy as np
import regex

#: Bytes of a leaf of the tree, which is merged directly, and of the longest window whose merge is remembered: syllables come back.
LEAF, WINDOW = 6, 16
#: Entries of a generation of a worker's memo, and the longest text kept in it.
MEMO, MEMO_CHARS = 200_000, 48
#: Above every rank: a pair that isn't a token.
NO_RANK = 1 << 62
#: Longest piece whose leaf is merged beside others of its length, pieces of a length that make that worth it, code points of a batch.
SIDE_BY_SIDE, LEAST_ROWS, BATCH_CHARS = 32, 8, 4_000_000
#: White space besides space and line feed (Unicode White_Space and what Python counts to it): fixed values.
RARE_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file of the public tokenizer library: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def same_spaces(pattern: str) -> str:
    """``pattern`` with white space as the Unicode property, as the tokenizer library takes it."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class PairTable:
    """Ranks of token pairs, for whole arrays: a hash table with open addressing."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int]):
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int64)
        key, rank = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._slot(key)
        self.probes = 0
        while len(key):  # of the keys that want a free slot one gets it, the others go on to the next
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]] = key[free]
            placed = self.keys[at] == key
            self.ranks[at[placed]] = rank[placed]
            key, rank, at = key[~placed], rank[~placed], (at[~placed] + 1) & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * self.MIX >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], NO_RANK)
        open_ = np.flatnonzero((out == NO_RANK) & (self.keys[at] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at_open = at.flat[open_] = (at.flat[open_] + 1) & self.last
            seen = self.keys[at_open]
            hit = seen == key.flat[open_]
            out.flat[open_[hit]] = self.ranks[at_open[hit]]
            open_ = open_[~hit & (seen != -1)]
        return out


class MonoidBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pair_ranks = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._stable: dict[tuple[int, int], bool] = {}
        self._merged: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties: the definition, for short pieces."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [rank(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while scores:
            best = min(scores)
            if best == NO_RANK:
                break
            at = scores.index(best)
            both = parts[at] = parts[at] + parts.pop(at + 1)
            del scores[at]
            if at < len(scores):
                scores[at] = rank(both + parts[at + 1], NO_RANK)
            if at:
                scores[at - 1] = rank(parts[at - 1] + both, NO_RANK)
        return list(map(self.ranks.__getitem__, parts))

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` of pieces of one length side by side; ids as little-endian unsigned 32-bit bytes."""
        n, width = len(pieces), len(pieces[0])
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8).reshape(n, width)]
        sizes, rows = np.full(n, width), np.arange(n)
        out = np.zeros((n, width), "<u4")
        scores = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = scores.min(axis=1, initial=NO_RANK)
            done = best == NO_RANK
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                sizes[rows[done]] = ids.shape[1]
                ids, scores, rows, best = ids[~done], scores[~done], rows[~done], best[~done]
                if not len(rows):
                    break
            at, each = scores.argmin(axis=1), np.arange(len(rows))  # the leftmost of the lowest
            ids[each, at] = best
            stay = np.arange(ids.shape[1]) != at[:, None] + 1
            ids = ids[stay].reshape(len(rows), -1)
            scores = scores[stay[:, 1:]].reshape(len(rows), -1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
            scores[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
            scores[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
        packed = out.tobytes()
        return [packed[4 * width * i : 4 * (width * i + m)] for i, m in enumerate(sizes.tolist())]

    def merged(self, piece: bytes) -> list[int]:
        """``merge`` of a leaf or a short window, remembered; the list is not to be changed."""
        known = self._merged.get(piece)
        if known is None:
            if len(self._merged) > MEMO:
                self._merged.clear()
            known = self._merged[piece] = self.merge(piece)
        return known

    def stable(self, a: int, b: int) -> bool:
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) > MEMO:
                self._stable.clear()
            known = self._stable[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            window = self._window(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])), (i, j) != (0, len(right)))
            before = i == 0 or self.stable(left[i - 1], window[0])
            after = j == len(right) or self.stable(window[-1], right[j])
            if before and after:
                return left[:i] + window + right[j:]
            if not before:
                i = max(0, i - (len(left) - i))
            if not after:
                j = min(len(right), 2 * j)

    def _window(self, piece: bytes, part: bool) -> list[int]:
        """A window's bytes anew: a window that is all of both sides can't go back to its halves, so it is merged."""
        if len(piece) <= WINDOW:
            return self.merged(piece)
        return self._fold(piece) if part else self.merge(piece)

    def _fold(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.merged(piece)
        half = len(piece) // 2
        return self.join(self._fold(piece[:half]), self._fold(piece[half:]))

    def encode(self, piece: bytes) -> list[int]:
        """One match of the pattern, as the tokenizer library encodes it."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        return self._fold(piece) if piece else []

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """``encode`` of each, packed: leaves of one length side by side, longer pieces up the tree."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                by_length.setdefault(len(piece), []).append(i)
        for length, at in by_length.items():
            if 1 < length <= SIDE_BY_SIDE and len(at) >= LEAST_ROWS:
                found = self.merge_rows([pieces[i] for i in at])
            else:
                found = [np.array(self.encode(pieces[i]), "<u4").tobytes() for i in at]
            for i, ids in zip(at, found):
                out[i] = ids
        return out

    def decode(self, ids) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Memo:
    """Remembered encodings of units, in two generations: when the young one is full it becomes the old one, and what is still asked for
    returns from there. So frequent units stay, and a worker's memory is bounded."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def all_of(self, units: Iterable[str]) -> dict[str, bytes]:
        """A dictionary that has each of ``units``, which are distinct; it may have more."""
        young, old = self.young, self.old
        missing = []
        for unit in units:
            if unit not in young:
                found = old.get(unit)
                if found is None:
                    missing.append(unit)
                else:
                    young[unit] = found
        young.update(zip(missing, self.encode(missing)))
        if len(young) >= MEMO:
            self.young, self.old = {}, {unit: ids for unit, ids in young.items() if len(unit) <= MEMO_CHARS}
        return young


class TextEncoder:
    """Whole texts to ids (little-endian unsigned 32-bit bytes), remembering the encodings of frequent units.

    A single space between two characters that aren't white space is always the first character of a match of
    the pattern, so the text splits there into units that are encoded separately; texts with other white
    space next to a space, or rare white space, are taken as one unit. The distinct units of a batch of texts are encoded
    once, those not remembered all together.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode
        self.spaced = Memo(lambda words: encode([" " + word for word in words]))  # by what follows the space

    @staticmethod
    def splits(text: str) -> bool:
        if not text or "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            return False
        return text.isascii() and text.isprintable() or not any(c in text for c in RARE_SPACE)

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= BATCH_CHARS:
                size += len(texts[end])
                end += 1
            out += self._some(texts[at:end])
            at = end
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        words = [text.split(" ") if self.splits(text) else [text] for text in texts]
        firsts = [each.pop(0) for each in words]
        known = self.spaced.all_of(set().union(*words))
        return [first + b"".join(map(known.__getitem__, rest)) for first, rest in zip(self.encode(firsts), words)]


def monoid_text_encoder(ranks: dict[bytes, int], pattern: str) -> tuple[MonoidBPE, TextEncoder]:
    bpe, find = MonoidBPE(ranks), regex.compile(same_spaces(pattern)).findall
    matches = Memo(lambda pieces: bpe.encode_all([piece.encode() for piece in pieces]))

    def matches_of(unit: str) -> list[str]:
        # an ASCII word, with or without the space before it, is one match
        return [unit] if unit.isascii() and unit.lstrip(" ").isalpha() and unit[1:2] != " " else find(unit)

    def encode(units: list[str]) -> list[bytes]:
        found = [matches_of(unit) for unit in units]
        known = matches.all_of(set().union(*found))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in found]

    return bpe, TextEncoder(encode)
