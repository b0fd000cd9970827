"""Byte-level BPE vocabularies, the compatibility of adjacent tokens, and the prefix dynamic programme."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

from ._pieces import LETTER, NUMBER, OTHER, SPACE, Splitter


class BpeModel:
    """Tokens as bytes with ids, and merges: from two ids as one number (left << 20 | right) to the merged id.

    Ids follow the priorities: single bytes have the lowest, and of two merges the earlier one has the lower id.
    """

    def __init__(self, tokens: dict[bytes, int], pairs: dict[int, int]):
        self.ids = tokens
        self.bytes = {i: b for b, i in tokens.items()}
        self.pairs = pairs
        self.longest = max(map(len, tokens))
        self.single = [tokens[bytes([b])] for b in range(256)]
        self._compatible: dict[tuple[int, int], bool] = {}
        self._stable: dict[int, bool] = {}
        self._splits: dict[int, tuple[int, int] | None] = {}

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """Merges as they are defined: lowest rank first, leftmost of equals first; all tokens made are under below."""
        ids = [self.single[b] for b in piece]
        pairs = self.pairs
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = pairs.get(ids[i] << 20 | ids[i + 1])
                if found is not None and found < below and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best]
        return ids

    def stable(self, token: int) -> bool:
        """Whether the token's own bytes encode to it alone."""
        found = self._stable.get(token)
        if found is None:
            found = self._stable[token] = self.merge(self.bytes[token]) == [token]
        return found

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and tokens that no merges reach."""
        if token not in self._splits:
            parts = self.merge(self.bytes[token], below=token)
            self._splits[token] = (parts[0], parts[1]) if len(parts) == 2 and self.pairs.get(parts[0] << 20 | parts[1]) == token else None
        return self._splits[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode to just these two.

        They do unless, while both are taken apart from the latest merge back, some pair that meets at the border
        would have merged before one of its two sides was made.
        """
        key = (left, right)
        found = self._compatible.get(key)
        if found is None:
            if len(self._compatible) > 400_000:
                self._compatible.clear()
            found = self._compatible[key] = self._compatible_now(left, right)
        return found

    def _compatible_now(self, left: int, right: int) -> bool:
        if not (self.stable(left) and self.stable(right)):
            return False
        bound = (1 << 60, 0)  # merges at the border count if they come before this: (rank, 1 if a tie goes to the border)
        while True:
            joined = self.pairs.get(left << 20 | right)
            if joined is not None and (joined, 0) < bound:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                bound, left = (left, 0), a[1]
            else:
                bound, right = (right, 1), b[0]

    def last_tokens(self, piece: bytes) -> tuple[list[int], list[int]]:
        """For each prefix of the piece, from 0 bytes: its last token, and its number of tokens.

        A token ends the encoding of a prefix exactly if it is compatible with the token that ends the encoding of
        what stands before it, and just one token is; so each prefix takes one look back.
        """
        ids, last, count = self.ids, [-1], [0]
        longest, compatible = self.longest, self.compatible
        for end in range(1, len(piece) + 1):
            for at in range(max(0, end - longest), end):
                token = ids.get(piece[at:end])
                if token is not None and (compatible(last[at], token) if at else self.stable(token)):
                    break
            else:
                raise ValueError("bytes outside the vocabulary")
            last.append(token)
            count.append(count[at] + 1)
        return last, count

    def encode_piece(self, piece: bytes) -> list[int]:
        last, _ = self.last_tokens(piece)
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        return out[::-1]


class Transducer:
    """The merges as a finite-state transducer that is determinised as far as inputs need it.

    The recogniser's state is the longest end of what was read that a token may still begin with; its shorter ends
    are all other borders from which a token may run on (the open borders). Transitions, and with each state the
    tokens that may end there, are worked out when they are first needed and then kept; there are as many states at
    most as the vocabulary has beginnings of tokens. Of the tokens that may end at a place, the one that is compatible
    with the last token before it is right (BpeModel.last_tokens states this plainly). A token is final, and is
    emitted, once the encodings of all open borders share it; so the lookahead is bounded by what one token spans.
    """

    #: Bytes that are read between two looks for final tokens.
    WINDOW = 512

    def __init__(self, model: BpeModel):
        self.model = model
        self.opening = {b[:i] for b in model.ids for i in range(1, len(b) + 1)}
        self.number: dict[bytes, int] = {b"": 0}
        self.strings: list[bytes] = [b""]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.steps: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.rows = 0
        self.memo = np.zeros(1 << 20, np.int64)

    def _step(self, state: int, byte: int) -> int:
        text = self.strings[state >> 8] + bytes([byte])
        while text not in self.opening:
            text = text[1:]
        found = self.number.get(text)
        if found is None:
            found = self.number[text] = len(self.strings) << 8
            self.strings.append(text)
            ids = self.model.ids
            tokens = ((len(text) - i, ids.get(text[i:])) for i in range(len(text)))
            self.ends.append([(n, t) for n, t in tokens if t is not None and self.model.stable(t)])
        self.steps[state | byte] = found
        return found

    def _pair(self, key: int) -> bool:
        if len(self.pairs) > 300_000:
            self.pairs.clear()
        found = self.pairs[key] = self.model._compatible_now(key >> 20, key & 0xFFFFF)
        return found

    def _read(self, piece: bytes, state: int, last: list[int], size: list[int], count: list[int]) -> int:
        """Reads on: for each further prefix its last token, that token's length, and its number of tokens."""
        steps, ends, pairs = self.steps, self.ends, self.pairs
        end = len(last) - 1
        for byte in piece:
            end += 1
            state = steps.get(state | byte) or self._step(state, byte)
            for length, token in ends[state >> 8]:
                at = end - length
                if at < 0:
                    continue
                left = last[at]
                if left < 0:
                    break
                key = left << 20 | token
                ok = pairs.get(key)
                if ok or ok is None and self._pair(key):
                    break
            last.append(token)
            size.append(length)
            count.append(count[end - length] + 1)
        return state

    #: Longer pieces are read one by one.
    SHORT = 48

    def _tables(self) -> None:
        """The states known so far as arrays: transitions (-1: not known yet), and lengths and ids of ending tokens."""
        known = len(self.strings)
        if not self.rows:
            self.rows, self.deepest = 1024, 1
            self.go = np.full((self.rows, 256), -1, np.int32)
            self.end_size = np.zeros((self.rows, 16), np.int64)
            self.end_token = np.zeros((self.rows, 16), np.int64)
            self.copied = 0
        while known > self.rows:
            self.go = np.concatenate([self.go, np.full_like(self.go, -1)])
            self.end_size = np.concatenate([self.end_size, np.zeros_like(self.end_size)])
            self.end_token = np.concatenate([self.end_token, np.zeros_like(self.end_token)])
            self.rows *= 2
        for i in range(self.copied, known):
            ends = self.ends[i]
            while len(ends) > self.end_size.shape[1]:
                self.end_size = np.concatenate([self.end_size, np.zeros_like(self.end_size)], axis=1)
                self.end_token = np.concatenate([self.end_token, np.zeros_like(self.end_token)], axis=1)
            for r, (n, token) in enumerate(ends):
                self.end_size[i, r], self.end_token[i, r] = n, token
        self.copied = known

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.go[state, byte]
        if (out < 0).any():
            for key in np.unique(state[out < 0].astype(np.int64) << 8 | byte[out < 0]).tolist():
                found = self.steps.get(key) or self._step(key & ~0xFF, key & 0xFF)
                if len(self.strings) > self.rows:
                    self._tables()
                self.go[key >> 8, key & 0xFF] = found >> 8
            self._tables()
            out = self.go[state, byte]
        return out

    def _pairs(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        held = self.memo[slot] - 1
        ok = (held & 1) == 1
        miss = (held >> 1) != keys
        if miss.any():
            new, back = np.unique(keys[miss], return_inverse=True)
            values = np.array([self.model._compatible_now(k >> 20, k & 0xFFFFF) for k in new.tolist()], bool)
            self.memo[slot[miss]] = (keys[miss] << 1 | values[back]) + 1
            ok[miss] = values[back]
        return ok

    def read_all(self, buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Reads many short pieces abreast: (order, last tokens, their lengths, counts), by bytes read and piece in order."""
        self._tables()
        order = np.argsort(-size, kind="stable")
        at, left_over = first[order], -size[order]
        most, n = int(size.max(initial=0)), len(size)
        last = np.full((most + 1, n), -1, np.int32)
        length = np.zeros((most + 1, n), np.int16)
        count = np.zeros((most + 1, n), np.int32)
        state = np.zeros(n, np.int32)
        for end in range(1, most + 1):
            m = int(np.searchsorted(left_over, -end, side="right"))
            now = state[:m] = self._next(state[:m], buf[at[:m] + end - 1])
            todo, rank = np.arange(m), 0
            while len(todo):
                s = now[todo]
                n_bytes, token = self.end_size[s, rank], self.end_token[s, rank]
                begin = end - n_bytes
                left = last[begin, todo]
                ok = begin == 0
                ask = np.flatnonzero(~ok)
                if len(ask):
                    ok[ask] = self._pairs(left[ask].astype(np.int64) << 20 | token[ask])
                hit = todo[ok]
                last[end, hit] = token[ok]
                length[end, hit] = n_bytes[ok]
                count[end, hit] = count[begin[ok], hit] + 1
                todo, rank = todo[~ok], rank + 1
        return order, last, length, count

    def count_all(self, buf: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        size = ends - first
        out = np.zeros(len(first), np.int64)
        short = np.flatnonzero(size <= self.SHORT)
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            order, _, _, count = self.read_all(buf, first[part], size[part])
            out[part[order]] = count[size[part[order]], np.arange(len(part))]
        for i in np.flatnonzero(size > self.SHORT):
            out[i] = self.count(buf[first[i] : ends[i]].tobytes())
        return out

    def encode_all(self, buf: np.ndarray, first: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Tokens of each piece; each is emitted when it is final, at the end of a short piece at the latest."""
        size = ends - first
        out: list[list[int]] = [[]] * len(first)
        short = np.flatnonzero(size <= self.SHORT)
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            order, last, length, count = self.read_all(buf, first[part], size[part])
            where, column = size[part[order]].copy(), np.arange(len(part))
            n = count[where, column]
            stop = np.cumsum(n)
            flat, put = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64), stop - 1
            while len(column):
                flat[put] = last[where, column]
                where = where - length[where, column]
                on = where > 0
                where, column, put = where[on], column[on], put[on] - 1
            flat_list, begin = flat.tolist(), (stop - n).tolist()
            for j, b, e in zip(part[order].tolist(), begin, stop.tolist(), strict=True):
                out[j] = flat_list[b:e]
        for i in np.flatnonzero(size > self.SHORT):
            out[i] = self.encode(buf[first[i] : ends[i]].tobytes())
        return out

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of the piece, from 0 bytes."""
        count = [0]
        self._read(piece, 0, [-1], [0], count)
        return count

    def count(self, piece: bytes) -> int:
        return self.counts(piece)[-1]

    def stream(self, chunks):
        """Yields lists of final tokens while the bytes of one piece come in."""
        state, last, size, count = 0, [-1], [0], [0]
        for chunk in chunks:
            for i in range(0, len(chunk), self.WINDOW):
                state = self._read(chunk[i : i + self.WINDOW], state, last, size, count)
                end = len(last) - 1
                shared = self._borders(size, end)
                text = self.strings[state >> 8]
                for n in range(1, len(text) + 1):
                    if text[-n:] in self.opening and n <= end:
                        shared &= self._borders(size, end - n)
                base = max(shared)
                if base:
                    yield self._tokens(last, size, base)
                    last, size, count = last[base:], [0, *size[base + 1 :]], count[base:]
        yield self._tokens(last, size, len(last) - 1)

    @staticmethod
    def _borders(size: list[int], end: int) -> set[int]:
        out = {end}
        while end > 0:
            end -= size[end]
            out.add(end)
        return out

    @staticmethod
    def _tokens(last: list[int], size: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) > self.WINDOW:
            return [t for tokens in self.stream([piece]) for t in tokens]
        last, size = [-1], [0]
        self._read(piece, 0, last, size, [0])
        return self._tokens(last, size, len(piece))


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that JSON vocabularies have for bytes: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load_tiktoken(path: str) -> BpeModel:
    """A rank file: any two tokens whose bytes together are a token merge, lowest rank first."""
    tokens = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                tokens[base64.b64decode(token)] = int(rank)
    pairs = {}
    for token, rank in tokens.items():
        for cut in range(1, len(token)):
            left, right = tokens.get(token[:cut]), tokens.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 20 | right] = rank
    return BpeModel(tokens, pairs)


@lru_cache(maxsize=2)
def load_json(path: str) -> tuple[BpeModel, Splitter, list[tuple[bytes, int]]]:
    """A byte-level tokenizer file: (model, splitter with the library's own character classes, special strings)."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    symbols = byte_symbols()
    vocab = spec["model"]["vocab"]
    special = [(t["content"].encode(), t["id"]) for t in spec["added_tokens"]]
    apart = {t["content"] for t in spec["added_tokens"]}
    as_bytes = {w: bytes(symbols[c] for c in w) for w in vocab if w not in apart}
    pairs = {}
    for merge in spec["model"]["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        pairs[vocab[left] << 20 | vocab[right]] = vocab[left + right]
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def classify(ch: str) -> int:
        for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(split(before + ch)) == 1:
                return kind
        return SPACE

    return BpeModel({b: vocab[w] for w, b in as_bytes.items()}, pairs), Splitter(classify), special


def tiktoken_classifier(path: str):
    """Character classes as the tiktoken library sees them.

    Where two Unicode versions at hand agree, so does the library, which has one between them. Of other characters the
    library is asked: after one that is neither letter, number nor space, an apostrophe joins it and no contraction follows.
    """
    import unicodedata

    import regex

    patterns = [(regex.compile(p), kind) for p, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE))]

    @lru_cache(maxsize=1)
    def library():
        import public_tokenizers
        import tiktoken

        ranks = load_tiktoken(path).ids
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks.get(b"'s")

    def classify(ch: str) -> int:
        newer = next((kind for pattern, kind in patterns if pattern.match(ch)), OTHER)
        older = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(ch)[0], newer if newer == SPACE else OTHER)
        if newer == older:
            return newer
        encoding, contraction = library()
        return newer if encoding.encode_ordinary(ch + "'s")[-1] == contraction else OTHER

    return classify


def cut_at_specials(buf: np.ndarray, offsets: np.ndarray, special: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits documents at special strings, which count as one token each.

    Returns (offsets of the parts, document of each part, 1 where the part is a special string).
    """
    raw = buf.tobytes()
    cuts = []
    for text, _ in special:
        at = raw.find(text)
        while at >= 0:
            cuts.append((at, at + len(text)))
            at = raw.find(text, at + len(text))
    n = len(offsets) - 1
    if not cuts:
        return offsets, np.arange(n), np.zeros(n, np.int64)
    cuts.sort()
    inside, free = [], 0
    for a, b in cuts:  # leftmost first, within one document
        d = int(np.searchsorted(offsets, a, side="right")) - 1
        if a >= free and b <= offsets[d + 1]:
            inside.append((a, b))
            free = b
    edges = np.unique(np.concatenate([offsets, np.array(inside, np.int64).reshape(-1)]))
    flags = np.isin(edges[:-1], np.array([a for a, _ in inside], np.int64)).astype(np.int64)
    docs = np.searchsorted(offsets, edges[:-1], side="right") - 1
    return edges, docs, flags
