"""Byte-pair encoding of batches of texts by rank-synchronous array merging.

A batch's bytes are cut into words and pre-tokens by array operations. The distinct pre-tokens
lie behind one another in flat arrays, one symbol a byte, a ragged array with a sequence for each
pre-token. In a round every sequence finds the lowest rank among its pairs and merges that pair
wherever it stands; sequences without a ranked pair leave. What is left of a sequence are its
tokens. Nothing is remembered from one batch to the next.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

#: Bytes of text that are held as arrays at once; a byte takes about a hundred there.
PORTION = 1024 * 1024
BLANK = re.compile(rb"[\t-\r ]")
#: Above any rank.
NONE = np.iinfo(np.int32).max
#: Below this code point nothing composes, and case and classes are the same in every Unicode
#: version.
PLAIN = "ɐ"
#: Python splits at these separators, a tokenizer does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile("[^\\S\x1c-\x1f]+")


def byte_letters() -> str:
    """The letter that byte-level tokenizers write for each byte: the printable one of the same
    number, or else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where a boolean array is true."""
    edge = np.diff(np.concatenate([[0], change.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of all stretches, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(start - ends + size, size)


class PairMerger:
    """The merges of a byte-level BPE model, as sorted arrays."""

    def __init__(self, model: dict):
        other = {
            "dropout": (None, 0.0), "unk_token": (None,), "byte_fallback": (False, None),
            "ignore_merges": (False, None), "continuing_subword_prefix": (None, ""),
        }
        for name, plain in other.items():
            if model.get("type") != "BPE" or model.get(name) not in plain:
                raise ValueError(f"not a plain BPE model: {name}={model.get(name)!r}")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # A pair that is listed twice has its last rank.
        order = np.lexsort((-np.arange(key.size), key))
        order = order[np.concatenate([[True], np.diff(key[order]) != 0])] if key.size else order
        self.key, self.rank = key[order], order.astype(np.int32)
        # Ranks of two bytes, the second within a word or at its end.
        right = np.concatenate([self.inner, self.last])
        self.of_bytes = self._ranks(np.repeat(self.inner, 512), np.tile(right, 256)).reshape(256, 512)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not self.key.size:
            return np.full(left.size, NONE, np.int32)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), self.key.size - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the sequences of bytes that lie behind one another in `raw`, and how
        many each has."""
        symbol = self.inner[raw]
        full = size > 0
        final = np.cumsum(size)[full] - 1
        symbol[final] = self.last[raw[final]]
        owner = np.repeat(np.arange(size.size, dtype=np.int32), size)
        # rank[i]: of the pair of symbols i and i + 1; the last symbol of a sequence has none.
        rank = np.full(symbol.size, NONE, np.int32)
        if raw.size:
            at_end = np.zeros(raw.size, np.int32)
            at_end[final] = 256
            rank[:-1] = self.of_bytes[raw[:-1], raw[1:] + at_end[1:]]
            rank[final] = NONE
        count = np.zeros(size.size, np.int64)
        left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while symbol.size:
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, symbol.size))
            done = lowest == NONE
            if done.any():
                who = owner[first[done]]
                count[who] = length[done]
                live = np.repeat(~done, length)
                left.append((who, length[done], symbol[~live]))
                symbol, owner, rank = symbol[live], owner[live], rank[live]
                length, lowest = length[~done], lowest[~done]
                if not symbol.size:
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, length))
            # Of pairs that overlap, as in "aaa", every second one from the left.
            fresh = np.concatenate([[True], np.diff(hit) > 1])
            if not fresh.all():
                nth = np.arange(hit.size)
                hit = hit[(nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            stays = np.ones(symbol.size, bool)
            stays[hit + 1] = False
            symbol, owner, rank = symbol[stays], owner[stays], rank[stays]
            hit = hit - np.arange(hit.size)
            # The merged symbol's pair with its successor, and its predecessor's with it.
            touched = np.concatenate([hit, hit[hit > 0] - 1])
            rank[touched] = NONE
            touched = touched[touched + 1 < symbol.size]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self._ranks(symbol[touched], symbol[touched + 1])
        ids = np.empty(count.sum(), np.uint32)
        start = np.cumsum(count) - count
        for who, length, symbols in left:
            ids[_places(start[who], length)] = symbols
        return ids, count

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each of `words`."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        return self.merge(np.frombuffer(b"".join(words), np.uint8), size)[1]


#: The normalizer and pre-tokenizer that `_cut` follows without the library.
_NORMAL = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Classes of bytes. HARD ones need a look at the word: an apostrophe may begin a contraction,
#: letters beyond Latin-1 may compose. LEAD begins a letter of Latin-1's upper half.
_BLANK, _LETTER, _DIGIT, _MARK, _HARD = range(5)
_LEAD, _TIMES, _DIVIDED = 0xC3, 0x97, 0xB7


def _byte_classes() -> np.ndarray:
    out = np.full(256, _MARK, np.uint8)
    out[128:] = _HARD
    out[ord("'")] = _HARD
    out[[9, 10, 11, 12, 13, 32]] = _BLANK
    out[48:58] = _DIGIT
    out[97:123] = out[65:91] = _LETTER
    return out


_CLASS = _byte_classes()
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class BatchTokenizer:
    """Tokens of texts under a tokenizer file of the tokenizers library (.json, byte-level BPE),
    without begin, end or added special tokens. Special strings within a text are one token
    each, as by the library's default.

    For the normalizer and pre-tokenizer above, words are cut here; words with odd letters,
    and whole texts under other files, are cut by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.merger = PairMerger(spec["model"])
        self.library = Tokenizer.from_file(path)
        added = spec.get("added_tokens") or []
        for token in added:
            if any(token.get(x) for x in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"added token with a rule of its own: {token['content']!r}")
        self.special = {t["content"]: t["id"] for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile(f"({'|'.join(map(regex.escape, names))})") if names else None
        self.by_word = (
            spec.get("normalizer") == _NORMAL and spec.get("pre_tokenizer") == _SPLIT
            and not any(regex.search(r"\s", n) for n in names)
        )
        self.pattern = regex.compile(_PATTERN)
        self.byte = {ord(x): b for b, x in enumerate(byte_letters())}

    def _library_pieces(self, text: str) -> list[bytes]:
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        if self.library.pre_tokenizer is None:
            raise ValueError("a tokenizer without a byte-level pre-tokenizer")
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [piece.translate(self.byte).encode("latin-1") for piece, _ in found]

    def _pieces(self, text: str) -> list[bytes]:
        """Pre-tokens of a stretch of text without special strings."""
        if not self.by_word:
            return self._library_pieces(text)
        words = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        out = []
        for word in words:
            if word and max(word) < PLAIN:
                out += [x.encode() for x in self.pattern.findall(word.lower())]
            elif word:
                out += self._library_pieces(word)
        return out

    def _parts(self, text: str) -> list[bytes | int]:
        """Pre-tokens, and ids of special strings, in order."""
        if self.specials is None or not self.specials.search(text):
            return self._pieces(text)
        out: list[bytes | int] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._pieces(part)
        return out

    def _portions(self, texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
        """The texts, about `PORTION` bytes at a time, with their numbers; a longer one in
        several pieces, cut between words."""
        held, parts, size = [], [], 0
        for i, text in enumerate(texts):
            at = 0
            while True:
                end = len(text)
                if self.by_word and end - at > PORTION:
                    blank = BLANK.search(text, at + PORTION)
                    end = blank.end() if blank else end
                held.append(i)
                parts.append(text[at:end] if at or end < len(text) else text)
                size += end - at
                if size >= PORTION:
                    yield held, parts
                    held, parts, size = [], [], 0
                at = end
                if at == len(text):
                    break
        if parts:
            yield held, parts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids (uint32) of all UTF-8 texts behind one another, and how many each has."""
        out, count = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for held, parts in self._portions(texts):
            place, units, ids, tokens, ends = self._units(parts)
            size = tokens[units]
            out.append(ids[_places((np.cumsum(tokens) - tokens)[units], size)])
            text = np.searchsorted(ends, place, "right")
            np.add.at(count, held, np.bincount(text, size, len(parts)).astype(np.int64))
        return np.concatenate(out), count

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Number of tokens of each UTF-8 text."""
        count = np.zeros(len(texts), np.int64)
        for held, parts in self._portions(texts):
            place, units, _, tokens, ends = self._units(parts)
            text = np.searchsorted(ends, place, "right")
            np.add.at(count, held, np.bincount(text, tokens[units], len(parts)).astype(np.int64))
        return count

    def _units(self, texts: list[bytes]):
        """(place, units, ids, tokens, ends): the pre-tokens and special strings of all texts in
        order, by place, as numbers of distinct ones; those one's ids, behind one another, and
        how many each has; and where each text ends."""
        joined = b"\n".join(texts) + b"\n"
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        if self.by_word:
            raw, start, size, chunks = self._cut(joined)
        else:
            raw = np.zeros(0, np.uint8)
            start = size = np.zeros(0, np.int64)
            chunks = list(zip((ends - [len(t) + 1 for t in texts]).tolist(), texts))
        number, pools = _distinct(raw, start, size)
        # Words that need a look, each distinct one once.
        n = sum(lengths.size for _, lengths in pools)
        known: dict[bytes, list[int]] = {}
        pieces: dict[bytes | int, int] = {}
        places, hard = [], []
        for at, chunk in chunks:
            if chunk not in known:
                known[chunk] = [
                    pieces.setdefault(p, len(pieces)) for p in self._parts(chunk.decode())
                ]
            units = known[chunk]
            hard += units
            places += [at] * len(units)
        more = [p if isinstance(p, bytes) else b"" for p in pieces]
        pools.append(
            (
                np.frombuffer(b"".join(more), np.uint8),
                np.fromiter(map(len, more), np.int64, len(more)),
            )
        )
        ids, tokens = self.merger.merge(
            np.concatenate([b for b, _ in pools]), np.concatenate([s for _, s in pools])
        )
        special = [(n + i, p) for p, i in pieces.items() if not isinstance(p, bytes)]
        if special:
            at = np.cumsum(tokens) - tokens
            ids = np.insert(ids, [at[i] for i, _ in special], [p for _, p in special])
            tokens[[i for i, _ in special]] = 1
        place = np.concatenate([start, np.array(places, np.int64)])
        units = np.concatenate([number, n + np.array(hard, np.int64)])
        if places:
            order = np.argsort(place, kind="stable")
            place, units = place[order], units[order]
        return place, units, ids, tokens, ends

    def _cut(self, joined: bytes):
        """Lower-case bytes, start and size of the pre-tokens of plain words; and the other
        words as (start, word)."""
        raw = np.frombuffer(joined.translate(_LOWER), np.uint8)
        kind = _CLASS[raw]
        lead = np.flatnonzero(raw[:-1] == _LEAD)
        if lead.size:
            second = raw[lead + 1]
            letter = (second != _TIMES) & (second != _DIVIDED)
            lead, second = lead[letter], second[letter]
            kind[lead] = kind[lead + 1] = _LETTER
            raw = raw.copy()
            raw[lead + 1] = np.where(second < 0x9F, second | 0x20, second)
        first, last = _runs(kind != _BLANK)
        hard = np.zeros(first.size, bool)
        odd = np.flatnonzero(kind == _HARD)
        for name in self.special:
            found = joined.find(name.encode())
            while found >= 0:
                odd = np.append(odd, found)
                found = joined.find(name.encode(), found + 1)
        hard[np.searchsorted(first, odd, "right") - 1] = True
        chunks = [
            (a, joined[a:b]) for a, b in zip(first[hard].tolist(), last[hard].tolist())
        ]
        # A pre-token starts with its word, at a change of class, and at every digit.
        begins = np.zeros(raw.size + 1, bool)
        begins[1:-1] = kind[1:] != kind[:-1]
        begins[0] = True
        begins[:-1] |= kind == _DIGIT
        plain = np.zeros(raw.size, bool)
        plain[_places(first[~hard], (last - first)[~hard])] = True
        begins[-1] = True
        at = np.flatnonzero(begins)
        start, size = at[:-1], np.diff(at)
        wanted = plain[start]
        return raw, start[wanted], size[wanted], chunks


def _distinct(
    raw: np.ndarray, start: np.ndarray, size: np.ndarray
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of each stretch's content among the distinct ones, which come as pools of
    (bytes, sizes), one after the other."""
    number = np.zeros(start.size, np.int64)
    pools: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    for low, high in ((0, 8), (8, 16)):
        at = np.flatnonzero((size > low) & (size <= high))
        if not at.size:
            continue
        begin, length = start[at], size[at]
        # Up to eight bytes are a number, up to sixteen two.
        block = padded[begin[:, None] + np.arange(high)]
        block[np.arange(high)[None, :] >= length[:, None]] = 0
        words = block.view(np.uint64)
        if high == 8:
            _, one, which = np.unique(words[:, 0], return_index=True, return_inverse=True)
        else:
            order = np.lexsort((words[:, 1], words[:, 0]))
            sorted_ = words[order]
            new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(1)])
            which = np.empty(at.size, np.int64)
            which[order] = np.cumsum(new) - 1
            one = order[new]
        number[at] = n + which
        pools.append((raw[_places(begin[one], length[one])], length[one]))
        n += one.size
    long = np.flatnonzero(size > 16)
    if long.size:
        found: dict[bytes, int] = {}
        data = raw.tobytes()
        number[long] = [
            n + found.setdefault(data[a : a + s], len(found))
            for a, s in zip(start[long].tolist(), size[long].tolist())
        ]
        pools.append(
            (
                np.frombuffer(b"".join(found), np.uint8),
                np.fromiter(map(len, found), np.int64, len(found)),
            )
        )
    return number, pools


@lru_cache(maxsize=1)
def batch_tokenizer(path: str) -> BatchTokenizer:
    """One for all tasks of a worker; it holds the file's merges, nothing of the texts."""
    return BatchTokenizer(path)
