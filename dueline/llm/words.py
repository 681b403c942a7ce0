"""Whole texts encoded through a table of their distinct words.

Text is cut at white space into words, a word not met before is cut into the
matches of a tokenizer's pattern, and each distinct match is encoded once; a
text's code is the joined code of its words. Words of up to 16 bytes are found
in a table of fixed size by their bytes, for a whole block of texts at once.
What a worker keeps is bounded and changes the time that a text takes, never its
code.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
import regex

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: White_Space characters as tokenizers' patterns take them (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space beyond ASCII: rare, and not to be seen in single bytes.
_WIDE = [c for c in map(chr, range(128, 0x3001)) if regex.fullmatch(f"[{SPACE}]", c)]
_BLANK, _LETTER, _SIGN = np.zeros((3, 256), bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII digits and signs, but for the apostrophe, which patterns join to letters.
_SIGN[33:127] = ~_LETTER[33:127]
_SIGN[39] = False
#: Words a worker keeps in each of two generations besides the table.
KEPT = 50_000
#: Places of the table, and ids that its words may take.
_SLOTS = 20
_POOL = 6_000_000
#: Characters of the texts whose new words are encoded together.
BLOCK_CHARS = 6_000_000
_PART_BYTES = 1 << 20
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def spelled_out(pattern: str) -> regex.Pattern:
    """A pattern with its white space classes written as White_Space."""
    return regex.compile(
        pattern.replace(r"[^\s", f"[^{SPACE}")
        .replace(r"\s", f"[{SPACE}]")
        .replace(r"\S", f"[^{SPACE}]")
    )


class Recent:
    """Codes by key: two generations, the older one dropped when the newer is full."""

    def __init__(self, encode: Callable[[list], Iterable[bytes]], most: int = KEPT):
        self.encode, self.most, self.new, self.old = encode, most, {}, {}

    def holding(self, keys: Iterable) -> dict:
        """A table with at least these keys."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        missing = [k for k in dict.fromkeys(keys) if k not in self.new]
        if self.old:
            self.new.update((k, self.old[k]) for k in missing if k in self.old)
            missing = [k for k in missing if k not in self.old]
        if missing:
            self.new.update(zip(missing, self.encode(missing), strict=True))
        return self.new


class WordTable:
    """Codes of texts from the codes of their pattern matches.

    ``encode`` gives the ids of each distinct match as uint32 bytes. With
    ``space_counts`` white space belongs to the word after it, and texts are cut
    where white space begins; else ASCII white space is dropped between words.
    ``added`` has the ids of strings that are looked for in the raw text before
    anything else; what is between them is encoded as texts of their own. ``room``
    times as many words are kept as by default: less work for more memory.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], Iterable[bytes]],
        pattern: str,
        space_counts: bool,
        prepare: Callable[[str], str] | None = None,
        added: dict[str, int] | None = None,
        room: int = 1,
    ):
        self.pattern, self.space_counts, self.prepare = spelled_out(pattern), space_counts, prepare
        self.added = added or {}
        longest = sorted(self.added, key=len, reverse=True)
        self.apart = regex.compile(f"({'|'.join(map(regex.escape, longest))})")
        self.slots, self.most = _SLOTS + room.bit_length() - 1, _POOL * room
        self.encode = encode
        self.matches, self.words = Recent(encode, KEPT * room), Recent(self._words, KEPT * room)
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.slots
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.length = np.zeros(n, np.uint8)  # 0: an empty place
        self.first, self.count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(self.most // 4, np.uint32), 0

    def _words(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        blank = " " if self.space_counts else ""
        # Letters alone, behind a blank or not, are one match.
        single = [t.removeprefix(blank).isalpha() for t in texts]
        one = iter(self.encode([t for t, alone in zip(texts, single, strict=True) if alone]))
        find = self.pattern.findall
        parts = [None if alone else find(t) for t, alone in zip(texts, single, strict=True)]
        code_of = self.matches.holding(chain.from_iterable(filter(None, parts)))
        return [next(one) if p is None else b"".join([code_of[m] for m in p]) for p in parts]

    def _cut(self, data: bytes, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and length of each word; ``texts`` are the texts' first bytes.

        A word ends where white space begins, and between an ASCII letter and a
        sign; so does a match of the patterns. A line end between other characters
        is a word as well.
        """
        of = np.frombuffer(data, np.uint8)[:-16]
        blank, letter, sign = _BLANK[of], _LETTER[of], _SIGN[of]
        begins = np.zeros(len(of), bool)
        begins[texts[texts < len(of)]] = True
        begins[1:] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        if self.space_counts:
            begins[1:] |= blank[1:] & ~blank[:-1]
            begins[1:] |= begins[:-1] & (of[:-1] == 10) & ~blank[1:]
            first = np.flatnonzero(begins)
            return first, np.diff(np.append(first, len(of)))
        begins[1:] |= blank[:-1]
        border = np.flatnonzero(begins | blank)
        words = ~blank[border]
        return border[words], np.diff(np.append(border, len(of)))[words]

    def _part(self, raw: list[bytes]) -> dict:
        """Words of some texts: where they are, and where the table has them."""
        gap = b"" if self.space_counts else b" "
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + len(gap)
        texts = np.cumsum(sizes) - sizes
        data = gap.join(raw) + bytes(16)
        first, length = self._cut(data, texts)
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
        low = eight[first] & _MASKS[np.minimum(length, 8)]
        high = eight[np.minimum(first + 8, len(eight) - 1)] & _MASKS[np.clip(length - 8, 0, 8)]
        slot = (((low * _A) ^ (high * _B) ^ (high >> np.uint64(29))) * _C >> np.uint64(64 - self.slots)).astype(
            np.int32
        )
        known = (self.low[slot] == low) & (self.high[slot] == high) & (self.length[slot] == length)
        new = np.flatnonzero(~known)
        ends = (first[new] + length[new]).tolist()
        return {
            "texts": np.searchsorted(first, texts),
            "first": self.first[slot],
            "count": self.count[slot],
            "new": new,
            "words": [data[a:b] for a, b in zip(first[new].tolist(), ends, strict=True)],
            "keys": (slot[new], low[new], high[new], length[new]),
        }

    def _learn(self, parts: list[dict]) -> None:
        """Give the new words of all parts their codes, and the table what fits."""
        place = dict.fromkeys(chain.from_iterable(p["words"] for p in parts))
        code_of = self.words.holding(place)
        codes = [code_of[w] for w in place]
        place = dict(zip(place, range(len(codes)), strict=True))
        count = np.fromiter((len(c) // 4 for c in codes), np.int32, len(codes))
        first = self.used + np.cumsum(count, dtype=np.int64) - count
        total = self.used + int(count.sum())
        while total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : total] = np.frombuffer(b"".join(codes), "<u4")
        self.used = total
        for p in parts:
            at = np.fromiter(map(place.__getitem__, p["words"]), np.int64, len(p["words"]))
            p["first"][p["new"]], p["count"][p["new"]] = first[at], count[at]
            slot, low, high, length = p["keys"]
            # One word for each place: the first with this place among the new ones.
            slot, pick = np.unique(slot, return_index=True)
            fits = length[pick] <= 16
            slot, pick = slot[fits], pick[fits]
            self.low[slot], self.high[slot], self.length[slot] = low[pick], high[pick], length[pick]
            self.first[slot], self.count[slot] = first[at[pick]], count[at[pick]]

    def _joined(self, part: dict) -> list[np.ndarray]:
        first, count = part["first"].astype(np.int64), part["count"].astype(np.int64)
        ends = np.cumsum(count)
        shift = np.repeat(first - (ends - count), count)
        ids = self.pool[shift + np.arange(len(shift))]
        bounds = np.concatenate([[0], ends])[np.append(part["texts"], len(ends))].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = {i: self.apart.split(t) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        if not split:
            return self._plain(texts)
        pieces = [split[i][::2] if i in split else [t] for i, t in enumerate(texts)]
        code = iter(self._plain(list(chain.from_iterable(pieces))))
        out = []
        for i in range(len(texts)):
            ids = [next(code)]
            for a in split.get(i, ())[1::2]:
                ids += [np.array([self.added[a]], np.uint32), next(code)]
            out.append(np.concatenate(ids) if i in split else ids[0])
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts in which no added token is looked for."""
        out: list = [None] * len(texts)
        fast, raw = [], []
        for i, t in enumerate(texts):
            t = self.prepare(t) if self.prepare else t
            if self.space_counts and not t.isascii() and any(c in t for c in _WIDE):
                words = [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(t)]
                code_of = self.words.holding(words)
                out[i] = np.frombuffer(b"".join([code_of[w] for w in words]), "<u4")
            else:
                fast.append(i)
                raw.append(t.encode("utf-8", "surrogatepass"))
        if self.used > self.most:
            self._clear()
        parts, group, size = [], [], 0
        for r in raw:
            group.append(r)
            size += len(r)
            if size > _PART_BYTES:
                parts.append(self._part(group))
                group, size = [], 0
        if group:
            parts.append(self._part(group))
        self._learn(parts)
        for i, ids in zip(fast, chain.from_iterable(map(self._joined, parts)), strict=True):
            out[i] = ids
        return out


def in_parts(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


#: How a tokenizer file that drops white space and case splits text (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _caseless(text: str) -> str:
    """Composed and in lower case.

    Each character is lowered by itself, a sigma like any other.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte.

    Visible characters of Latin-1 stand for themselves, other bytes in their
    order for the letters from 256 on.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in visible else next(others)) for b in range(256)]


_LOADED: dict[tuple[str, str, bool], WordTable] = {}


def forget(keep: str | None = None) -> None:
    """Drop the tables of all tokenizer files but one."""
    for key in [k for k in _LOADED if k[0] != keep]:
        del _LOADED[key]


def added_tokens(tokenizer: Tokenizer) -> dict[str, int]:
    """Ids of a tokenizer's added tokens, which stand for themselves in raw text."""
    found = tokenizer.get_added_tokens_decoder()
    for t in found.values():
        if t.normalized or t.single_word or t.lstrip or t.rstrip:
            raise ValueError(f"added token {t.content!r} is not looked for as it stands in raw text")
    return {t.content: i for i, t in found.items()}


def library_table(
    path: str, pattern: str, space_counts: bool, added: bool = False, room: int = 1
) -> WordTable:
    """Texts encoded by the tokenizers library from a file, each distinct match once.

    With ``added`` a literal added token in a text gets its id, as by the library's
    default; else it is text like any other (``encode_special_tokens``).
    """
    if (path, pattern, added) not in _LOADED:
        from tokenizers import Tokenizer

        # White space, case and normal form are settled before; the library's model
        # gets matches in the letters that stand for bytes.
        tokenizer = Tokenizer.from_file(path)
        tokenize = tokenizer.model.tokenize
        letters = byte_letters()

        def encode(matches: list[str]) -> Iterator[bytes]:
            for m in matches:
                if m.isascii() and m.isprintable():
                    m = m.replace(" ", letters[32])
                else:
                    m = "".join([letters[b] for b in m.encode("utf-8", "surrogatepass")])
                yield array("I", [t.id for t in tokenize(m)]).tobytes()

        _LOADED[path, pattern, added] = WordTable(
            encode,
            pattern,
            space_counts,
            None if space_counts else _caseless,
            added_tokens(tokenizer) if added else None,
            room,
        )
    return _LOADED[path, pattern, added]
