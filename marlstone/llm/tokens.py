"""Tokenizing whole texts with a public tokenizer file, inside tasks."""

from __future__ import annotations

import json
import re

import numpy as np

#: Pieces whose ids a Python worker holds in each of two generations; the older is dropped when the newer is full.
REMEMBERED = 300_000
CHUNK = 200
#: Texts of these characters alone are lower-cased, composed and split alike by every Unicode version.
_LETTERS = "À-ÖØ-öø-įı-ňŊ-ž"
PLAIN = rf"[\t\n\x0b\f\r -~{_LETTERS}]*"
#: Among them, once lower-cased: the letters and the digits.
_LOWER = {r"\p{L}": "a-zß-öø-ž", r"\p{N}": "0-9"}
#: The pattern that is also read from bytes, all texts of a batch at once: its words after an apostrophe, and what each byte
#: of a plain, lower-cased text is. A plain text's characters beyond ASCII are letters.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHORT = [w.encode() for w in ("s", "t", "re", "ve", "m", "ll", "d")]
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.array([_LETTER if b > 127 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SPACE if b in b"\t\n\x0b\f\r " else _OTHER for b in range(256)], dtype=np.uint8)
#: Marks a word, among pieces, that goes through the tokenizer whole. No plain text holds it.
_WHOLE = "\0"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, without special tokens, as little-endian unsigned 32-bit bytes.

    A tokenizer that drops white space and marks the ends of words encodes each piece that its pattern finds by itself,
    so a piece is encoded once and then looked up. New pieces are encoded in chunks and told apart by their end marks.
    The plain texts of a batch are split together, as arrays of bytes, and each piece is looked up once for all of them.
    Words of unusual characters, and all texts of other tokenizers, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_piece = bool(suffix) and split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert"))
        if self.by_piece:
            self.find, self.plain = _finder(split["pattern"]["Regex"]), re.compile(PLAIN).fullmatch
            self.by_bytes = split["pattern"]["Regex"] == _PATTERN
            self.special = [t["content"] for t in spec["added_tokens"]]
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            self.pieces_only = Tokenizer.from_file(path)
            self.pieces_only.normalizer = None
            self.pieces_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ids: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_plain(self, text: str) -> bool:
        return bool(self.plain(text)) and not ("<|" in text and any(s in text for s in self.special))

    def _pieces(self, text: str) -> list[str]:
        """What the text's ids are joined from."""
        if self._is_plain(text):
            return self.find(text.lower())
        out = []
        for word in text.replace("\n", " ").split(" "):
            if self.plain(word) and not any(s in word for s in self.special):
                out += self.find(word.lower())
            else:
                out.append(_WHOLE + word)
        return out

    def _learn(self, new: list[str]) -> None:
        odd = [p for p in new if p[0] == _WHOLE]
        self.ids.update(zip(odd, self._whole([p[1:] for p in odd]), strict=True))
        if odd:
            new = [p for p in new if p[0] != _WHOLE]
        for k in range(0, len(new), CHUNK):
            chunk = new[k : k + CHUNK]
            ids = np.array(self.pieces_only.encode_batch_fast([" ".join(chunk)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(chunk):
                self.ids.update(zip(chunk, self._whole(chunk), strict=True))
                continue
            stops = stops.tolist()
            self.ids.update(zip(chunk, map(ids.tobytes().__getitem__, map(slice, [0, *stops], stops)), strict=False))

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of different pieces."""
        if len(self.ids) > REMEMBERED:
            self.ids, self.older = {}, self.ids
        out = list(map(self.ids.get, pieces))
        missing = [k for k, v in enumerate(out) if v is None]
        new = []
        for k in missing:
            if (old := self.older.get(pieces[k])) is None:
                new.append(pieces[k])
            else:
                self.ids[pieces[k]] = old
        if new:
            self._learn(new)
        for k in missing:
            out[k] = self.ids[pieces[k]]
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of plain, lower-cased texts."""
        found, firsts = pieces_of(texts)
        coded = found.dictionary_encode()
        values, codes = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        ids, lengths = np.frombuffer(b"".join(values), dtype="<u4"), np.fromiter(map(len, values), np.int64, len(values)) >> 2
        starts, n = np.cumsum(lengths) - lengths, lengths[codes]
        after = np.r_[0, np.cumsum(n)]
        joined = ids[np.repeat(starts[codes] - after[:-1], n) + np.arange(after[-1])].tobytes()
        ends = (after[firsts] * 4).tolist()
        return [joined[x:y] for x, y in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if not self.by_piece:
            return self._whole(texts)
        together = [self.by_bytes and self._is_plain(t) for t in texts]
        plain = iter(self._joined([t.lower() for t, p in zip(texts, together, strict=True) if p]) if any(together) else ())
        found = [None if p else self._pieces(t) for t, p in zip(texts, together, strict=True)]
        every = list(set().union(*(p for p in found if p)))
        get = dict(zip(every, self._known(every), strict=True)).__getitem__
        return [next(plain) if p is None else b"".join(map(get, p)) for p in found]


def pieces_of(texts: list[str]):
    """The pieces that ``_PATTERN`` finds in plain, lower-cased texts, as an Arrow array, and where each text's begin in it, then their number."""
    import pyarrow as pa

    encoded = [t.encode() for t in texts]
    whole = b"\n".join([b"", *encoded, b"   "])  # white space before the first byte, and after the last one enough for any word
    raw = np.frombuffer(whole, dtype=np.uint8)
    kind = _CLASS[raw]
    first = np.zeros(len(raw), dtype=bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    kept = kind != _SPACE
    first &= kept
    marks = np.flatnonzero(raw == ord("'"))
    marks = marks[(kind[marks - 1] != _OTHER) & (kind[marks + 1] == _LETTER)]
    for word in _SHORT if len(marks) else ():
        met = np.logical_and.reduce([raw[marks + 1 + k] == b for k, b in enumerate(word)])
        at, marks = marks[met], marks[~met]
        first[at + 1] = False
        after = at + 1 + len(word)
        first[after] = kept[after]
    starts = np.flatnonzero(first)
    places = np.r_[np.cumsum(kept)[starts] - 1, np.count_nonzero(kept)]
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw[kept]))
    begins = np.cumsum([1, *(len(t) + 1 for t in encoded)])
    return found, np.searchsorted(starts, begins)


def _finder(pattern: str):
    """All matches of a tokenizer's pattern in a plain, lower-cased text: by the standard library where its classes can be spelt out."""
    import regex

    spelt = pattern
    for name, chars in _LOWER.items():
        spelt = spelt.replace(name, chars)
    try:
        return re.compile(spelt).findall if spelt.isprintable() and "\\p" not in spelt else regex.compile(pattern).findall
    except re.error:
        return regex.compile(pattern).findall


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
