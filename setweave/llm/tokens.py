"""Whole-text encoding with the tokenizers library at the speed of a dictionary lookup.

Both vocabularies in use cut a text at white space before any merge, so the ids of a text are the
ids of its blank-separated pieces put together. Pieces repeat; each is encoded once by the library
and then kept, in a cache of bounded size, as little-endian unsigned 32-bit ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept by an encoder, and the longest piece that is kept.
CACHE_PIECES, CACHE_CHARS = 300_000, 48
#: A word that comes so often among the texts at hand is kept.
OFTEN = 2
#: Pieces that are encoded together.
TOGETHER = 200

#: White space of either library but the blank and the newline (fixed values).
_ODD_SPACE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")


class _Cache(dict):
    """piece -> bytes of its ids; what is not held is encoded alone."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, piece: str) -> bytes:
        return self.encode(self.prefix + piece) if piece else b""


class Encoder:
    """Encodes texts as the library does with add_special_tokens=False. The strings of special tokens in a text are encoded as
    these tokens, as by default there; with special_as_text they are ordinary text.

    A byte-level vocabulary keeps a blank as the first character of the piece after it; a vocabulary
    that drops white space needs no such prefix. Any other kind is encoded text by text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or []) or "$^"
        pre = spec.get("pre_tokenizer") or {}
        self.kind = "other"
        if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
            marks = {i for t, i in spec["model"]["vocab"].items() if t.startswith("Ġ")}
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and spec["model"].get("end_of_word_suffix"):
            self.kind = "word"
            marks = {i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])}
        else:
            marks = set()
        self.size = self.tok.get_vocab_size()
        self.mark = np.zeros(self.size, bool)
        self.mark[list(marks)] = True
        self.first = _Cache(self._alone, "")
        self.rest = _Cache(self._alone, " ") if self.kind == "byte" else self.first

    def _alone(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _together(self, text: str) -> np.ndarray:
        """The ids of a text, without the offsets that encode() works out as well."""
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _trim(self, cache: _Cache, pieces: Collection[str]) -> Collection[str]:
        """Of a cache that is full, the pieces of the texts at hand stay, and so the common ones do."""
        if len(cache) > CACHE_PIECES:
            kept = {p: cache[p] for p in pieces if p in cache}
            cache.clear()
            cache.update(kept)
        return pieces

    def _learn(self, cache: _Cache, pieces: set[str]) -> None:
        """Encodes the unseen pieces together. A letter-only piece is one unit of the vocabulary and
        its end (or start) shows in the ids, so many are encoded as one text; others one by one."""
        new = pieces.difference(cache)
        if self.kind == "word":  # plain letters are lower-cased by the vocabulary: learned once
            capital = [p for p in new if p.isascii() and not p.islower() and p.lower() != p and len(p) <= CACHE_CHARS and not re.search(self.special, p.lower())]
            if capital:
                self._learn(cache, new.difference(capital).union(p.lower() for p in capital))
                for p in capital:
                    cache[p] = cache[p.lower()]
                return
        plain, stops, odd = [], [], []
        for p in new:
            if p.isalpha():
                if len(p) <= CACHE_CHARS:
                    plain.append(p)
            elif p and p[-1] in ".," and p[:-1].isalpha():
                if len(p) <= CACHE_CHARS:
                    stops.append(p)
            elif p and len(p) <= CACHE_CHARS:
                odd.append(p)
        if stops:
            plain += {p[:-1] for p in stops}.difference(cache, plain)
        for k in range(0, len(plain), TOGETHER):
            part = plain[k : k + TOGETHER]
            ids = self._together(cache.prefix + " ".join(part))
            bounds = np.flatnonzero(self.mark[ids])
            if self.kind == "word":
                bounds = np.concatenate([[0], bounds + 1])
            elif cache.prefix:
                bounds = np.concatenate([bounds, [len(ids)]])
            if len(bounds) == len(part) + 1 and bounds[0] == 0 and bounds[-1] == len(ids) and (self.kind == "word" or cache.prefix):
                data, at = ids.tobytes(), (4 * bounds).tolist()
                for w, i, j in zip(part, at, at[1:], strict=False):
                    cache[w] = data[i:j]
            else:
                odd += part
        for k in range(0, len(odd), TOGETHER):
            part = odd[k : k + TOGETHER]
            for w, e in zip(part, self.tok.encode_batch_fast([cache.prefix + w for w in part], add_special_tokens=False), strict=True):
                cache[w] = array("I", e.ids).tobytes()
        if stops:
            tail = {c: self._alone(c) for c in ".,"}
            for p in stops:
                cache[p] = cache[p[:-1]] + tail[p[-1]]

    def once(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ids of words without white space, nothing of which is kept: portions of positions, ids and how many each
        word has. Many words are encoded as one text, blanks between them, where the ids show their ends (or starts)."""
        if self.kind == "byte":
            ends, odd = np.array([bool(w) for w in words], np.int64), []
        else:
            ends = np.array([1 if w.isalpha() else 2 if w[-1:] in (".", ",") and w[:-1].isalpha() else 0 for w in words], np.int64)
            odd = [i for i in np.flatnonzero(ends == 0).tolist() if words[i]]
        easy = np.flatnonzero(ends)
        for k in range(0, len(easy), TOGETHER):
            part = easy[k : k + TOGETHER]
            ids = self._together(self.rest.prefix + " ".join([words[i] for i in part.tolist()]))
            marks, wanted = np.flatnonzero(self.mark[ids]), np.cumsum(ends[part])
            if self.kind == "byte" and len(marks) == len(part) and marks[0] == 0:
                yield part, ids, np.diff(marks, append=len(ids))
            elif self.kind == "word" and len(marks) == wanted[-1] and marks[-1] == len(ids) - 1:
                yield part, ids, np.diff(marks[wanted - 1], prepend=-1)
            else:
                odd += part.tolist()
        for k in range(0, len(odd), TOGETHER):
            part = odd[k : k + TOGETHER]
            got = [e.ids for e in self.tok.encode_batch_fast([self.rest.prefix + words[i] for i in part], add_special_tokens=False)]
            yield np.array(part), np.array([x for g in got for x in g], "<u4"), np.array([len(g) for g in got], np.int64)

    def lookup(self, words: list[str], times: np.ndarray) -> Table:
        """The ids of distinct words without white space (but for the first of a text, if a blank is part of a piece). Words
        that come OFTEN times are kept for later; the others are many, and are as fast to encode again."""
        self._trim(self.rest, words)
        known = list(map(self.rest.get, words))
        new = [i for i, k in enumerate(known) if k is None]
        begin, n = np.zeros(len(words), np.int64), np.fromiter([0 if k is None else len(k) // 4 for k in known], np.int64, len(words))
        parts = [np.frombuffer(b"".join([k for k in known if k is not None]), "<u4")]
        begin[:] = np.cumsum(n) - n
        size, new = len(parts[0]), np.array(new, np.int64)
        for at, ids, m in self.once([words[i] for i in new.tolist()]):
            n[new[at]], begin[new[at]] = m, size + np.cumsum(m) - m
            parts.append(ids)
            size += len(ids)
        ids = np.concatenate(parts)
        for i in new[times[new] >= OFTEN].tolist():
            if len(words[i]) <= CACHE_CHARS:
                self.rest[words[i]] = ids[begin[i] : begin[i] + n[i]].tobytes()
        return Table(ids, begin, n)

    def coded(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray, Table]:
        """Texts (null: empty) as entries of a table: the entries of all texts, where each text's begin and end among them,
        and the table of their ids. Each text ends with end_id."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if self.kind == "other":
            table = _joined([self._alone(t or "") for t in texts.to_pylist()])
            at, offsets = np.arange(len(texts)), np.arange(len(texts) + 1)
        elif self.kind == "word":
            at, offsets, words = cut_words(texts)
            lower = pc.ascii_lower(words)  # as the vocabulary does, but not where it would make a special token
            fold = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring_regex(lower, self.special)))
            folded = pc.if_else(fold, lower, words).dictionary_encode()
            at = folded.indices.to_numpy().astype(np.int64)[at]
            words = folded.dictionary.to_pylist()
            table = self.lookup(words, np.bincount(at, minlength=len(words)))
        else:
            texts = pc.fill_null(texts.cast(pa.string()), "")
            odd = _uneven(texts)
            plain = pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n ")
            at, offsets, words = _distinct(pc.split_pattern(plain, " "))
            words = words.to_pylist()
            first = np.zeros(len(at), bool)
            first[offsets[:-1]] = True
            line = words.index("\n") if "\n" in words else -1
            if line >= 0:
                first[1:] |= at[:-1] == line
                words[line] = ""
            table = self.lookup(words, np.bincount(at[~first], minlength=len(words)))
            starts = np.unique(at[first])
            self._learn(self.first, self._trim(self.first, {words[k] for k in starts.tolist()}))
            odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            more = _joined([self._alone("\n"), *[self.first[words[k]] for k in starts.tolist()], *self._odd(texts.take(pa.array(odd)).to_pylist())])
            place = np.zeros(len(words), np.int64)
            place[starts] = len(words) + 1 + np.arange(len(starts))
            if line >= 0:
                at[at == line] = len(words)
                place[line] = len(words)
            inner = first & (at < len(words))
            at[inner] = place[at[inner]]
            at[offsets[odd]] = len(words) + 1 + len(starts) + np.arange(len(odd))
            table = table.plus(more)
        if end_id is not None:
            at = np.insert(at, offsets[1:], len(table.n))
            offsets = offsets + np.arange(len(offsets))
            table = table.plus(Table(np.array([end_id], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64)))
        return at, offsets, table

    def flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after the other, each text's followed by end_id, and where each ends."""
        at, offsets, table = self.coded(texts, end_id)
        return table.gathered(at, offsets)

    def _odd(self, texts: list[str]) -> list[bytes]:
        """Texts with white space that is not single: cut only at blanks between other characters."""
        cut = [_INNER_BLANK.split(t) for t in texts]
        self._learn(self.rest, set(chain.from_iterable(c[1:] for c in cut)))
        return [self.first[c[0]] + b"".join(map(self.rest.__getitem__, c[1:])) for c in cut]

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if texts:
            ids, ends = self.flat(pa.array(texts, pa.string()))
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            yield from (data[i:j] for i, j in zip(at, at[1:], strict=False))


@dataclass
class Table:
    """A ragged table: the ids of all entries, where each entry's begin, and how many it has."""

    ids: np.ndarray
    begin: np.ndarray
    n: np.ndarray

    def plus(self, other: Table) -> Table:
        return Table(np.concatenate([self.ids, other.ids]), np.concatenate([self.begin, len(self.ids) + other.begin]), np.concatenate([self.n, other.n]))

    def gathered(self, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the given entries, one after the other, and where each range of entries between two offsets ends."""
        at = at[offsets[0] : offsets[-1]]
        many = self.n[at]
        ends = np.cumsum(many)
        size = int(many.sum())
        out = self.ids[np.repeat(self.begin[at] - (ends - many), many) + np.arange(size)]
        return out, np.concatenate([[0], ends])[offsets[1:] - offsets[0]]


def _joined(of: list[bytes]) -> Table:
    n = np.fromiter(map(len, of), np.int64, len(of)) // 4
    return Table(np.frombuffer(b"".join(of), "<u4"), np.cumsum(n) - n, n)


def _distinct(split: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    coded = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy().astype(np.int64)
    return coded.indices.to_numpy().astype(np.int64), offsets - offsets[0], coded.dictionary


def cut_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts (null: empty) cut at ASCII white space: the number of each word among the distinct ones, where each text's
    words begin and end, and the distinct words. Neighbouring white space gives empty words. lower folds A-Z."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    for c in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, c, " ")
    return _distinct(pc.split_pattern(texts, " "))


def _uneven(texts: pa.Array) -> pa.Array:
    """Whether white space is anything but single blanks and newlines between other characters."""
    out = pc.match_substring_regex(texts, _ODD_SPACE)
    for pair in ("  ", "\n\n", " \n", "\n "):
        out = pc.or_(out, pc.match_substring(texts, pair))
    for end in " \n":
        out = pc.or_(out, pc.or_(pc.starts_with(texts, end), pc.ends_with(texts, end)))
    return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of a vocabulary file, made once in each worker."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
