"""Personal data by fixed patterns, and more of it by a linear-chain conditional random field.

The field labels the words of a line from their shapes (runs of digits, letters or a mixture), their lengths and
the words beside them. It is trained in numpy on a small labelled table, once, on the driver. Most words can only be outside: where
the outside label leads by more than any pair of transitions can win back, the best path passes through it. So
only the runs between such words go through Viterbi, all runs of a batch together.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.frames import slices

KINDS = ["email", "ip", "card", "phone", "secret", "number"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of e-mail addresses, IPv4 addresses, card numbers and telephone numbers, by start and
    kind; leftmost and non-overlapping within a kind, in code points."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


LABELS = ["O", "B-secret", "I-secret", "B-number", "I-number"]
_TRAIL = "#*%&$!.,;:?"
_RUN = re.compile(r"[^\W_]+|.", re.S)


def _shape(word: str) -> str:
    out = ""
    for m in _RUN.finditer(word.strip("\"'`").rstrip(_TRAIL).strip("\"'`")):
        run = m[0]
        if run.isdigit():
            c = "D" if len(run) > 6 else "d"
        elif run.isalpha():
            c = "L" if len(run) > 30 else "x"
        elif run.isalnum():
            c = "M" if len(run) >= 16 else "m"
        else:
            c = run
        if not out.endswith(c):
            out += c
        if len(out) > 12:
            break
    return out


def features(word: str) -> list[str]:
    """What the field sees of a word itself: its shape, its length, how many digits it has."""
    digits = sum(map(str.isdigit, word))
    return ["bias", f"shape {_shape(word)}", f"length {min(len(word) // 4, 12)}", f"digits {min(digits, 12)}"]


def beside(word: str) -> list[str]:
    """What a word shows its neighbours: the word, or its shape if it has digits."""
    bare = word.strip("\"'`").rstrip(_TRAIL).lower()
    return [f"word {bare}"] if bare.isalpha() or not any(map(str.isalnum, bare)) else [f"shape {_shape(word)}"]


def labelled_table() -> list[str]:
    """The training table: lines with their spans marked as [[kind text]]. Keys and numbers are made by rule from
    the digests of their row's number."""
    out = []
    keys = ["token", "api_key", "secret", "password", "access_key", "auth", "key", "credential"]
    calls = ["call", "phone", "tel.", "telephone", "mobile", "fax", "number", "ssn"]
    for k in range(48):
        d = hashlib.sha256(str(k).encode()).hexdigest()
        n = str(int(d, 16))
        key = [d[:40], d[:32], d[:20] + "Qz" + d[20:30], d][k % 4]
        key = key.upper() if k % 8 == 5 else key
        quote = '"' if k % 3 else ""
        tail = ["", " and the rest of it.", " that was", "!!", "### then"][k % 5]
        word = keys[k % 8].upper() if k % 8 == 5 else keys[k % 8]
        out.append(f"before it {word} {'=' if k % 2 else ':'} [[secret {quote}{key}{quote}]]{tail}")
        number = [f"({n[:3]}) {n[3:6]}-{n[6:10]}", f"{n[:3]}-{n[3:6]}-{n[6:10]}", f"{n[:3]}-{n[3:5]}-{n[5:9]}", f"0{n[:2]} {n[2:9]}"][k % 4]
        out.append(f"please {calls[k % 8]} [[number {number}]] {['for it', 'today.', 'or write', ''][k % 4]}")
        # what only looks like it
        out.append([f"in {1900 + k * 2} there were {n[:3]} of them, {k} more", f"version {k % 9}.{k % 4} of the license", f"pages {k}-{k + 9} and {n[:4]}", f"Licensed under CC BY-NC {k % 5}.0.", f"on 20{k:02d}-0{k % 9 + 1}-1{k % 9} at {k % 24}:{n[:2]}", f"the number {n[:16]} is long {n[3:9]}", f"at {n[:2]}.{n[2:4]}.{n[4:6]}.{n[6:8]} and a.{n[:2]}@mail{k % 9}.example.com here", f"the token was a key of {k}% secret call"][k % 8])
        out.append(["the rest of the words are plain, and so on.", "LOUD!! WORDS,!! ALL!! OF!! THEM!!", "odd*** marks$$$ at%%% every### word&&&", "a | list | of | words", "éeau menteux où le être", "unreadablyconcatenatedsyllablesofnomeaningwhatever here", "call the token a secret number = password: none", "one-two three-four it's"][k % 8])
    return out


def _marked(line: str) -> tuple[list[str], list[int]]:
    words, labels = [], []
    for part in re.split(r"(\[\[.*?\]\]\S*)", line):
        if part.startswith("[["):
            kind, _, inner = part[2:].replace("]]", "").partition(" ")
            ws = inner.split()
            labels += [LABELS.index(("B-" if i == 0 else "I-") + kind) for i in range(len(ws))]
        else:
            ws = part.split()
            labels += [0] * len(ws)
        words += ws
    return words, labels


class Field:
    """Weights of features of a word, of the words before and after it, and of pairs of labels."""

    def __init__(self, table: list[str], steps: int = 250, rate: float = 0.15, decay: float = 2e-3):
        rows = [r for r in map(_marked, table) if r[0]]
        names: dict[str, int] = {}
        feats = []
        for words, _ in rows:
            feats.append([])
            for i, w in enumerate(words):
                f = features(w) + ["before " + x for x in (beside(words[i - 1]) if i else [])] + ["after " + x for x in (beside(words[i + 1]) if i + 1 < len(words) else [])]
                feats[-1].append([names.setdefault(x, len(names)) for x in f])
        self.names, K = names, len(LABELS)
        n, T = len(rows), max((len(r[0]) for r in rows), default=1)
        at = [(s, t, f) for s, fs in enumerate(feats) for t, ff in enumerate(fs) for f in ff]
        S, P, Fe = (np.array(x, int) for x in zip(*at, strict=True)) if at else (np.zeros(0, int),) * 3
        Y = np.full((n, T), -1)
        for s, (_, labels) in enumerate(rows):
            Y[s, : len(labels)] = labels
        length = (Y >= 0).sum(1)
        self.W, self.T = np.zeros((len(names), K)), np.zeros((K, K))
        params = [self.W, self.T]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            E = np.zeros((n, T, K))
            np.add.at(E, (S, P), self.W[Fe])
            grads = self._gradient(E, Y, length)
            gw = np.zeros_like(self.W)
            np.add.at(gw, Fe, grads[0][S, P])
            for p, g, a, b in zip(params, [gw, grads[1]], m, v, strict=True):
                g = g / max(n, 1) + decay * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        other = [y for y in range(K) if y]
        # what another label can win over the outside one through the labels beside it
        self.reach = max(self.T[a, y] + self.T[y, b] - self.T[a, 0] - self.T[0, b] for a in range(K) for b in range(K) for y in other) + 1e-6

    def _gradient(self, E: np.ndarray, Y: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the negative log likelihood of lines after an outside word, by the forward and backward recursions over all rows together."""
        n, T, K = E.shape
        lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
        A, Bk = np.zeros((n, T, K)), np.zeros((n, T, K))
        A[:, 0] = self.T[0] + E[:, 0]
        for t in range(1, T):
            A[:, t] = lse(A[:, t - 1, :, None] + self.T, 1) + E[:, t]
        for t in range(T - 2, -1, -1):
            back = lse(self.T[None] + (E[:, t + 1] + Bk[:, t + 1])[:, None, :], 2)
            Bk[:, t] = np.where((t + 1 < length)[:, None], back, 0)
        Z = lse(A[np.arange(n), np.maximum(length - 1, 0)], 1)
        on = (Y >= 0)[:, :, None]
        one = np.eye(K)[np.maximum(Y, 0)] * on
        gE = np.exp(A + Bk - Z[:, None, None]) * on - one
        gT = np.zeros((K, K))
        for t in range(T - 1):
            both = (t + 1 < length)[:, None, None]
            p = np.exp(np.minimum(A[:, t, :, None] + self.T + (E[:, t + 1] + Bk[:, t + 1])[:, None, :] - Z[:, None, None], 0)) * both
            gT += p.sum(0) - np.einsum("ni,nj->ij", one[:, t], one[:, t + 1])
        gT[0] += gE[:, 0].sum(0)
        return gE, gT

    def rows(self, word: str) -> np.ndarray:
        """(3, labels): what the word adds to its own labels, to those of the word after and of the word before it."""
        out = np.zeros((3, len(LABELS)))
        if not word:  # the end of a line: outside, and seen by none
            out[0, 1:] = -1e6
            return out
        for f in features(word):
            if f in self.names:
                out[0] += self.W[self.names[f]]
        for f in beside(word):
            for k, side in ((1, "before "), (2, "after ")):
                if side + f in self.names:
                    out[k] += self.W[self.names[side + f]]
        return out

    def viterbi(self, E: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
        """The best labels of the runs (ranges of rows of E), each between two outside words; runs of like length go together."""
        label = np.zeros(len(E), np.int8)
        runs = sorted(runs, key=lambda r: r[1] - r[0])
        for k in range(0, len(runs), 4096):
            part = runs[k : k + 4096]
            lo, n = np.array([r[0] for r in part]), np.array([r[1] - r[0] for r in part])
            T = int(n.max())
            score, back = self.T[0] + E[lo], np.zeros((T, len(part), len(LABELS)), np.int8)
            for t in range(1, T):
                live = n > t
                step = score[live][:, :, None] + self.T
                back[t, live] = step.argmax(1)
                score[live] = step.max(1) + E[lo[live] + t]
            y = (score + self.T[:, 0]).argmax(1)
            for t in range(T - 1, -1, -1):
                live = n > t
                label[lo[live] + t] = y[live]
                if t:
                    y[live] = back[t, live, y[live]]
        return label


class _Index(dict):
    """word -> number of its rows of weights. Words that look alike share them."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.alike, self.table = field, {}, []
        self[""] = 0
        self.table.append(field.rows(""))

    def __missing__(self, word: str) -> int:
        rows = self.field.rows(word)
        key = rows.tobytes()
        k = self.alike.get(key)
        if k is None:
            k = self.alike[key] = len(self.table)
            self.table.append(rows)
        if len(word) <= 48:
            self[word] = k
        return k


@lru_cache(4)
def _trained(table: tuple[str, ...]) -> tuple[Field, _Index]:
    field = Field(list(table))
    return field, _Index(field)


_held: dict[str, _Index] = {}


def _received(shared: Broadcast) -> _Index:
    """The field as the driver has trained it, unpacked once in each worker: all tasks of a job have the same weights."""
    data = shared.value
    key = hashlib.sha256(data).hexdigest()
    if key not in _held:
        _held.clear()
        _held[key] = _Index(pickle.loads(data))
    return _held[key]


def _shared(spark: SparkSession, table: list[str] | None) -> Broadcast:
    """The field trained on the table, some hundreds of kilobytes at most for a table of some hundred lines."""
    return spark.sparkContext.broadcast(pickle.dumps(_trained(tuple(labelled_table() if table is None else table))[0]))


def _blank(text: str) -> str:
    """The text with each white space as one blank, line ends as two: an empty word between lines."""
    for c in "\t\v\f\r":
        if c in text:
            text = text.replace(c, " ")
    return text.replace("\n", "  ")


def field_spans(texts: list[str], index: _Index) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the index's field finds in each text."""
    field = index.field
    if len(index) > 400_000:
        index.clear()
        index[""] = 0
    cut = [_blank(t).split(" ") for t in texts]
    at = np.cumsum([0, *[len(c) + 1 for c in cut]])
    ids = np.zeros(int(at[-1]) + 2, np.int64)  # an empty word before, between and after the texts
    for c, k in zip(cut, at.tolist(), strict=False):
        ids[k + 1 : k + 1 + len(c)] = list(map(index.__getitem__, c))
    rows = np.array(index.table)
    E = rows[ids, 0]
    E[1:] += rows[ids[:-1], 1]
    E[:-1] += rows[ids[1:], 2]
    open_ = (E[:, 0] - E[:, 1:].max(1) <= field.reach) & (ids > 0)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not open_.any():
        return out
    edge = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]])))
    label = field.viterbi(E, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    hits = np.flatnonzero(label)
    if not len(hits):
        return out
    of = np.searchsorted(at, hits - 1, side="right") - 1
    for d in np.unique(of).tolist():
        mine = hits[of == d]
        # the ordinal of a word among the text's words gives its place
        word = np.cumsum([bool(w) for w in cut[d]]) - 1
        places = [m.span() for m in _WORDS.finditer(texts[d])]
        for h in mine.tolist():
            s, e = places[word[h - 1 - int(at[d])]]
            while s < e and texts[d][s] in "\"'`":
                s += 1
            while e > s and texts[d][e - 1] in "\"'`" + _TRAIL:
                e -= 1
            name = LABELS[label[h]]
            kind = KINDS.index(name[2:])
            if name[0] == "I" and out[d] and out[d][-1][1] == kind and label[h - 1]:
                out[d][-1] = (out[d][-1][0], kind, e)
            elif e > s:
                out[d].append((s, kind, e))
    return out


def spans(texts: list[str], index: _Index) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the base spans, and all spans: those of the field are added where they meet no base span."""
    for t, more in zip(texts, field_spans(texts, index), strict=True):
        base = base_spans(t)
        more = [m for m in more if not any(s < m[2] and m[0] < e for s, _, e in base)]
        yield base, sorted(base + more)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _find(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _received(shared)
        for b in slices(batches, 1000):
            rows = []
            for base, every in spans([t or "" for t in b.column(1).to_pylist()], index):
                n = [0] * 4
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table: list[str] | None = None) -> DataFrame:
    """Counts of base spans, their digest and all spans of each row's whole text (null: empty, no spans). Rows of
    equal text get equal values; other columns are not read; table is the field's training table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find(_shared(docs.sparkSession, table)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span, those that overlap together, as its kind in brackets."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _mask(column: int, shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _received(shared)
        for b in slices(batches, 1000):
            texts = b.column(column).to_pylist()
            new = [t if t is None else masked(t, every) for t, (_, every) in zip(texts, spans([t or "" for t in texts], index), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == column else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return run


def mask(docs: DataFrame, *, text_col: str = "text", table: list[str] | None = None) -> DataFrame:
    """docs with every span of personal data in the text replaced by its kind; a null or empty text stays as it is. Repeated rows
    and ids are all kept, and so are all columns whatever their names; equal texts give equal texts; an empty table stays empty."""
    return docs.mapInArrow(_mask(docs.columns.index(text_col), _shared(docs.sparkSession, table)), docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
