"""Patterns against plain regular expressions; the field's training, decoding and use."""

import hashlib
import random
import re

import numpy as np
from messy import documents

from setweave.llm import pii as P


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m[0])
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(5)
    parts = ["a", "@", ".", "1", "23", "255", "256", " ", "-", "+", "(", ")", "4111111111111111", "é", "x@y.z", "1.2.3.4", "%", "\n", "_", "378282246310005", "+1 234 567 8901", "00000255.0.0.1"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert P.base_spans(t) == plain(t), t
    for t in ("1" * 200_000, "a" * 100_000 + "@" * 2000, "1." * 50_000, "+1" * 50_000):
        P.base_spans(t)  # in time that grows with the length


TABLE = tuple(P.labelled_table())
INDEX = P._trained(TABLE)[1]


def test_the_field_learns_its_table():
    wrong = 0
    for line in TABLE:
        words, labels = P._marked(line)
        wrong += len(P.field_spans([" ".join(words)], INDEX)[0]) != sum(P.LABELS[x][0] == "B" for x in labels)
    assert wrong == 0


def test_unseen_lines():
    key = hashlib.sha1(b"unseen").hexdigest()
    text = f'plain words token = "{key}" and then\ncall (212) 555-0188 today\nversion 3.2 of 2019, pages 10-20'
    (found,) = P.field_spans([text], INDEX)
    assert [(P.KINDS[k], text[s:e]) for s, k, e in found] == [("secret", key), ("number", "(212) 555-0188")]
    assert P.field_spans(["all of these are plain words.", "", "\n\n", "LOUD!! WORDS!!"], INDEX) == [[], [], [], []]


def test_runs_between_certain_words_decode_as_the_whole():
    field, _ = P._trained(TABLE)
    rng = np.random.default_rng(0)
    for seed in range(5):
        E = rng.normal(0, 3, (300, len(P.LABELS)))
        E[:, 0] += rng.integers(0, 2, 300) * 40
        score, back = field.T[0] + E[0], []
        for e in E[1:]:
            step = score[:, None] + field.T
            back.append(step.argmax(0))
            score = step.max(0) + e
        y = int((score + field.T[:, 0]).argmax())
        whole = [y]
        for b in reversed(back):
            whole.append(y := int(b[y]))
        open_ = (E[:, 0] - E[:, 1:].max(1) <= field.reach).astype(int)
        edge = np.flatnonzero(np.diff([0, *open_, 0]))
        got = field.viterbi(E, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
        assert got.tolist() == whole[::-1], seed


def unseen(n=400):
    """Texts with marked spans, of other keys, numbers, neighbours and places than the training table's."""
    rng = random.Random(77)
    plain = "the of reading ontha ered. vexillum, ordinary rooms 1987 14 a-b (see p. 12) it's 3.5 über | x2 CC-BY 4.0 éa 100%".split()
    out = []
    for k in range(n):
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))
        d = "".join(rng.choice("0123456789") for _ in range(10))
        secret = f"{rng.choice(['token', 'password', 'api_key', 'secret'])} {rng.choice('=:')} [[secret {rng.choice([hexa, chr(34) + hexa + chr(34)])}]]"
        number = f"{rng.choice(['call', 'phone', 'fax', 'mobile'])} [[number {rng.choice([f'({d[:3]}) {d[3:6]}-{d[6:]}', f'{d[:3]}-{d[3:6]}-{d[6:]}'])}]]"
        words = lambda: " ".join(rng.choice(plain) for _ in range(rng.randint(3, 25)))
        out.append(" ".join([words(), *([secret, words()] if k % 3 == 0 else [number, words()] if k % 3 == 1 else [])]))
    return out


def test_precision_and_recall_on_unseen_texts():
    found = wanted = right = 0
    for line in unseen():
        words, labels = P._marked(line)
        text, at, want = " ".join(words), 0, set()
        for w, y in zip(words, labels, strict=True):
            if P.LABELS[y][0] == "B":
                want.add((at, P.LABELS[y][2:]))
            at += len(w) + 1
        got = {(s - (text[s - 1 : s] == '"'), P.KINDS[k]) for s, k, _ in P.field_spans([text], INDEX)[0]}
        found, wanted, right = found + len(got), wanted + len(want), right + len(got & want)
    assert wanted == 267 and right >= 0.95 * wanted and right >= 0.95 * found, (found, wanted, right)


def test_gradient():
    field, _ = P._trained(TABLE)
    E = np.random.default_rng(1).normal(size=(2, 3, len(P.LABELS)))
    Y, length = np.array([[0, 1, 2], [3, 0, -1]]), np.array([3, 2])

    def loss(E):
        import itertools

        out = 0
        for s in range(2):
            value = lambda y, s=s: field.T[0, y[0]] + sum(E[s, t, y[t]] for t in range(length[s])) + sum(field.T[y[t], y[t + 1]] for t in range(length[s] - 1))
            out += np.log(sum(np.exp(value(y)) for y in itertools.product(range(len(P.LABELS)), repeat=int(length[s])))) - value(Y[s])
        return out

    g = field._gradient(E, Y, length)[0]
    for s, t, k in ((0, 0, 1), (0, 2, 2), (1, 1, 3)):
        d = np.zeros_like(E)
        d[s, t, k] = 1e-5
        assert abs((loss(E + d) - loss(E - d)) / 2e-5 - g[s, t, k]) < 1e-5


def test_messy_documents(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    got = sorted(P.find(docs).collect(), key=lambda r: (str(r["doc_id"]), r["base_sha256"], r["spans"]))
    assert len(got) == len(rows)
    for r in got:
        texts = [x["text"] or "" for x in rows if x["doc_id"] == r["doc_id"]]
        assert r["base_sha256"] in {hashlib.sha256(P.joined(plain(t)).encode()).hexdigest() for t in texts}
    (r,) = [r for r in got if r["n_email"]]
    assert (r["n_email"], r["n_phone"]) == (1, 1) and r["spans"].startswith("email:")
    masked = P.mask(docs)
    assert masked.columns == docs.columns
    texts = {x["doc_id"]: x["text"] for x in masked.collect()}
    assert texts[10] == "mail me at [EMAIL] or [PHONE]" and texts[0] is None
    assert P.find(docs.limit(0)).count() == 0 and P.mask(docs.limit(0)).count() == 0


def test_masking_overlaps():
    assert P.masked("abcdefgh", [(1, 0, 4), (2, 2, 5), (6, 3, 7)]) == "a[EMAIL]f[PHONE]h"
