"""Periodic runs against plain loops over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from cases import LONG, ODD, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import periodic, queries


def smallest_period(words):
    border, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - border[-1]


def brute(words, least=24, times=3):
    out = set()
    for q in range(1, len(words) // times + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                length = i + q - start
                if length >= max(least, times * q) and smallest_period(words[start: start + length]) == q:
                    out.add((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = brute(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.sampled_from([(4, 2), (6, 3), (24, 3), (2, 2), (9, 4)]))
def test_two_letters(letters, limits):
    words = [x.encode() for x in letters]
    got = periodic.find_runs([words, words[::-1], []], *limits)
    assert [tuple(r) for r in got[0]] == brute(words, *limits)
    assert [tuple(r) for r in got[1]] == brute(words[::-1], *limits)
    assert len(got[2]) == 0


def planted(rng, size, letters):
    words = [rng.choice(letters) for _ in range(size)]
    for _ in range(rng.randrange(4)):
        at, q = rng.randrange(size), rng.randrange(1, 30)
        for k in range(at + q, min(size, at + q * rng.randrange(2, 8) + rng.randrange(q))):
            words[k] = words[k - q]
    return words


def test_planted_runs_in_many_texts():
    rng = random.Random(1)
    texts = [planted(rng, rng.randrange(1, 400), [f"w{k}" for k in range(n)]) for n in (2, 3, 5, 40, 400) for _ in range(25)]
    got = periodic.find_runs([[w.encode() for w in t] for t in texts])
    for words, runs in zip(texts, got):
        assert [tuple(r) for r in runs] == brute(words)


def test_fibonacci_words():
    a, b = ["x"], ["x", "y"]
    while len(b) < 600:
        a, b = b, b + a
    for limits in ((24, 3), (24, 2)):
        assert [tuple(r) for r in periodic.find_runs([[w.encode() for w in b]], *limits)[0]] == brute(b, *limits)


def test_a_long_text_of_one_word():
    words = [b"na"] * 300_000 + [b"batman"]
    assert [tuple(r) for r in periodic.find_runs([words])[0]] == [(0, 300_000, 1)]
    assert periodic.collapse(words, np.array([[0, 300_000, 1]])) == [b"na", b"batman"]


def test_documents(spark, monkeypatch):
    rng = random.Random(4)
    short = [r for r in ODD if len(r[1] or "") < 10_000]  # the plain loops are slow
    rows = [*short, (6, " ".join(LONG.split()[:3000]), "a"), (20, "la " * 30, "a"), (21, "la\x0bla\x1cla " * 40, "a"), (22, "a b " * 11 + "a b", "a"), (23, "a b " * 12, "a")]
    rows += [(100 + k, " ".join(planted(rng, 300, ["x", "y", "zz"])), "b") for k in range(60)]
    docs = clashing(documents(spark, rows))
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, "").collect()), key=key)
    assert got == sorted((brute_row(i, t) for i, t, _ in rows), key=key)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
