"""Spelling variants against a brute force over all pairs of a small vocabulary."""

import re
import zlib
from collections import Counter

from odd import ODD
from mailtables.llm import spelling


def _edited(doc_id, run):
    low = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
    return low[: h % len(low)] + low[h % len(low) + 1:] if h % 31 == 0 else low


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def brute(rows):
    n = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall(spelling.RUN, text or ""):
            word = _edited(doc_id, run)
            if len(word) >= 7:
                n[word] += 1
    words = {w: c for w, c in n.items() if c >= 2}
    out = {}
    for w, c in words.items():
        near = [v for v in words if v != w and _near(w, v)]
        best = min(near, key=lambda v: (-words[v], v)) if near else None
        form = best if best is not None and words[best] >= 10 * c else None
        out[w] = [form, c, len(near), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row.append(root)
    return out


def test_against_brute_force(docs):
    vocabulary = ["colour", "colours", "coloured", "coloureds", "colouring", "aaaaaaa", "aaaaaaaa", "aaaaaaab",
                  "Straße", "strasse", "straßen", "Übersee", "übersee", "ubersee", "recieved", "received", "receivedd"]
    rows = []
    for i in range(400):
        words = [vocabulary[(i * 7 + k * k) % len(vocabulary)] for k in range(1 + i % 9)]
        if i % 4 == 0:
            words += ["received"] * 12 + ["coloured"] * 25 + ["aaaaaaaa"] * 30
        rows.append((i, " ".join(words) + ". Colouring, RECEIVED!", f"s{i % 3}"))
    rows += ODD
    want = brute(rows)
    got = {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"], r["root"]]
           for r in spelling.spelling_groups(docs(rows)).collect()}
    assert got == want
    assert any(v[0] is not None for v in got.values())


def test_chains_follow_forms_to_the_end(docs):
    # n: abcdefgh 2, abcdefgx 20, abcdefyx 300 (less a few shortened by the crc rule): the first word's root is two forms away
    rows = [(i, "abcdefgh abcdefgh" if i == 0 else "", "s") for i in range(1)]
    rows += [(100 + i, "abcdefgx", "s") for i in range(20)] + [(1000 + i, "abcdefyx", "s") for i in range(300)]
    want = brute(rows)
    got = {r["word"]: r["root"] for r in spelling.spelling_groups(docs(rows)).collect()}
    assert got == {w: v[4] for w, v in want.items()}
    assert want["abcdefgh"][4] == "abcdefyx"


def test_odd_and_empty(docs):
    assert spelling.spelling_groups(docs([])).count() == 0
    got = {r["word"]: r["n"] for r in spelling.spelling_groups(docs(ODD)).collect()}
    assert got == {w: v[1] for w, v in brute(ODD).items()}
