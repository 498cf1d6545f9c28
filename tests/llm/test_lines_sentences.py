"""Line dedup and sentence spans against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from odd import ODD
from mailtables.llm import lines, sentences


def later_copies(rows, cut, name, width, fits, join):
    """Units in a window of `width` units that an earlier place has; rows of one id and text are one document."""
    documents = sorted({(i if i is not None else 1 << 62, t or "") for i, t, _ in rows})
    seen, out = set(), {}
    for place, text in documents:
        units = cut(text)
        gone = [False] * len(units)
        for start in range(len(units) - width + 1):
            window = tuple(name(u) for u in units[start:start + width])
            if not fits(window):
                continue
            if window in seen:
                gone[start:start + width] = [True] * width
            seen.add(window)
        kept = join.join(u for u, g in zip(units, gone) if not g)
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out[place, text] = (len(units), sum(gone), runs, hashlib.sha256(kept.encode()).hexdigest())
    return Counter((i, *out[i if i is not None else 1 << 62, t or ""]) for i, t, _ in rows)


def brute_lines(rows, width):
    return later_copies(rows, lambda t: t.split("\n"), lambda u: u, width, lambda w: True, "\n")


def brute_sentences(rows, width, least):
    return later_copies(
        rows, sentences.sentences, lambda u: " ".join(u.split()), width, lambda w: len(" ".join(w).split()) >= least, ""
    )


def texts(seed, joint):
    numbers = random.Random(seed)
    units = [f"unit {i} has {'word ' * (i % 4)}{i}." for i in range(40)]
    rows = []
    for i in range(150):
        own = [numbers.choice(units[:12]) if numbers.random() < 0.5 else f"own {i} {j} words." for j in range(numbers.randrange(0, 14))]
        if numbers.random() < 0.4:
            start = numbers.randrange(0, 30)
            own[numbers.randrange(0, len(own) + 1):0] = units[start:start + numbers.randrange(2, 9)]
        rows.append((i, joint.join(own), "s"))
    rows += [(500 + i, rows[7][1], "s") for i in range(3)] + [(7, rows[7][1], "s"), (600, joint.join([units[3]] * 30), "s")]
    rows += [(700, None, None), (701, "", "s"), (None, rows[9][1], "s"), (None, rows[9][1], "s")]
    return rows


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_line_runs(docs, width):
    rows = texts(width, "\n")
    out = lines.dedup_lines(docs(rows), width).collect()
    got = Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["n_runs"], r["kept_sha256"]) for r in out)
    assert got == brute_lines(rows, width)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in out)


@pytest.mark.parametrize("width, least", [(3, 12), (2, 0), (1, 5)])
def test_sentence_spans(docs, width, least):
    rows = texts(width, " ")
    out = sentences.dedup_sentences(docs(rows), width, least).collect()
    got = Counter((r["doc_id"], r["n_sentences"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert got == brute_sentences(rows, width, least)


def test_odd_rows(docs):
    assert Counter(map(tuple, lines.dedup_lines(docs(ODD), texts=False).collect())) == brute_lines(ODD, 3)
    assert Counter(map(tuple, sentences.dedup_sentences(docs(ODD), texts=False).collect())) == brute_sentences(ODD, 3, 12)
    assert lines.dedup_lines(docs([])).count() == 0 and sentences.dedup_sentences(docs([])).count() == 0


def test_sentences_make_up_the_text():
    for text in ("", "One. Two!\n\n Three?  Four", "3.14 is no end. \n", "...\n", "no end", "é! ü?"):
        assert "".join(sentences.sentences(text)) == text
    assert sentences.sentences("One. Two!\nThree 3.14 x") == ["One. ", "Two!\n", "Three 3.14 x"]


def test_a_passage_within_other_text_is_found(docs):
    passage = " ".join(f"Sentence {i} of the passage has nine words in it." for i in range(6))
    rows = [(1, f"Alpha begins. {passage} Alpha ends.", "a"), (2, f"Beta opens here. {passage} Beta closes.", "b"), (3, "Quite clean. Really. Yes.", "c")]
    got = {r["doc_id"]: r for r in sentences.dedup_sentences(docs(rows)).collect()}
    assert got[1]["kept"] == rows[0][1] and got[3]["kept"] == rows[2][1]
    assert got[2]["kept"] == "Beta opens here. Beta closes." and got[2]["n_spans"] == 1
