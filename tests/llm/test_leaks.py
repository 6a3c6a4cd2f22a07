import random
import re
import unicodedata

import numpy as np
import pytest

from barloom.llm import leaks, words

DOCS = "doc_id long, text string, id int, item_id int, exact int"
ITEMS = "item_id string, passage string, doc_id int, id int"


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 1, 1) for i, t in docs], DOCS)
    p = spark.createDataFrame([(i, t, 1, 1) for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id): r.exact for r in leaks.leaks(d, "doc_id", "text", p, "item_id", "passage", **more).collect()}


def tokens(text):
    text = unicodedata.normalize("NFKC", re.sub("[­​﻿]", "", text or "")).casefold()
    return re.findall(r"[^\W_]+", text)


def brute(docs, items, n=15):
    index = {}
    for k, p in items:
        w = tokens(p)
        for i in range(len(w) - n + 1):
            index.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = set()
    for d, t in docs:
        w = tokens(t)
        for i in range(len(w) - n + 1):
            out |= {(d, k) for k in index.get(tuple(w[i : i + n]), ())}
    return out


@pytest.mark.parametrize("seed, short", [(0, False), (1, False), (2, True)])
def test_exact_leaks_equal_brute_force(spark, seed, short):
    r = random.Random(seed)
    vocabulary = ["a", "b", "of", "I", "x9"] if short else [f"{''.join(r.choice('aeioulrnst') for _ in range(r.randrange(1, 9)))}" for _ in range(60)]
    passage = lambda n: [r.choice(vocabulary) for _ in range(n)]
    own = [passage(r.choice([5, 14, 15, 40, 60])) for _ in range(25)]
    own.append(own[3][:10] + own[4][-10:])
    items = [(f"e{i}", " ".join(w)) for i, w in enumerate(own)] + [("none", None), ("empty", ""), ("e0", " ".join(own[0]))]
    docs = [(0, None), (1, ""), (2, "  \n")]
    for i in range(60):
        w = r.choice(own)
        n = r.choice([14, 15, 16, len(w)])
        at = r.randrange(0, max(1, len(w) - n + 1))
        piece = [x.upper() if r.random() < 0.3 else x for x in w[at : at + n]]
        glue = r.choice([" ", "\n", ", ", " ​", " - "])
        docs.append((10 + i, " ".join(passage(r.randrange(0, 30))) + r.choice([" ", "\n", '"']) + glue.join(piece) + r.choice(["", ". ", "x"]) + " " + " ".join(passage(8))))
    docs += [docs[12], (500, docs[13][1])]
    got = run(spark, docs, items)
    assert {k for k, exact in got.items() if exact} == brute(docs, items)


def test_what_does_not_count(spark):
    words_ = "the café ﬁne print of ten articles was signed by the straße board on May 12th".split()
    assert len(words_) == 16
    passage = " ".join(words_)
    variants = ["THE CAFÉ, ﬁne print; of TEN ar­ticles was signed by the STRASSE board on MAY", passage.replace("ﬁne", "fine").replace(" ", "\r\n　"), "ten​ articles ".join(passage.split("ten articles "))]
    assert run(spark, list(enumerate(variants)), [("e", passage)]) == {(i, "e"): True for i in range(3)}
    assert run(spark, [(0, passage.replace("print", "pr-int"))], [("e", passage)], edits=0) == {}


def test_edits(spark):
    r = random.Random(4)
    w = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(40)]
    changed = w[:20] + ["X" + w[20][1:]] + w[21:]
    far = [x if i % 4 else "zzzz" for i, x in enumerate(w)]
    docs = [(1, " ".join(changed[8:32])), (2, " ".join(far)), (3, " ".join(w[:20]))]
    assert run(spark, docs, [("e", " ".join(w))]) == {(1, "e"): False, (3, "e"): True}
    assert run(spark, docs, [("e", " ".join(w))], edits=0) == {(3, "e"): True}


def test_blocks_long_texts_and_empty_tables(spark):
    r = random.Random(6)
    w = [["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(20)] for _ in range(6)]
    items = [(f"e{i}", " ".join(x)) for i, x in enumerate(w)]
    long = "filler text " * 200_000 + " ".join(w[5]) + " more" * 10
    docs = [(1, " ".join(w[0])), (2, long)]
    assert run(spark, docs, items, block_chars=300) == {(1, "e0"): True, (2, "e5"): True}
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_spaced_words():
    cp, edge = words.spaced_words(["One, two!", None, "", "\x00x"])
    text = cp.tobytes().decode("utf-32-le")
    assert text.split() == ["one", "two", "x"] and len(edge) == 5


def apart(a, b):
    """Least edits between a and any part of b, by the whole table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_several_edits_in_one_passage(spark):
    r = random.Random(8)
    w = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(140)]
    typo = lambda ws, at: [x[:2] + "x" + x[3:] if i in at else x for i, x in enumerate(ws)]
    docs = [(1, " ".join(typo(w[:28], (4, 19)))), (2, " ".join(typo(w, range(0, 140, 12)))), (3, " ".join(typo(w, range(0, 140, 6)))), (4, " ".join(typo(w[:15], (0,)))), (5, " ".join(typo(w[:15], (14,))))]
    assert run(spark, docs, [("e", " ".join(w))]) == {(1, "e"): False, (2, "e"): False, (4, "e"): False, (5, "e"): False}


@pytest.mark.parametrize("edits", [1, 2])
def test_edited_leaks_equal_brute_force(edits):
    r = random.Random(edits)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(5, 9)))
    own = [[word() for _ in range(n)] for n in (6, 7, 12, 20)]
    items = [(f"e{i}", " ".join(w)) for i, w in enumerate(own)]
    texts = []
    for _ in range(60):
        w = r.choice(own)
        at, n = r.randrange(0, len(w) - 5), r.randrange(5, 16)
        piece = list(" ".join(w[at : at + n]))
        for _ in range(r.randrange(0, 5)):
            k = r.choice([0, 1, len(piece) - 1, r.randrange(len(piece))])
            piece[k : k + r.randrange(2)] = r.choice(["", "x", "y", " "])
        texts.append(" ".join([word() for _ in range(r.randrange(3))]) + " " + "".join(piece) + " " + " ".join([word() for _ in range(r.randrange(3))]))
    ix = leaks.index(items, 6 if edits == 1 else 12, edits)
    n = 6 if edits == 1 else 12
    # Lengths that the q-gram bound covers whole.
    sure = {k for k, own_ in zip(ix.ids, ix.shortest) if own_ >= leaks.Q * (edits + 1)}
    want, got = {}, {(t, ix.ids[k]): e for t, k, e in leaks.find(texts, ix, n, edits) if ix.ids[k] in sure}
    for t, text in enumerate(texts):
        plain = " " + " ".join(tokens(text)) + " "
        for k, p in items:
            ws = p.split()
            least = min((apart(" " + " ".join(ws[i : i + n]) + " ", plain) for i in range(len(ws) - n + 1)), default=99)
            if k in sure and least <= edits:
                want[t, k] = least == 0
    assert sure and any(want.values()) and not all(want.values()) and got == want


@pytest.mark.parametrize("seed", range(4))
def test_items_with_common_openings_equal_those_without_the_limit(monkeypatch, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(3, 9)))
    opening, closing = [word() for _ in range(r.choice([10, 18]))], [word() for _ in range(22)]
    own = [(opening if r.random() < 0.8 else []) + [word() for _ in range(r.randrange(0, 30))] + (closing[r.randrange(6) :] if r.random() < 0.5 else []) for _ in range(40)]
    items = [(f"e{i}", " ".join(w)) for i, w in enumerate(own)]
    texts = []
    for _ in range(80):
        w = r.choice([opening, closing, *own[:12]])
        at = r.randrange(0, max(1, len(w) - 12))
        piece = list(" ".join(w[at : at + r.randrange(9, 26)]))
        for _ in range(r.randrange(0, 3)):
            k = r.randrange(len(piece))
            piece[k : k + r.randrange(2)] = r.choice(["", "x", "y", " "])
        texts.append(" ".join(word() for _ in range(r.randrange(4))) + " " + "".join(piece))
    monkeypatch.setattr(leaks, "HOT", 3)
    ix = leaks.index(items, 15, 1)
    monkeypatch.setattr(leaks, "HOT", 10_000)
    free = leaks.index(items, 15, 1)
    assert ix.hot.any() and not free.hot.any()
    got = leaks.find(texts, ix, 15, 1)
    assert got == leaks.find(texts, free, 15, 1) and got
    assert {(t, ix.ids[k]) for t, k, e in got if e} == brute(enumerate(texts), items)


def test_a_common_opening_costs_no_row_for_each_item():
    """Documents with the opening of 1,000 items, but no leak, are held against none of them."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    opening = [word() for _ in range(10)]
    ix = leaks.index([(f"e{i}", " ".join(opening + [word() for _ in range(40)])) for i in range(1000)], 15, 1)
    cp, edge = words.spaced_words([" ".join([*opening, *(word() for _ in range(30))]) for _ in range(256)])
    full = 256 * 1000 * (10 * 6 + 1 + 1 - leaks.Q)  # each document, item and gram of the opening
    assert len(leaks._shared(cp, edge, ix)[0]) < full / 100 and leaks._found(cp, edge, ix, 1) == {}
