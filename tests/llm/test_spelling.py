"""Spelling variants against comparisons of all words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from corpora import docs_of, edges, empty
from entityvec.llm import spelling


def near(a, b):
    """Exactly one insertion, deletion or replacement."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    nears = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            nears[a].append(b)
            nears[b].append(a)
    forms = {}
    for w, others in nears.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], len(nears[w]), counts.get(forms[w])))
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in spelling.spelling_variants(frame).collect())


def edited(draw, word):
    at, letter = draw.randrange(len(word) + 1), draw.choice("abcxyzéñÀß")
    return draw.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1:], word[:at] + letter + word[at + 1:]])


def test_equals_all_comparisons(spark):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdeéñ") for _ in range(draw.randint(5, 9))) for _ in range(60)]
    words = base + [edited(draw, draw.choice(base)) for _ in range(500)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa"]
    words += [edited(draw, w) for w in words[60:300]]
    texts = [" ".join(draw.choices(words, weights=[1 + 40 * (i < 60) for i in range(len(words))], k=300)) for _ in range(40)]
    texts += [t.upper() for t in texts[:5]]
    frame = docs_of(spark, texts)
    want = brute(list(enumerate(texts)))
    assert got(frame) == want
    assert sum(r[1] is not None for r in want) > 100 and any(r[1] != r[2] for r in want if r[1])


def test_edge_cases(spark):
    frame = edges(spark)
    assert got(frame) == brute([(r.doc_id, r.text) for r in frame.collect()])
    assert got(empty(spark)) == []


def test_long_words_and_words_of_one_letter(spark):
    long = "ab" * 20_000
    texts = [f"{long} {long}c"] * 3 + ["zzzzz zzzzzz zzzzzzz zzzzzzzz"] * 4 + ["zzzzz"] * 9
    frame = docs_of(spark, texts)
    assert got(frame) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("seed", range(3))
def test_words_one_edit_apart_share_a_signature(seed):
    draw = random.Random(seed)
    for _ in range(300):
        a = "".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 12)))
        b = edited(draw, a)
        if a and b and near(a, b):
            keys = spelling.signatures([a, b])
            assert len(np.intersect1d(keys[0], keys[1]))
