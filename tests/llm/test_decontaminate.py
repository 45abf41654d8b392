"""Windows of benchmark items against a search of all of them in all documents."""

import hashlib
import re

import pytest

from corpora import docs_of, edges, empty, prose
from entityvec.llm.decontaminate import contaminated


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (at := tuple(w[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in windows[at] if i is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "item_id AS doc_id", "text AS w")


@pytest.mark.parametrize("sent_rows", [200_000, 0])
def test_equals_search_of_all_windows(spark, sent_rows):
    long = prose(1, 40)
    items = [(1, long), (11, prose(2, 5)), (2, "Was it"), (3, "solo"), (4, long), (4, long), (None, prose(3, 20)), (5, None), (6, "--")]
    texts = [long, prose(5, 400) + " " + " ".join(long.split()[4:20]).upper() + "! " + prose(6, 300), "x was, IT solo",
             prose(2, 5) + " " + prose(2, 5), prose(3, 20), None, "", "solo " * 30, " ".join(long.split()[:12]),
             "café É " + long.replace(" ", "\n-")]
    docs = docs_of(spark, texts)
    got = sorted((tuple(r) for r in contaminated(docs, items_of(spark, items), sent_rows=sent_rows).collect()), key=str)
    assert got == brute(list(enumerate(texts)), items)


def test_edge_cases(spark):
    frame = edges(spark)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    items = [(1, prose(2, 60)), (2, " ".join(prose(1, 30_000).split()[500:520])), (3, "word")]
    for chosen in (items, []):
        got = sorted((tuple(r) for r in contaminated(frame, items_of(spark, chosen)).collect()), key=str)
        assert got == brute(rows, chosen)
    assert contaminated(empty(spark), items_of(spark, items)).collect() == []
