"""The manifest against a tree built by hand, and its proofs folded by hand."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from corpora import SCHEMA, docs_of, edges, empty, prose
from entityvec.llm import merkle
from test_streamdedup import lower


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """Levels from the leaves to the root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append((level[first:at], level[at + 1:first + 16]))
        at //= 16
    return out


def brute(rows):
    """``rows`` of doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at_top, s in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = siblings(trees[s], at) + siblings(top, at_top)
            folded = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                folded = leaf((*r[:4], None if r[4] is None else lower(r[4])))
            for left, right in path:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in path for x in left + right))
            out.append((r[0], own, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in merkle.verified(frame).collect()), key=str)


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_edge_cases(spark):
    frame = edges(spark)
    assert got(frame) == brute(rows_of(frame))
    assert got(empty(spark)) == []
    one = docs_of(spark, ["A single text"])
    (row,) = merkle.verified(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h() and row.doc_id == 0
    assert row.verified is (zlib.crc32(b"0") % 5 != 0)


def test_trees_of_several_blocks_and_many_sources(spark):
    texts = [(i * 7919 % 9973, f"Text {i}") for i in range(4500)]
    rows = [(i, t, "en", "hot" if n % 10 else f"s{n % 290}", len(t)) for n, (i, t) in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows_of(frame))
    assert len({r[2] for r in want}) == 30 and got(frame) == want
    assert 0 < sum(r[6] for r in want) < len(want)


def test_given_proofs_fold_to_the_root(spark):
    frame = docs_of(spark, [(i, prose(i, 5)) for i in range(300)])
    made = merkle.manifest(frame, F.when(F.col("doc_id") == 7, F.sha2(F.lit("other"), 256)), proofs=True).collect()
    assert len({r.root for r in made}) == 1
    for r in made:
        digest = h("other") if r.doc_id == 7 else r.leaf
        for left, right in r.proof:
            digest = h(left, digest, right)
        assert digest == r.folded_root and (digest == r.root) is (r.doc_id != 7)
        assert r.proof_sha256 == h(*(left + right for left, right in r.proof))
