"""Exact duplicates over streams of several files, resumed state and weak digests."""

import hashlib
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from corpora import docs_of, edges, empty, prose
from entityvec.llm import streamdedup
from entityvec.llm.streamdedup import exact_duplicates, sha256


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[lower(t)]
        out.append((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def check(rows, got):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    # Exactly one row of each group stays, and it bears the identifier that stays.
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def weak(text):
    return F.substring(F.sha2(text, 256), 1, 1).cast("binary")


@pytest.mark.parametrize("digest", [sha256, weak])
def test_equals_grouping_by_text(spark, tmp_path, digest):
    texts = [prose(i % 23, 5) for i in range(90)] + [prose(3, 5).upper(), "É", "é", None, ""]
    frame = docs_of(spark, [((i * 31) % 97, t) for i, t in enumerate(texts)])
    frame.repartition(6).write.parquet(str(tmp_path / "docs"))
    got = exact_duplicates(spark, str(tmp_path / "docs"), digest=digest, batch_files=2).collect()
    check([(r.doc_id, r.text) for r in frame.collect()], got)


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    first, later = docs_of(spark, [(1, "a"), (5, "b"), (3, "A")]), docs_of(spark, [(9, "a"), (2, "b"), (4, "c")])
    first.write.parquet(path)
    assert {r.keep_id for r in exact_duplicates(spark, path, folder).collect()} == {3, 5}
    later.write.mode("append").parquet(path)
    got = exact_duplicates(spark, path, folder).collect()
    check([(1, "a"), (5, "b"), (3, "A"), (9, "a"), (2, "b"), (4, "c")], got)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_files_of_old_dates_are_taken_later(spark, tmp_path, monkeypatch):
    path, folder = tmp_path / "docs", str(tmp_path / "state")
    docs_of(spark, [(1, "a"), (5, "b")]).write.parquet(str(path))
    exact_duplicates(spark, str(path), folder).collect()
    seen = set(path.glob("*.parquet"))
    docs_of(spark, [(9, "a"), (4, "c")]).write.mode("append").parquet(str(path))
    month_ago = time.time() - 30 * 86400
    for f in set(path.glob("*.parquet")) - seen:
        os.utime(f, (month_ago, month_ago))
    check([(1, "a"), (5, "b"), (9, "a"), (4, "c")], exact_duplicates(spark, str(path), folder).collect())
    docs_of(spark, [(7, "d")]).write.mode("append").parquet(str(path))
    monkeypatch.setattr(streamdedup, "update_state", lambda *a: None)
    with pytest.raises(ValueError, match="has 4 of 5 rows"):
        exact_duplicates(spark, str(path), folder)


def test_edge_cases(spark, tmp_path):
    edges(spark).write.parquet(str(tmp_path / "docs"))
    got = exact_duplicates(spark, str(tmp_path / "docs")).collect()
    check([(r.doc_id, r.text) for r in edges(spark).collect()], got)
    empty(spark).write.parquet(str(tmp_path / "none"))
    assert exact_duplicates(spark, str(tmp_path / "none")).collect() == []
