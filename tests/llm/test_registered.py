"""Registered queries that SQL cannot express, over whole tables, against brute-force versions."""

import hashlib
import os
import re

import duckdb
import pytest

import __spark_entry__ as registry
from test_suffixes import brute as brute_suffixes
from test_text_operators import plain

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang FROM '{SF_DIR}/documents.parquet'").fetchall()


def rows(spark, name):
    return registry.queries()[name](spark, SF_DIR).collect()


def test_every_operator_is_registered_once():
    numbers = sorted(int(m[1]) for q in registry.queries() if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 14)) and "pipeline" in registry.queries()


def test_op4_pii(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op4_pii")}
    assert len(got) == len(docs)
    for doc, text, _ in docs:
        spans = plain(text)
        listed = ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in spans[k])
        r = got[doc]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
        assert len([s for s in r.spans.split(",") if s]) == sum(map(len, spans.values())) + r.n_disguised


def test_op6_license_scan(spark, docs):
    # The wordings in the test tables.
    known = {"Licensed under CC BY-NC 4.0": "cc-by-nc-4.0", "Licensed under the Apache License, Version 2.0": "apache-2.0",
             "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
             "Released under the MIT License": "mit"}
    got = {r.doc_id: r for r in rows(spark, "op6_license_scan")}
    found = 0
    for doc, text, _ in docs:
        want = sorted((m.start(), f"{name}:{m.start()}:{m.end()}") for w, name in known.items() for m in re.finditer(re.escape(w), text))
        assert got[doc].spans == ",".join(s for _, s in want) and got[doc].n_exact == len(want)
        found += len(want)
    assert found > 0


def test_op7_suffix_dedup(spark, docs):
    got = sorted((tuple(r) for r in rows(spark, "op7_suffix_dedup")), key=str)
    assert got == brute_suffixes([(d, t) for d, t, _ in docs])


def test_op8_chat_format(spark):
    said = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", said), ("assistant", said)]}
    for conv, role, text in duckdb.sql(
            f"SELECT conv_id, role, coalesce(text, '') FROM '{SF_DIR}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        turns.setdefault(conv, []).append((role, text))
    got = {r.conv_id: r for r in rows(spark, "op8_chat_format")}
    assert got.keys() == turns.keys()
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(own), len(loss))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op9_language_id(spark, docs):
    lang = {d: x for d, _, x in docs}
    got = rows(spark, "op9_language_id")
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and len(held) > 20
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_op10_token_counts(spark, docs):
    from tokenizers import Tokenizer

    from entityvec.llm.queries import tokenizer_path
    made = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode_batch([t for _, t, _ in docs], add_special_tokens=False)
    want = {d: (len(t.encode()), len(e.ids), len(e.ids) > 1024) for (d, t, _), e in zip(docs, made)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op10_token_counts")} == want
