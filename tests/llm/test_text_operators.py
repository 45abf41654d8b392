"""Personal data, licenses, languages and token counts: rows that depend on their own text only."""

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from corpora import SCHEMA, docs_of, edges, empty, prose
from entityvec.llm import langid, licenses, pii, tokencount
from entityvec.llm.queries import tokenizer_path


# --- personal data ------------------------------------------------------------------------

def plain(text):
    def digits(m):
        return re.sub(r"[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
               if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
                 if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]}


def test_plain_spans_equal_the_patterns():
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choice("a@.1+ -(0é2") for _ in range(draw.randrange(60)))
        assert pii.plain_spans(text) == plain(text), text


@pytest.mark.parametrize("kind,text,found", [
    ("email", "write to john.doe [at] example [dot] com now", "john.doe [at] example [dot] com"),
    ("email", "john at example dot co dot uk", "john at example dot co dot uk"),
    ("email", "jоhn＠exаmple．com", "jоhn＠exаmple．com"),
    ("email", "mail john_at_example_dot_com now", "john_at_example_dot_com"),
    ("email", "mail john @ example.com now", "john @ example.com"),
    ("email", "mail john&#64;example&#46;com now", "john&#64;example&#46;com"),
    ("email", "mail john(at)example.com now", "john(at)example.com"),
    ("phone", "call +1 (4O4) 555-OlO1 ok", "+1 (4O4) 555-OlO1"),
    ("phone", "call plus one four one five five five five two six seven one ok",
     "plus one four one five five five five two six seven one"),
    ("email", "mail JОHN.ІVАN＠ехаmple.com", "JОHN.ІVАN＠ехаmple.com"),
    ("email", "mail john&#0000000064;example&#0000000046;com now", "john&#0000000064;example&#0000000046;com"),
    ("phone", "call +1 (five five five) 123 4567 ok", "+1 (five five five) 123 4567"),
    ("phone", "call +" + "4O" * 4 + "1" + "2" * 5 + " 1 ok", "+" + "4O" * 4 + "1" + "2" * 5 + " 1"),
    ("ip", "１９２.１６８.０.١", "１９２.１６８.０.١"),
    ("ip", "at one nine two dot one six eight dot zero dot one.", "one nine two dot one six eight dot zero dot one"),
    ("card", "card four one one one 1111 1111 one one one one", "four one one one 1111 1111 one one one one"),
])
def test_disguises_map_back_to_the_source(kind, text, found):
    base, more = pii.spans_of(text, {})
    assert [text[a:b] for a, b in more[kind]] == [found]
    assert not any(base.values())


@pytest.mark.parametrize("text", ["meet at noon dot", "look at this. one two three", "Ill or old 10 lo", "l'année dernière à 20:15", "(at) home"])
def test_prose_is_left_alone(text):
    base, more = pii.spans_of(text, {})
    assert not any(base.values()) and not any(more.values())


def test_every_look_alike_letter():
    assert all(v.isascii() and v.isalpha() and not k.isascii() for k, v in pii.LOOK_ALIKES.items())
    groups = pii._ALIKE.split()
    assert len(groups) == len({g[0] for g in groups}) and len(pii.LOOK_ALIKES) == sum(len(g) - 1 for g in groups)
    for other, latin in pii.LOOK_ALIKES.items():
        text = f"mail j{other}n@example.com or {other}{other}@example.org"
        base, more = pii.spans_of(text, {})
        assert [text[a:b] for a, b in more["email"]] == [f"j{other}n@example.com", f"{other}{other}@example.org"], (other, latin)


def test_personal_data_of_a_table(spark):
    frame = docs_of(spark, ["a@b.c 1.2.3.4", "x (at) y (dot) de", None]).withColumn("spans", F.lit(1))
    rows = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(frame).collect()}
    assert rows == {0: [("email", 0, 5, True), ("ip", 6, 13, True)], 1: [("email", 0, 17, False)], 2: []}
    hidden = (frame.select("doc_id", "text").join(pii.personal_data(frame), "doc_id")
              .select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect())
    assert {r.doc_id: r.m for r in hidden} == {0: "<email> <ip>", 1: "<email>", 2: None}
    assert pii.personal_data(edges(spark)).count() == 12
    assert pii.personal_data(empty(spark)).collect() == []


@pytest.mark.parametrize("found", [
    "john [at] example dot com", "john@example dot com", "john at example [dot] com", "jean arobase exemple point fr",
    "juan arroba ejemplo punto es", "jean arobase exemple.fr", "john&#64;example dot co.uk", "john at example&#46;com",
    "hans at beispiel punkt de", "john (at) mail.example dot com", "jean@exemple point fr"])
def test_signs_of_mixed_forms(found):
    text = f"write to {found}, please"
    base, more = pii.spans_of(text, {})
    assert [text[a:b] for a, b in more["email"]] == [found] and not any(base.values())


@pytest.mark.parametrize("text,found", [
    ("we are at this point in time", []), ("look at example.com now", []), ("nous sommes au point de", []),
    ("look at google dot com", []), ("write to us at example dot com", []), ("more is at example [dot] com", []),
    ("write to john@example.co dot uk", ["john@example.co dot uk"]), ("à jean@exemple.fr point final", [])])
def test_words_that_are_no_signs(text, found):
    _, more = pii.spans_of(text, {})
    assert [text[a:b] for a, b in more["email"]] == found


@pytest.mark.parametrize("kind,text,plain,found,hidden", [
    ("email", "mail j\u043ehn.doe@example.com", "hn.doe@example.com", "j\u043ehn.doe@example.com", "mail <email>"),
    ("email", "mail john@example.c\u043em now", "john@example.c", "john@example.c\u043em", "mail <email> now"),
    ("phone", "call +44 20 7946 O958 ok", "+44 20 7946", "+44 20 7946 O958", "call <phone> ok"),
])
def test_partly_disguised_ones_are_found_whole(spark, kind, text, plain, found, hidden):
    base, more = pii.spans_of(text, {})
    assert [text[a:b] for a, b in base[kind]] == [plain] and [text[a:b] for a, b in more[kind]] == [found]
    frame = docs_of(spark, [text])
    out = frame.join(pii.personal_data(frame), "doc_id").select(pii.masked(F.col("text"), F.col("spans")))
    assert out.first()[0] == hidden


def test_masking_merges_overlaps(spark):
    spans = "array(named_struct('kind', 'ip', 'start', 0L, 'end', 3L), named_struct('kind', 'email', 'start', 0L, 'end', 5L), " \
        "named_struct('kind', 'phone', 'start', 4L, 'end', 7L), named_struct('kind', 'card', 'start', 7L, 'end', 8L))"
    assert spark.range(1).select(pii.masked(F.lit("0123456789"), F.expr(spans))).first()[0] == "<email><card>89"


# --- licenses -----------------------------------------------------------------------------

def notices(text):
    scanner = licenses.Scanner()
    return [(n["license"], text[n["start"]:n["end"]], n["missing"], n["added"])
            for s, b in licenses.blocks_of(text) for n in scanner.notices(b, s)]


def test_every_template_is_found_in_prose():
    for name, template in licenses.TEMPLATES:
        text = f"{prose(1, 40)}\n{template}\n{prose(2, 40)}"
        assert [(n[0], n[2], n[3]) for n in notices(text)] == [(name, [], [])], template


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
@pytest.mark.parametrize("width", [20, 40, 60, 80])
def test_every_template_is_found_wrapped(prefix, width):
    for name, template in licenses.TEMPLATES:
        wrapped = textwrap.fill(template, width, initial_indent=prefix, subsequent_indent=prefix, break_on_hyphens=False)
        text = f"{prose(1, 40)}\n\n{wrapped}\n\n{prose(2, 40)}"
        assert [(n[0], n[2], n[3]) for n in notices(text)] == [(name, [], [])], text
        assert [n[1] for n in notices(text)] == [wrapped[len(prefix):].rstrip(".)")]


def test_many_notices_of_one_block():
    texts = [t for _ in range(12) for _, t in licenses.TEMPLATES]
    text = "\n".join(textwrap.fill(f"{t} {prose(i, i % 7)}", 40) for i, t in enumerate(texts))
    assert [n[0] for n in notices(text)] == [n for _ in range(12) for n, _ in licenses.TEMPLATES]
    # A run of a notice's words before it is no obstacle to one whose wording differs.
    changed = licenses.TEMPLATES[-1][1].replace("subject", "bound")
    assert [n[:2] for n in notices("I say yes to the terms of the Mozilla Public License, v. 2.0 and no.\n" + changed)] == [
        ("mpl-2.0", changed[:-1])]


def test_wordings_that_differ():
    assert notices("Licensed under the Apache License,\n  Version 2.0, yes")[0][:2] == (
        "apache-2.0", "Licensed under the Apache License,\n  Version 2.0")
    both = notices("This work is licensed under the GNU Lesser General Public License, version 3. Released under the MIT License.")
    assert [n[0] for n in both] == ["lgpl-3.0", "mit"]
    changed = notices(licenses.TEMPLATES[2][1].replace("may not use", "must never use"))
    assert changed[0][0] == "apache-2.0" and set(changed[0][3]) <= {"must", "never"} and changed[0][3]
    assert notices("He has a licence to kill. We license nothing.\n" + prose(1, 200)) == []


def test_templates_of_the_largest_reductions_do_not_hide_others():
    text = "This work is licensed under the terms of the GNU General Public License.\nReleased under the MIT License."
    assert notices(text) == [("mit", "Released under the MIT License", [], [])]


@pytest.mark.parametrize("text, license", [
    ("This work is licensed under the GNU General Public License, version 1.", None),
    ("Licensed under the Apache License, Version 1.1.", None), ("Licensed under the Apache License, Version 2.1", None),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "lgpl-2.1"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", None),
    ("Distributed under the MIT license", "mit"), ("Released under the BSD 2-Clause License.", "bsd-2-clause"),
    ("// SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: MIT-0", None)])
def test_versions_and_names_tell_licenses_apart(text, license):
    assert [n[0] for n in notices(f"{prose(1, 20)}\n{text}\n{prose(2, 20)}")] == ([license] if license else [])


def test_every_identifier_is_found():
    for name, identifier in licenses.IDENTIFIERS:
        assert [(n[0], n[2], n[3]) for n in notices(f"#!/bin/sh\n# {identifier}\n\n{prose(1, 30)}")] == [(name, [], [])]


def test_templates_without_their_version_are_no_notice():
    scanner = licenses.Scanner()
    tried = 0
    for (name, template), versions in zip(licenses.TEMPLATES, scanner.versions):
        for word, a, b in licenses.words_at(template):
            if word in versions:
                for other in ("", "9.7", "1"):
                    tried += 1
                    assert notices(template[:a] + other + template[b:]) == [], (name, other)
    assert tried > 30


def test_clauses_tell_the_forms_of_bsd_apart():
    forms = {n: t for n, t in licenses.TEMPLATES if n.startswith("bsd") and len(t) > 80}
    assert len(forms) == 3
    for name, text in forms.items():
        assert [n[0] for n in notices(re.sub(r" [123][.] ", "\n * ", text))] == [name]


@pytest.mark.parametrize("before", ["is not", "was never", "is neither"])
def test_negations_are_differences(before):
    for _, template in licenses.TEMPLATES:
        (found,) = notices(f"It {before} {template}")
        assert found[3][0] == before.split()[1]


def test_licenses_of_a_table(spark):
    assert licenses.license_notices(edges(spark)).filter("size(notices) = 0").count() == 12
    assert licenses.license_notices(empty(spark)).collect() == []


# --- languages ----------------------------------------------------------------------------

def test_held_out_accuracy_and_unknown_texts(spark):
    draw = random.Random(1)
    kinds = {"xx": "ka lo mi tu re".split(), "yy": "sch ung ein der ach".split(), "zz": "été ção ñar que ment".split()}
    rows = []
    for i in range(400):
        lang = draw.choice(list(kinds))
        rows.append((i, " ".join(draw.choice(kinds[lang]) + draw.choice(kinds[lang]) for _ in range(20)), lang, "s", 0))
    rows += [(400, None, "xx", "s", 0), (401, "12 !", "xx", "s", 0), (402, "", None, "s", 0)]
    got = {r.doc_id: r for r in langid.languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 403 and sum(r.held_out for r in got.values()) > 60
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang, _, _ in rows[:400])
    assert {(got[i].lang_pred, got[i].score) for i in (400, 401, 402)} == {("und", 0.0)}
    few = {r.doc_id: r.lang_pred for r in langid.languages(spark.createDataFrame(rows, SCHEMA), rows=60).collect()}
    assert sum(few[i] == rows[i][2] for i in range(400)) > 390


def test_language_edge_cases(spark):
    frame = edges(spark)
    assert langid.languages(frame).count() == 12
    assert langid.languages(empty(spark)).collect() == []
    none = langid.languages(frame.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    kept = langid.identify(frame, langid.train(frame), frame.columns)
    assert kept.columns == [*frame.columns[:], "lang_pred", "score"]


# --- token counts -------------------------------------------------------------------------

def awkward():
    draw = random.Random(1)
    return ["", None, "<|endoftext|>a<|endoftext|>", " <|endoftext|> <|endoftext|>x  ", "a" * 5000, "aaa aaaaa", "  \n\n \t x",
            "日本語テキスト 😀😀 ', I'll don't  ", "  x \u0085y\x1c z", "<|endoftext", "".join(draw.choice("abcdefgh  \n'!é日1٣²") for _ in range(20_000)),
            "".join(chr(draw.randrange(1, 0x3000)) for _ in range(5000)), prose(4, 2000)]


def test_counts_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    texts = awkward()
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: r for r in tokencount.token_counts(docs_of(spark, texts), path).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert [got[i].over_limit for i in range(len(texts))] == [n > 1024 for n in want]
    assert tokencount.token_counts(edges(spark), path).count() == 12
    assert tokencount.token_counts(empty(spark), path).collect() == []
