"""Queries of the corpus operators, one for each, and their SQL where there is some."""

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityvec.llm import chat
from entityvec.llm.decontaminate import contaminated
from entityvec.llm.hamming import nearest_by_codes
from entityvec.llm.langid import languages
from entityvec.llm.licenses import license_notices
from entityvec.llm.merkle import verified
from entityvec.llm.minhash import near_duplicates
from entityvec.llm.mixing import pareto_mix
from entityvec.llm.pii import KINDS, joined, personal_data
from entityvec.llm.spelling import spelling_variants
from entityvec.llm.streamdedup import exact_duplicates
from entityvec.llm.suffixes import cut_repetitions
from entityvec.llm.tokencount import token_counts

#: Folder of the public tokenizers' files; unset, that of the installed package.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR")


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if there is one."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3),
           lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS t FROM s),
hot AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT h.a, h.b FROM hot h JOIN s x ON x.doc_id = h.a JOIN s y ON y.doc_id = h.b
      WHERE 100 * h.n >= 75 * (len(x.s) + len(y.s) - h.n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents WHERE doc_id IS NOT NULL
      UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY 1) c ON c.node = s.doc_id""")
def op1_minhash(spark, d):
    return near_duplicates(table(spark, d, "documents"))


@query(r"""WITH d AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2),
      lambda k: array_to_string(w[k:k + n - 1], ' '))) AS t
      FROM (SELECT *, least(len(w), 13) AS n FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v))),
h AS (SELECT g.doc_id, g.k, g.n, v.item_id FROM g JOIN v ON v.t = g.t AND v.n = g.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""")
def op2_decontaminate(spark, d):
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query(r"""WITH s AS (
  SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
    (('0x' || substr(md5(concat_ws('|', '0', doc_id::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
w AS (SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w FROM s GROUP BY source),
o AS (SELECT *, 200::HUGEINT * source_size AS cap, row_number() OVER (ORDER BY 200.0 * source_size / w, source NULLS LAST) AS k FROM w),
r AS (SELECT *, 150::HUGEINT * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM o),
e AS (SELECT k, rest, shares FROM r WHERE w * rest <= cap * shares ORDER BY k LIMIT 1),
t AS (SELECT r.source, r.source_size, CASE WHEN r.k < e.k OR e.k IS NULL THEN 2.0::DOUBLE * r.source_size
    ELSE w::DOUBLE * e.rest::DOUBLE / (100.0::DOUBLE * e.shares::DOUBLE) END AS target FROM r LEFT JOIN e ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS c FROM t),
q AS (SELECT *, least(floor(c), 2)::BIGINT AS whole, c - least(floor(c), 2) AS p, target - least(floor(c), 2) * source_size AS wanted FROM p),
x AS (SELECT s.*, q.source_size, q.target, q.whole, q.wanted, q.p,
    CASE WHEN q.p > 0 THEN (s.u / (1 - s.u)) / (q.p / (1 - q.p)) END AS x FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source),
v AS (SELECT *, coalesce(x / (1 + x), u) AS v FROM x),
f AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, doc_id ROWS UNBOUNDED PRECEDING) <= wanted AS f FROM v),
g AS (SELECT source AS gs, any_value(wanted) - coalesce(sum(size) FILTER (f), 0) AS gap FROM f GROUP BY source),
h AS (SELECT f.*, gap, row_number() OVER (PARTITION BY source, f ORDER BY abs(size - gap), v, doc_id) AS k
    FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.gs)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN f OR (k = 1 AND abs(size - gap) < gap) THEN 1 ELSE 0 END))::BIGINT AS taken FROM h""")
def op3_mixing(spark, d):
    return pareto_mix(table(spark, d, "documents"))


@query("""WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM t""")
def op5_exact_dedup(spark, d):
    return exact_duplicates(spark, f"{d}/documents.parquet").drop("file", "row")


@query()
def op7_suffix_dedup(spark, d):
    return cut_repetitions(table(spark, d, "documents"))


@query()
def op10_token_counts(spark, d):
    return token_counts(table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query()
def op9_language_id(spark, d):
    return languages(table(spark, d, "documents"))


@query()
def op4_pii(spark, d):
    """Counts and base_sha256 are of the plain spans; ``spans`` has those behind disguises too."""
    found = personal_data(table(spark, d, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])

    def number(kind):
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, KINDS),
        F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["plain"])).cast("bigint").alias("n_disguised"))


@query()
def op8_chat_format(spark, d):
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                    "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    role, text = F.col("role"), F.col("text")
    parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    layouts = [
        F.struct(role, text),
        F.struct(F.col("turn").alias("id"), role, text.alias("content")),
        F.struct(F.array(F.struct(role, text.alias("content"))).alias("messages")),
        F.struct(F.array(F.struct(role.alias("from"), text.alias("value"))).alias("conversations"), F.lit("made").alias("source")),
        F.struct(F.array(F.struct(role, parts.alias("content"))).alias("messages")),
        F.struct(F.array(F.struct(role.alias("speaker"), text, F.lit(None).cast("string").alias("name"))).alias("turns"))]
    dealt = F.coalesce(F.pmod("conv_id", F.lit(len(layouts))), F.lit(0))
    # The same rows in the layouts that corpora have, one for each conversation.
    record = F.coalesce(*[F.when(dealt == i, F.to_json(x, {"ignoreNullFields": "false"})) for i, x in enumerate(layouts)])
    return chat.read_back(chat.canonical_turns(rows, record, ["conv_id", "turn"]))


@query()
def op6_license_scan(spark, d):
    notices = F.col("notices")
    exact = F.filter(notices, lambda n: (F.size(n["missing"]) == 0) & (F.size(n["added"]) == 0))
    spans = F.transform(notices, lambda n: F.concat_ws(":", n["license"], n["start"].cast("string"), n["end"].cast("string")))
    return license_notices(table(spark, d, "documents")).select(
        "doc_id", F.size(notices).cast("bigint").alias("n_notices"), F.size(exact).cast("bigint").alias("n_exact"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(notices, lambda n: n["license"]))), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"))


@query(r"""WITH RECURSIVE c(i, x) AS (  -- the table of CRC-32, bit by bit
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))
  FROM range(256) t(i)),
t AS (SELECT list(x ORDER BY i) AS t FROM c),
d AS (SELECT documents.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda x, y: xor(x >> 8, t.t[xor(x, y) % 256 + 1]))) % 5 = 0 AS drawn FROM documents, t),
f AS (SELECT doc_id, source, drawn, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS h, text FROM d),
l AS (SELECT doc_id, source, sha256(h || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      CASE WHEN drawn THEN sha256(h || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
b AS (SELECT 0 AS level, source, pos, n, leaf AS digest FROM p
      UNION ALL SELECT level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY ALL),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM b WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, subroot AS digest FROM s
      UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY ALL),
-- One numbering of levels: those of the source, then those over the sources.
a AS (SELECT p.doc_id, p.source, p.pos AS leaf_at, coalesce(p.changed, p.leaf) AS own, b.level, b.pos, b.digest
      FROM p JOIN b ON b.source IS NOT DISTINCT FROM p.source AND b.n > 1 AND b.pos // 16 = p.pos // (16 ** (b.level + 1))::BIGINT
      UNION ALL SELECT p.doc_id, p.source, p.pos, coalesce(p.changed, p.leaf), 100 + u.level, u.pos, u.digest
      FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN u ON u.n > 1 AND u.pos // 16 = s.pos // (16 ** (u.level + 1))::BIGINT),
g AS (SELECT a.doc_id, a.source, leaf_at, level,
      coalesce(string_agg(a.digest, '' ORDER BY a.pos) FILTER (a.pos < me), '') AS lefts, coalesce(string_agg(a.digest, '' ORDER BY a.pos) FILTER (a.pos > me), '') AS rights
      FROM (SELECT a.*, CASE WHEN level < 100 THEN leaf_at // (16 ** level)::BIGINT ELSE s.pos // (16 ** (level - 100))::BIGINT END AS me
            FROM a JOIN s ON s.source IS NOT DISTINCT FROM a.source) a GROUP BY ALL),
q AS (SELECT source, leaf_at, list(lefts ORDER BY level) AS lefts, list(rights ORDER BY level) AS rights,
      sha256(string_agg(lefts || rights, '' ORDER BY level)) AS proof FROM g GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.folded AS folded_root, f.folded = r.digest AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN (SELECT digest FROM u WHERE n = 1) r ON true
LEFT JOIN q ON q.source IS NOT DISTINCT FROM p.source AND q.leaf_at = p.pos
JOIN (SELECT p.source, p.pos, list_reduce(list_prepend(coalesce(p.changed, p.leaf), coalesce(list_transform(range(1, len(q.lefts) + 1),
      lambda k: q.lefts[k] || '|' || q.rights[k]), [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded
      FROM p LEFT JOIN q ON q.source IS NOT DISTINCT FROM p.source AND q.leaf_at = p.pos) f ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos""")
def op13_merkle_manifest(spark, d):
    return verified(table(spark, d, "documents"))


@query(r"""WITH RECURSIVE c(i, x) AS (  -- the table of CRC-32, bit by bit
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))
  FROM range(256) t(i)),
t AS (SELECT list(x ORDER BY i) AS t FROM c),
u AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
r AS (SELECT doc_id, w, count(*) AS n, hex(encode(concat(doc_id, ':', w))) AS x FROM u WHERE length(w) >= 5 GROUP BY ALL),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
      lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t.t[xor(a, b) % 256 + 1]))) AS h FROM r, t),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
k AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
-- Replaced: equal with a hole at one place. Inserted or deleted: equal to the other word without one place.
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM k),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM p),
e AS (SELECT a.word, b.word AS near, b.n AS m FROM g a JOIN g b ON a.hole = b.hole AND a.word <> b.word
      UNION SELECT g.word, k.word, k.n FROM g JOIN k ON g.less = k.word
      UNION SELECT k.word, g.word, g.n FROM g JOIN k ON g.less = k.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, encode(near))) AS near, max(m) AS m FROM e GROUP BY word),
f AS (SELECT k.word, CASE WHEN m >= 2 * k.n THEN near END AS form, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * k.n THEN m END AS form_n
      FROM k LEFT JOIN b USING (word)),
s AS (SELECT word, word AS root, form FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.form)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.form IS NULL""")
def op12_spelling_variants(spark, d):
    return spelling_variants(table(spark, d, "documents"))


@query()
def op11_nearest_codes(spark, d):
    return nearest_by_codes(table(spark, d, "embeddings"), F.col("id") % 20 == 0)
