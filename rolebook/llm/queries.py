"""Registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolebook.llm import bpe, chat, codebooks, decontaminate, langid, pii, quality, repeats, secret_scan, simhash, substrings, toxicity, turn_repair
from rolebook.llm import texts as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_ranks() -> tuple[str, str]:
    """(path, pattern) of the public vocabulary in use."""
    import public_tokenizers as P

    return P.path(RANKS), P.PATTERN


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *public_ranks())


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, X.crc_mod(F.col("doc_id"), 3) != 1)
    held_out = (X.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return out.select("doc_id", held_out, "lang_pred", "score", "bits_per_byte")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, X.crc_mod(F.col("doc_id"), 4) != 2)
    held_out = (X.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def only(spans: str, kinds: tuple):
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = pii.KINDS[:4]
    return found.select(
        "doc_id",
        *(count_of("spans", k) for k in base),
        F.sha2(pii.joined(only("spans", base)), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.find(docs, secret_scan.train(docs))
    base = secret_scan.KINDS[:3]
    return found.select(
        "doc_id",
        *(count_of("spans", k) for k in base),
        F.sha2(secret_scan.joined(only("spans", base)), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
        count_of("spans", "format"),
    )


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 3),
c AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY k),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters
      FROM m LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR 2 * word_chars < 5 * n_words
            OR word_chars > 12 * n_words OR 100 * n_upper > 40 * word_chars OR 100 * n_letters < 60 * word_chars) AS kept
FROM b
"""


@query("op10_quality", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.cascade(table(spark, sf_dir, "documents"), measures=("word_chars", "n_symbols", "n_dup_lines", "n_lines"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS x FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM i)),
dw AS (SELECT k, m, s, array_to_string(w[s:s + m - 1], ' ') AS x
       FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
h AS (SELECT k, item_id, s, dw.m AS m FROM dw JOIN iw ON dw.m = iw.m AND dw.x = iw.x),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(s, s + m)) AS p FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""


@query("op4_decontamination", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_repeats")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_chat")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.windows(chat.sized(turns.unionByName(extra), *public_ranks())))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
x AS (SELECT k, doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS x FROM s),
m AS (SELECT x, min(doc_id) AS least FROM x GROUP BY x),
g AS (SELECT DISTINCT k, p + j AS p FROM (SELECT k, p FROM x JOIN m USING (x) WHERE least < doc_id), (SELECT unnest(range(50)) AS j)),
l AS (SELECT k, list(p) AS gone FROM g GROUP BY k),
f AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN l USING (k)),
u AS (SELECT doc_id, len(w) AS n, len(gone) AS r, w, list_transform(range(1, len(w) + 1), lambda p: p) AS a, gone FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(CASE WHEN r = 0 THEN a ELSE list_filter(a, lambda p: NOT list_contains(gone, p)) END, lambda p: w[p]), ' ')) AS kept_sha256
FROM u
"""


@query("op11_substrings", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_NEAREST = """
a{0} AS (SELECT r, v.p AS p, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}}) AS m
       FROM v JOIN c{0} ON v.p = c{0}.p GROUP BY r, v.p)"""
OP13_ROUND = OP13_NEAREST + """,
s{0} AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c
       FROM (SELECT p, k, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT v.p AS p, m.k AS k, x, unnest(range(1, len(x) + 1)) AS j FROM v JOIN a{0} USING (r, p)) GROUP BY p, k, j)
       GROUP BY p, k),
c{1} AS (SELECT p, k, coalesce(s{0}.c, c{0}.c) AS c FROM c{0} LEFT JOIN s{0} USING (p, k)),"""
OP13_SQL = (
    """
WITH w AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, p, x[p * len(x) // 16 + 1:(p + 1) * len(x) // 16] AS x FROM w, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, r - 1 AS k, x AS c FROM v WHERE r <= 64),"""
    + OP13_ROUND.format(0, 1)
    + OP13_ROUND.format(1, 2)
    + OP13_NEAREST.format(2)
    + """,
f AS (SELECT r, string_agg(lpad(lower(hex(m.k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY r),
b AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM (SELECT p, k, unnest(c) AS x, unnest(range(len(c))) AS j FROM c2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM w JOIN f USING (r), b
"""
)


@query("op13_codebooks", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codebooks.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


OP12_FAR = 1 << 40


def _op12_least(*cells: str) -> str:
    return f"list_sort([{', '.join(cells)}])[1]"


def _op12_more(cell: str, cost: str, edits: str) -> str:
    """A cell (cost, edits) after more edits."""
    return f"{{'c': {cell}.c + {cost}, 'a': {cell}.a || '{edits}'}}"


def _op12_step() -> str:
    """The cells of states 0 to 3 after a row, from those after any insertions (w)."""
    far, more = str(OP12_FAR), "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    stays = "fault IN ('blank', 'duplicate')"

    def kept(cell: str, initial: str) -> str:
        return _op12_more(cell, f"CASE WHEN {stays} OR initial <> '{initial}' THEN {far} ELSE {more} END", "K")

    def other(cell: str) -> str:
        return _op12_more(cell, f"CASE WHEN {stays} THEN {far} ELSE 1 + {more} END", "R")

    gone = [_op12_more(f"w[{j}]", "2", "D") for j in range(1, 5)]
    return ", ".join(
        [
            gone[0],
            _op12_least(gone[1], kept("w[1]", "s")),
            _op12_least(gone[2], *(f(x) for x in ("w[1]", "w[2]", "w[4]") for f in (lambda x: kept(x, "u"), other))),
            _op12_least(gone[3], kept("w[3]", "a"), other("w[3]")),
        ]
    )


def _op12_inserted(v: str) -> str:
    """The cells after any insertions."""
    cell = [f"{v}[{j}]" for j in range(1, 5)]
    one = lambda j: _op12_more(cell[j], "5", "I")
    return f"[{cell[0]}, {cell[1]}, {_op12_least(cell[2], one(0), one(1), one(3))}, {_op12_least(cell[3], one(2), _op12_more(cell[0], '10', 'II'), _op12_more(cell[1], '10', 'II'))}]"


OP12_SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM r, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare, left(role, 1) AS initial FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(right(bare, 1), '[.!?]') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
s AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, [{{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': {OP12_FAR}, 'a': ''}}, {{'c': {OP12_FAR}, 'a': ''}}, {{'c': {OP12_FAR}, 'a': ''}}] AS v FROM c
      UNION ALL SELECT conv_id, i, [{_op12_step()}] FROM (SELECT f.*, {_op12_inserted('s.v')} AS w FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1)),
e AS (SELECT s.conv_id, {_op12_inserted('v')} AS w FROM s JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n),
p AS (SELECT conv_id, b.c AS cost, b.a AS audit FROM (SELECT conv_id, {_op12_least('w[1]', 'w[4]')} AS b FROM e)),
x AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS p FROM p WHERE audit <> ''),
y AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS m FROM x),
z AS (SELECT y.conv_id, y.p, edit, m, role, text, max(CASE WHEN m = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS s
      FROM y LEFT JOIN f ON y.conv_id IS NOT DISTINCT FROM f.conv_id AND y.i = f.i AND edit <> 'I' WHERE edit <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM z GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN p ON a.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN t ON a.conv_id IS NOT DISTINCT FROM t.conv_id
"""


@query("op12_turn_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = turn_repair.report(turn_repair.damaged(turns))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
