"""The operators as registered queries, with the result columns that each query fixes."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm.common import shared_dir, table, written
from mdloom.llm.conversation_repair import audits, repair_reports
from mdloom.llm.decontaminate import contamination
from mdloom.llm.embedding_links import embedding_links
from mdloom.llm.jaccard_join import jaccard_components
from mdloom.llm.language_model import score_documents
from mdloom.llm.packing import pack_documents
from mdloom.llm.periodic_runs import periodic_runs
from mdloom.llm.quality import learn_quality, score_quality
from mdloom.llm.repeats import repeated_spans
from mdloom.llm.secret_scan import KINDS, find_secrets, learn_secrets
from mdloom.llm.token_counts import token_counts
from mdloom.llm.token_files import read_token_files, write_token_files
from mdloom.llm.url_filter import url_verdicts

TOKENIZER = "byte_bpe_50k.json"


def fold_of(parts: int) -> Column:
    """The fold of a row: crc32 of its doc_id as text; fold 1 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def quality_labels(labels: DataFrame) -> DataFrame:
    return labels.where(fold_of(3) != 1).select("doc_id", F.col("quality").alias("label"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), fold_of(5) != 1)
    return out.select("doc_id", (fold_of(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), folder)
    return read_token_files(spark, folder)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, learn_quality(docs, quality_labels(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", (fold_of(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = find_secrets(docs, learn_secrets(docs))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    joined = {c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",") for c in ("base", "findings")}
    return out.select("doc_id", *counts, F.sha2(joined["base"].cast("binary"), 256).alias("base_sha256"), joined["findings"].alias("spans"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: with h the crc32 of doc_id and g = h div 10, texts of h % 10 = 0 go on from word g % n with the period that the
    contract sets; others, and those of null ids, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def turned(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return docs.select("doc_id", F.when((h % 10 == 0) & (F.trim(F.col("text"), F.lit(" \t\n\x0b\f\r")) != ""), F.get(F.transform(F.array(words), turned), F.lit(0))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("best.shorter") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, there: rows damaged by the crc32 of conv_id:turn modulo 20; a dropped row isn't there but still
    names its conversation."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fault != 0).alias("there"), F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", "there", F.explode("copies").alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repair_reports(rows, written(audits(rows), "audits"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_token_files, op3_token_counts, op4_decontamination, op5_url_filter, op6_suffix_dedup, op7_packing, op8_quality, op9_jaccard_join, op10_embedding_links, op11_secret_scan, op12_periodic_runs, op13_conversation_repair)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS span
      FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
m AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS span
      FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT doc_id, m.n, s, item_id FROM m JOIN i ON m.span = i.span AND m.n = i.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM w JOIN f USING (s) WHERE doc_id > least),
r AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM o) GROUP BY 1, 2),
k AS (SELECT r.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, any_value(substr(h, 1, 2 * (first_a))) AS h0,
      string_agg(substr(h, 2 * b + 1, 2 * (next_a - b)), '' ORDER BY a) AS h1
      FROM (SELECT *, lead(a, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY a) AS next_a, min(a) OVER (PARTITION BY doc_id) AS first_a FROM r) r JOIN d ON d.doc_id = r.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(h0 || h1, h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

_REACH = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
"""

_OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS x
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS k FROM s JOIN s t USING (x) WHERE s.doc_id <> t.doc_id GROUP BY 1, 2)
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
{_REACH}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least_of.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON least_of.a = d.doc_id
"""

_OP10 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(x, x) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
          WHERE list_dot_product(p.x, q.x) / sqrt(list_dot_product(p.x, p.x)) / sqrt(list_dot_product(q.x, q.x)) >= 0.95),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, least(vec_id, coalesce(least_of.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least_of.b, vec_id)) AS kept
FROM v LEFT JOIN least_of ON least_of.a = vec_id
"""



def _crc32(x: str) -> str:
    """The crc32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({x}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {bits}), 4294967295)"


#: Runs by ranks of 1, 2, 4 ... words (as in prefix doubling): where a rank's next occurrence, q words on, is more than half its
#: own length away and at most all of it, places in a row with the same q are one run of period q.
_OP12 = rf"""
WITH RECURSIVE o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM o),
p AS (SELECT *, 1 + (len(o) - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN o ELSE list_transform(o, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE o[a + (i - 1 - a) % p + 1] END) END AS w FROM p),
w AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM d),
ranks AS (SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY x) AS r, 0 AS k FROM w
          UNION ALL SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY r, s), k + 1
          FROM (SELECT doc_id, i, r, k, lead(r, 1 << k) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM ranks) WHERE s IS NOT NULL),
near AS (SELECT doc_id, i, k, lead(i) OVER (PARTITION BY doc_id, k, r ORDER BY i) - i AS q FROM ranks),
runs AS (SELECT doc_id, min(i) AS s, max(i) - min(i) + q + (1 << k) AS n, q
         FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, k, q ORDER BY i) AS island FROM near WHERE q <= 1 << k AND 2 * q > 1 << k)
         GROUP BY doc_id, k, q, island HAVING max(i) - min(i) + q + (1 << k) >= greatest(6, 4 * q)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n_runs, min({{'l': -n, 's': s, 'q': q}}) AS best, string_agg(concat(s, ',', n, ',', q, chr(10)), '' ORDER BY s, q) AS t FROM runs GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(-best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(-1000 * best.l // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(r.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""



def _edits() -> str:
    """One row's step of op13, forward: the cheapest (cost, edits, messages) for each state, of all ways to get there; inserts last."""
    def way(f: str, cost: str, letter: str, message: str = "", when: str = "TRUE") -> str:
        said = f"list_append({f}.t, {message})" if message else f"{f}.t"
        return f"CASE WHEN {when} THEN {{'c': {f}.c + {cost}, 'e': {f}.e || '{letter}', 't': {said}}} END"

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"

    stays, own, user, other = "NOT gone", "role || ':' || text", "'user:' || text", "'assistant:' || text"
    keeps = lambda f, initial: way(f, "cut", "K", own, f"{stays} AND left(role, 1) = '{initial}'")
    reads = {
        "g0": [way("f0", "3", "D"), keeps("f0", "")],
        "g1": [way("f1", "3", "D"), keeps("f1", ""), keeps("f0", "s")],
        "g2": [way("f2", "3", "D"), keeps("f2", ""), *(keeps(f, "u") for f in ("f0", "f1", "f3")), *(way(f, "2 + cut", "R", user, stays) for f in ("f0", "f1", "f3"))],
        "g3": [way("f3", "3", "D"), keeps("f3", ""), keeps("f2", "a"), way("f2", "2 + cut", "R", other, stays)],
    }
    return ", ".join(f"{least(*ways)} AS {g}" for g, ways in reads.items())


def _inserts(g: tuple[str, str, str, str]) -> str:
    """The same after inserts, of which more than two are never cheapest."""
    def one(f: str) -> str:
        return f"{{'c': {f}.c + 2, 'e': {f}.e || 'I', 't': list_append({f}.t, 'user:')}}"

    def two(f: str) -> str:
        return f"{{'c': {f}.c + 4, 'e': {f}.e || 'II', 't': list_append(list_append({f}.t, 'user:'), 'assistant:')}}"

    third = f"{{'c': {g[2]}.c + 2, 'e': {g[2]}.e || 'I', 't': list_append({g[2]}.t, 'assistant:')}}"
    return f"{g[0]} AS f0, {g[1]} AS f1, list_sort([{g[2]}, {one(g[0])}, {one(g[1])}, {one(g[3])}])[1] AS f2, list_sort([{g[3]}, {third}, {two(g[0])}, {two(g[1])}])[1] AS f3"


_NOWHERE = "{'c': 1000000, 'e': '', 't': ['']}"
_OP13 = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS fault FROM conversations),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lead(role) OVER (PARTITION BY conv_id ORDER BY n) AS following,
      NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS unended FROM o),
f AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN again THEN 'duplicate' WHEN unended THEN 'truncated' END AS fault, blank OR again AS gone, CASE WHEN unended AND NOT blank AND NOT again THEN 1 ELSE 0 END AS cut FROM q),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (following IS NOT NULL AND left(role, 1) || left(following, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM f GROUP BY 1),
s AS (SELECT conv_id, 0 AS n, f0, f1, f2, f3 FROM (SELECT conv_id, {_inserts(("z", "x", "x", "x"))} FROM (SELECT conv_id, {{'c': 0, 'e': '', 't': ['']}} AS z, {_NOWHERE} AS x FROM c))
      UNION ALL SELECT conv_id, n, {_inserts(("g0", "g1", "g2", "g3"))} FROM (SELECT s.conv_id, f.n, {_edits()} FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = s.n + 1)),
e AS (SELECT s.conv_id, list_sort([f0, f3])[1] AS best FROM s JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.n = c.n)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(array_to_string(best.t[2:], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM k) k LEFT JOIN c ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON k.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES = {"op12_periodic_runs": _OP12, "op13_conversation_repair": _OP13, "op4_decontamination": _OP4, "op6_suffix_dedup": _OP6, "op9_jaccard_join": _OP9, "op10_embedding_links": _OP10}
