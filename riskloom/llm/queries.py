"""The registered queries of this package: name -> (Spark function, SQL twin or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, gnat, infill, jaccard, licences, maintext, perplexity, pieces, preference, rans, rules, suffix, warc
from riskloom.operators.skew import left_lookup
from riskloom.sources import shared

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: ASCII letters lower-cased, and the words of the two definitions, in SQL.
LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_SQL = f"regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
BLANK_SQL = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"


@query()
def op1_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    out = perplexity.score(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "word_log_perplexity")


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


@query()
def op2_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = rules.classify(docs, table(spark, sf, "labels"), usable=~held_out("_key"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op3_licences(spark: SparkSession, sf: str) -> DataFrame:
    out = licences.scan(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])
    sure = F.filter("licences", lambda x: x["confirmed"])
    return out.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
                      F.size(sure).cast("long").alias("n_confirmed"), (F.size("licences") - F.size(sure)).cast("long").alias("n_unconfirmed"),
                      F.array_join(F.transform(sure, lambda x: x["paragraph"].cast("string")), ",").alias("paragraphs"))


@query()
def op4_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix.remove(table(spark, sf, "documents"), keep=["doc_id"])
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN_SQL} AS w FROM documents),
i AS (SELECT item_id, {PLAIN_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
o AS (SELECT r, k, m, array_to_string(w[k:k + m - 1], ' ') AS g
      FROM (SELECT d.r, d.w, m.m, unnest(range(1, len(w) - m.m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p) m WHERE len(w) >= m.m)),
h AS (SELECT r, k, m, item_id FROM o JOIN p USING (m, g)),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)""")
def op5_wu_manber(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["last"] - h["first"] + 1)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query()
def op8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    out = pieces.encode(table(spark, sf, "documents"), PIECES, decoded="decoded", keep=["doc_id"])
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, {BLANK_SQL.format(LOWER_SQL.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') AS g FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 175 * c >= 75 * (x.n + y.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""")
def op6_signature_tree(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.group(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op7_rans(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared.scratch(spark, "ids")
    rans.write(table(spark, sf, "documents"), folder, WORDS, end=1)
    return rans.read(spark, folder).select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


@query("""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)""")
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared.scratch(spark, "warc")
    warc.write(table(spark, sf, "pages"), folder)
    page = lambda c: F.nullif(F.regexp_extract(c, "page:(-?[0-9]*)", 1), F.lit("")).cast("long")
    whole = F.col("payload").isNotNull()
    return warc.read(spark, folder).select(
        page("record_id").alias("page_id"), F.when(whole, F.length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))


@query("""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
f AS (SELECT conv_id, turns[1].role || chr(10) || turns[1].text AS opening FROM c),
p AS (SELECT 'opening' AS kind, m.a AS chosen_id, f.conv_id AS rejected_id FROM f JOIN (SELECT opening, min(conv_id) AS a FROM f GROUP BY opening) m USING (opening) WHERE f.conv_id > m.a
      UNION ALL SELECT 'neighbour', conv_id, next FROM (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS next FROM c) WHERE next IS NOT NULL),
b AS (SELECT p.*, x.turns AS a, y.turns AS b, least(len(x.turns), len(y.turns)) AS m FROM p JOIN c x ON x.conv_id = chosen_id JOIN c y ON y.conv_id = rejected_id),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: a[i] <> b[i])) - 1, m) AS n FROM b),
r AS (SELECT *, '<|im_start|>' AS o, '<|im_end|>' AS e FROM n)
SELECT kind, chosen_id, rejected_id, CAST(n AS BIGINT) AS n_prompt_turns,
  sha256(array_to_string(list_transform(a[1:n], lambda t: o || replace(replace(t.role, o, '< |im_start|>'), e, '< |im_end|>') || chr(10) || replace(replace(t.text, o, '< |im_start|>'), e, '< |im_end|>') || e || chr(10)), '')) AS prompt_sha256,
  sha256(array_to_string(list_transform(a[n + 1:], lambda t: o || replace(replace(t.role, o, '< |im_start|>'), e, '< |im_end|>') || chr(10) || replace(replace(t.text, o, '< |im_start|>'), e, '< |im_end|>') || e || chr(10)), '')) AS chosen_sha256,
  sha256(array_to_string(list_transform(b[n + 1:], lambda t: o || replace(replace(t.role, o, '< |im_start|>'), e, '< |im_end|>') || chr(10) || replace(replace(t.text, o, '< |im_start|>'), e, '< |im_end|>') || e || chr(10)), '')) AS rejected_sha256,
  CAST(coalesce(list_sum(list_transform(list_filter(a[n + 1:], lambda t: t.role = 'assistant'), lambda t: length(replace(replace(t.text, o, '< |im_start|>'), e, '< |im_end|>')) + 11)), 0) AS BIGINT) AS chosen_trained,
  CAST(coalesce(list_sum(list_transform(list_filter(b[n + 1:], lambda t: t.role = 'assistant'), lambda t: length(replace(replace(t.text, o, '< |im_start|>'), e, '< |im_end|>')) + 11)), 0) AS BIGINT) AS rejected_trained
FROM r""")
def op10_preference(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    out = preference.format_pairs(preference.pair_up(turns), turns)
    whole = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: x["text"]), ""), 256)
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.when(x["trained"], F.length(x["text"])).otherwise(0))
    return out.select("kind", "chosen_id", "rejected_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), F.sha2("prompt", 256).alias("prompt_sha256"),
                      whole("chosen").alias("chosen_sha256"), whole("rejected").alias("rejected_sha256"), trained("chosen").alias("chosen_trained"), trained("rejected").alias("rejected_trained"))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""")
def op12_infill(spark: SparkSession, sf: str) -> DataFrame:
    out = infill.transform(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: One round in SQL: nearest entries of codebook c{0} as a{0}, then codebook c{1}.
_ASSIGN = """a{0} AS (SELECT r, p.part, any_value(p.x) AS x, min(list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * 64 + c.i) AS m
       FROM p JOIN c{0} c ON c.part = p.part GROUP BY r, p.part),"""
_MEAN = """s{0} AS (SELECT part, i, k, sum(x[k]) AS s, count(*) AS n FROM (SELECT part, m % 64 AS i, x, unnest(range(1, len(x) + 1)) AS k FROM a{0}) GROUP BY ALL),
m{0} AS (SELECT part, i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS x FROM s{0} GROUP BY part, i),
c{1} AS (SELECT part, i, coalesce(m{0}.x, c{0}.x) AS x FROM c{0} LEFT JOIN m{0} USING (part, i)),"""


@query(f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * x) AS BIGINT)) AS v
           FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT r, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM (SELECT r, v, unnest(range(16)) AS part FROM e)),
c0 AS (SELECT part, r AS i, x FROM p WHERE r < 64),
{_ASSIGN.format(0)} {_MEAN.format(0, 1)} {_ASSIGN.format(1)} {_MEAN.format(1, 2)} {_ASSIGN.format(2)}
o AS (SELECT r, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, i)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN o USING (r), b""")
def op13_gnat(spark: SparkSession, sf: str) -> DataFrame:
    out, books = gnat.compress(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
    same = F.when(F.col("label").isNull(), "none").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    made = shared.materialize(out.select("vec_id", same.alias("same"), F.lower(F.hex("code")).alias("code"), "error"))
    sums = shared.materialize(made.groupBy("same").agg(F.sum("error").alias("label_error")))
    return left_lookup(made, sums, "same").select("vec_id", "code", "error", "label_error", F.lit(gnat.digest(books)).alias("codebooks_sha256"))


@query()
def op11_maintext(spark: SparkSession, sf: str) -> DataFrame:
    out = maintext.extract(table(spark, sf, "pages").select("page_id", "url", "html"), text="text", keep=["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))
