"""Registered queries of the text operators: each over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonometry.llm import bpe, classifier, codebooks, decontaminate, hilbert, hnsw, lines, neardup, quality, runs, suffixes, transcripts, urls
from zonometry.session import stage

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM wins)
  WHERE i + n - 1 <= len(w)
), hits AS (
  SELECT doc_id, i, r.n, item_id FROM runs r JOIN wins USING (win)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS item_list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(item_list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


@query("op4_benchmark_decontamination", OP4_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op6_quality_rules")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    by = ["lang", "source"]
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    slim = stage(quality.statistics(docs, keep=["doc_id", *by]), "quality-statistics")
    keys, params = quality.fit(slim, by)
    return quality.judge(slim, keys, params, by).select("doc_id", *quality.STATS, "base_failed", "distance", "kept")


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, keep=["doc_id"]))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_minhash_odd_sketch")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = neardup.linked(docs, width=2)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


@query("op2_hilbert_shards")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    slim = stage(docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32("text").alias("text_crc32")), "shard-rows")
    dims = {
        "source": hilbert.text_code(F.col("source")), "lang": hilbert.text_code(F.col("lang")),
        "size": hilbert.number_code(F.log2("size")), "doc_id": hilbert.number_code(F.col("doc_id")),
    }
    out = hilbert.curve_shards(slim, dims, 40, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


# fixed values of the contract
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

OP9_SQL = """
WITH u AS (
  SELECT page_id, html,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), k AS (
  SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '') AS key FROM u
), listed AS (
  SELECT DISTINCT key FROM k WHERE key <> '' AND regexp_matches(html, '<title>[^<]*(###|\\*\\*\\*|\\$\\$\\$|%%%)')
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM k
)
SELECT page_id, host, path, rule, l.key IS NOT NULL AS listed,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN listed l ON r.key = l.key
"""


@query("op9_url_bloom_filter", OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Listed are the URLs of pages whose title carries symbol junk; other addresses of the same page are caught by them."""
    pages = table(spark, sf, "pages")
    listed = pages.where(F.col("html").rlike(r"<title>[^<]*(###|\*\*\*|\$\$\$|%%%)")).select("url")
    out = urls.filter_urls(pages.select("page_id", "url"), listed, RULES)
    return out.select("page_id", "host", "path", "rule", "listed", "verdict")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = classifier.fit(docs, table(spark, sf, "labels"))
    scored = classifier.score(docs, model).drop("text")
    return scored.select("doc_id", classifier.held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op10_transcript_roles")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations as raw transcripts; their roles recovered from the lines alone."""
    raw = transcripts.as_lines(table(spark, sf, "conversations"))
    model = transcripts.learn(stage(transcripts.observed(raw).drop("raw", "body"), "labelled-lines"))
    found = transcripts.parse(raw.select("conv", "turn", "line", "raw"), model)
    return found.select(F.col("conv").cast("long").alias("conv_id"), "turn", "line", "role", "opens", "piece")


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, list_filter(string_split(line, ' '), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
), o AS (
  SELECT *, len(w) AS n, row_number() OVER (ORDER BY doc_id, i) AS pos FROM l
), e AS (
  SELECT w, n, min(pos) AS first FROM o WHERE n >= 3 GROUP BY w, n
), h AS (
  SELECT w, n, first, unnest([(0, n // 2, w[1 : n // 2]), (1, n // 2, w[n - n // 2 + 1 : n]),
                              (0, (n - 1) // 2, w[1 : (n - 1) // 2]), (1, (n - 1) // 2, w[n - (n - 1) // 2 + 1 : n])]) AS k
  FROM e WHERE n >= 10
), near AS (
  SELECT DISTINCT a.first FROM h a JOIN h b ON a.k = b.k AND b.first < a.first
  WHERE CASE WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda j: a.w[j] <> b.w[j])) = 1
             WHEN a.n = b.n + 1 THEN len(list_filter(range(1, a.n + 1), lambda j: list_concat(a.w[1 : j - 1], a.w[j + 1 : a.n]) = b.w)) > 0
             WHEN a.n + 1 = b.n THEN len(list_filter(range(1, b.n + 1), lambda j: list_concat(b.w[1 : j - 1], b.w[j + 1 : b.n]) = a.w)) > 0
             ELSE false END
), judged AS (
  SELECT o.doc_id, o.i, o.line, o.n >= 3 AND (o.pos > e.first OR e.first IN (SELECT first FROM near)) AS gone
  FROM o LEFT JOIN e ON o.w = e.w
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)), '') AS text
FROM judged GROUP BY doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = suffixes.remove_repeats(docs).drop("text")
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def looped(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The contract's texts of op11: for a tenth of the ids the words from place a on are those of one period, over and over."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10).cast("long")

    def again(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        loop = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(loop, F.lit(1), n - a)), " ")).otherwise(F.col(text))

    # the words are bound once, as the variable of a lambda
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((h % 10 == 0) & F.col(text).isNotNull(), F.transform(F.array(words), again)[0]).otherwise(F.col(text))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", looped().alias("text"))
    found = runs.periodic_runs(docs, keep=["doc_id"])
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q")))
    top = F.array_min(order)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    told = found.withColumn("top", top).withColumn("told", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    length = -F.col("top.l")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), length.alias("length"), F.col("top.q").alias("period"),
        F.floor(1000 * length / F.col("top.q")).cast("long").alias("exponent_milli"),
        F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_sql() -> str:
    """Six rounds over integer parts, each an assignment of all parts and a mean of each entry's."""
    near = """
a{r} AS MATERIALIZED (
  SELECT id, p, v, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT v.id, v.p, v.v, c.e, list_sum(list_transform(range(1, len(v.v) + 1), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))) AS d FROM parts v JOIN c{r} c ON v.p = c.p)
  GROUP BY id, p, v
)"""
    mean = """
c{n} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v
    FROM (SELECT p, e, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS j FROM a{r}) GROUP BY p, e, j)
    GROUP BY p, e
  ) m ON c.p = m.p AND c.e = m.e
)"""
    rounds = ",".join(near.format(r=r) + ("," + mean.format(r=r, n=r + 1) if r < 6 else "") for r in range(7))
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS v FROM (SELECT id, v, unnest(range(8)) AS p FROM k)
), c0 AS MATERIALIZED (
  SELECT p, id - 1 AS e, v FROM parts WHERE id <= 16
), {rounds}, coded AS (
  SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM c6)) AS codebooks_sha256
FROM k JOIN coded USING (id)
"""


@query("op12_vector_codes", op12_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    rows, books = codebooks.compress(table(spark, sf, "embeddings"), keep=["vec_id", "label"])
    rows = rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    by_label = rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


@query("op13_hnsw_near_dedup")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")
