"""Scans and sinks: derived files are landed from the tables, then read back by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import Section, fresh_path, land_csv
from catalog.roles import AREAS_SQL, DIMS, SCORED_SQL, table, with_sql
from zonometry.operators.rank import exact_quantiles, global_index
from zonometry.operators.serve import place_label
from zonometry.operators.stats import safe_corr
from zonometry.sinks import tables as sink
from zonometry.sources import nested, tabular

S = Section()


@S.query("scan_csv_varchar", """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey,
  CAST(l_quantity AS VARCHAR) AS l_quantity FROM lineitem WHERE l_returnflag = 'R'""")
def scan_csv_varchar(spark, sf):
    li = table(spark, sf, "lineitem")
    path = land_csv(li, "lineitem")
    return tabular.read_text_csv(spark, path, li.columns, ["l_orderkey", "l_partkey", "l_quantity"],
                                 F.col("l_returnflag") == "R")


@S.query("scan_csv_columns", "SELECT CAST(c_custkey AS VARCHAR) AS code, CAST(c_acctbal AS VARCHAR) AS balance FROM customer")
def scan_csv_columns(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("5-digit Code"), F.col("c_name").alias("Name"),
        F.col("c_acctbal").alias("Account Balance raw value"))
    path = land_csv(c, "customer")
    df, absent = tabular.read_columns(
        spark, path, {"code": "5-digit code", "balance": "balance RAW value", "gone": "no such label"}, "contains",
        required=("code",))
    assert absent == ["gone"]
    return df


@S.query("scan_delimited", "SELECT CAST(p_partkey AS VARCHAR) AS partkey, 'é ' || p_name AS name FROM part")
def scan_delimited(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias(" partkey  "), F.concat(F.lit("é "), F.col("p_name")).alias("name "))
    path = land_csv(p, "part", "|", "ISO-8859-1", keep_space=True)
    names = tabular.header_of(spark, path, "|", "ISO-8859-1")
    return tabular.read_text_csv(spark, path, names, names, sep="|", encoding="ISO-8859-1")


@S.query("scan_skip_header_row", """SELECT CAST(c_custkey AS VARCHAR) AS fips, CAST(c_acctbal AS VARCHAR) AS value
  FROM customer""")
def scan_skip_header_row(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("fips"), F.col("c_acctbal").cast("string").alias("value"))
    code = spark.createDataFrame([("fipscode", "v001_rawvalue")], c.schema)
    path = land_csv(code.unionByName(c), "coded")
    return tabular.skip_code_row(tabular.read_text_csv(spark, path, c.columns, c.columns), "fips")


@S.query("scan_thousands_na", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders""")
def scan_thousands_na(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") == "P", "*").otherwise(F.format_number("o_totalprice", 2)).alias("price"))
    path = land_csv(o, "orders")
    df = tabular.read_text_csv(spark, path, o.columns, o.columns)
    return df.select("o_orderkey", tabular.thousands(F.col("price")).alias("price"))


def _chunked(df, cols, chunk="chunk"):
    """JSON pieces of about 500 customers each."""
    return df.withColumn(chunk, F.floor(F.col("c_custkey") / 500)).groupBy(chunk).agg(
        F.collect_list(F.struct(*cols)).alias("rows"))


@S.query("scan_json_row_arrays", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment FROM customer")
def scan_json_row_arrays(spark, sf):
    rows = _chunked(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"])
    body = F.transform("rows", lambda r: F.array(
        r["c_mktsegment"], r["c_name"], r["c_custkey"].cast("string")))
    payload = F.to_json(F.concat(F.array(F.array(F.lit("segment"), F.lit("name"), F.lit("key"))), body))
    return nested.row_arrays(rows.select(payload.alias("payload")), "payload", ["key", "segment"])


@S.query("scan_json_features", "SELECT c_custkey AS id, c_acctbal AS rate FROM customer")
def scan_json_features(spark, sf):
    rows = _chunked(table(spark, sf, "customer"), ["c_custkey", "c_acctbal"])
    feats = F.transform("rows", lambda r: F.struct(
        F.struct(r["c_custkey"].alias("id"), r["c_acctbal"].alias("rate")).alias("attributes")))
    payload = F.to_json(F.struct(feats.alias("features")))
    return nested.feature_attributes(rows.select(payload.alias("payload")), "payload", "id bigint, rate double")


def _matrix_files(spark, sf):
    """One matrix export per 500 customers: preamble, Year row, key header, cells, TOTAL trailer."""
    years = list(range(1995, 2002))
    o = table(spark, sf, "orders")
    per = o.withColumn("y", F.year("o_orderdate")).groupBy("o_custkey").pivot("y", years).agg(F.count(F.lit(1)))
    cells = [F.when(F.col(str(y)).isNull(), "0").when(F.col(str(y)) == 3, "*")
             .when(F.col(str(y)) == 2, '"1,002"').otherwise(F.col(str(y)).cast("string")) for y in years]
    line = F.concat_ws(",", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), *cells)
    body = per.select(F.floor(F.col("o_custkey") / 500).alias("part"), F.lit(3).alias("ord"), line.alias("value"))
    head = body.select("part").distinct()
    fixed = [(0, "Counts by area"), (1, "Year:," + ",".join(map(str, years))),
             (2, "Zip / ZCTA," + ",".join("Count" for _ in years)), (4, "TOTAL," + ",".join("99" for _ in years))]
    for ord_, text in fixed:
        body = body.unionByName(head.select("part", F.lit(ord_).alias("ord"), F.lit(text).alias("value")))
    path = fresh_path(spark, "matrix")
    body.repartition("part").sortWithinPartitions("part", "ord", "value").select("part", "value").write.partitionBy("part").text(path)
    return path


MATRIX_SQL = """
cnt AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1, 2),
grid AS (SELECT DISTINCT o_custkey, CAST(y AS INTEGER) AS year FROM cnt, range(1995, 2002) t(y)),
matrix AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS key, year,
  CASE coalesce(n, 0) WHEN 3 THEN NULL WHEN 2 THEN 1002.0 ELSE CAST(coalesce(n, 0) AS DOUBLE) END AS count,
  coalesce(n, 0) = 3 AS censored FROM grid LEFT JOIN cnt USING (o_custkey, year))
"""


@S.query("scan_preamble_matrix", with_sql(MATRIX_SQL) + "SELECT * FROM matrix")
def scan_preamble_matrix(spark, sf):
    return tabular.read_matrix_export(spark, _matrix_files(spark, sf), key_width=10).drop("file")


@S.query("scan_parquet", "SELECT l_orderkey, l_quantity FROM lineitem")
def scan_parquet(spark, sf):
    return tabular.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@S.query("scan_columnar_json", """SELECT c_custkey, c_mktsegment, CAST(round_even(c_acctbal, 0) AS BIGINT) AS c_acctbal,
  c_acctbal > 0 AS positive FROM customer""")
def scan_columnar_json(spark, sf):
    c = table(spark, sf, "customer").withColumn("positive", F.col("c_acctbal") > 0)
    frames = sink.columnar_records(c, "c_nationkey", "c_custkey", ["c_mktsegment", "c_acctbal", "positive"])
    return nested.columnar_frame(frames, "payload", {
        "c_custkey": "bigint", "c_mktsegment": "string", "c_acctbal": "bigint", "positive": "int"}, flags=("positive",))


@S.query("scan_tsv_discharges", """SELECT lpad(CAST((o_custkey * 61) % 100000 AS VARCHAR), 5, '0') AS "PAT_ZIP",
  o_orderpriority AS "PRINC_DIAG_CODE" FROM orders WHERE o_orderstatus <> 'P'""")
def scan_tsv_discharges(spark, sf):
    zip5 = F.lpad(F.pmod(F.col("o_custkey") * 61, F.lit(100000)).cast("string"), 5, "0")
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("RECORD_ID"), F.when(F.col("o_orderstatus") == "P", "XXXXX").otherwise(zip5).alias("PAT_ZIP"),
        F.col("o_orderpriority").alias("PRINC_DIAG_CODE"))
    return tabular.read_discharges(spark, land_csv(o, "discharges", "\t"), "PAT_ZIP", "PRINC_DIAG_CODE")


def _features(spark, sf):
    """Feature collections of square outlines around each customer point; every ninth has none."""
    c = table(spark, sf, "customer")
    lat, lon = R.point(F.col("c_custkey"))
    c = c.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("area"), lat, lon)

    def corner(dx, dy):
        return F.array(F.col("lon") + dx, F.col("lat") + dy)

    ring = F.array(corner(-0.25, -0.25), corner(0.25, -0.25), corner(0.25, 0.25), corner(-0.25, 0.25))
    geom = F.when(F.col("c_custkey") % 9 != 0, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    c = c.withColumn("geometry", geom).withColumn("properties", F.struct("area"))
    rows = _chunked(c, ["properties", "geometry"])
    return rows.select(F.to_json(F.struct(F.col("rows").alias("features")), {"ignoreNullFields": "false"}).alias("payload"))


@S.query("geometry_universe", "SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS area FROM customer WHERE c_custkey % 9 <> 0")
def geometry_universe(spark, sf):
    return nested.geometry_universe(_features(spark, sf), "payload", "area", need_geometry=True)


@S.query("vertex_centroid", f"""SELECT area, round(lon, 9) AS lon, round(lat, 9) AS lat FROM (
  SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS area, {R.point_sql('c_custkey')} FROM customer) WHERE k % 9 <> 0""")
def vertex_centroid(spark, sf):
    from zonometry.operators.aggregates import vertex_centroid as centroid

    ring = "struct<type: string, coordinates: array<array<array<double>>>>"
    schema = f"features array<struct<properties: struct<area: string>, geometry: {ring}>>"
    f = _features(spark, sf).select(F.explode(F.from_json("payload", schema)["features"]).alias("f"))
    shapes = f.where(F.col("f.geometry").isNotNull()).select("f.properties.area", F.col("f.geometry.coordinates").alias("coords"))
    return centroid(shapes, "area", "coords").select("area", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


# ---- sinks -----------------------------------------------------------------------------------

_PICK = ["area", "state", "score", "tier"]


@S.query("sink_parquet", with_sql(SCORED_SQL) + "SELECT area, state, score, tier FROM scored")
def sink_parquet(spark, sf):
    path = fresh_path(spark, "scored")
    sink.write_parquet(R.scored(spark, sf).select(*_PICK), path, ["state"])
    return spark.read.parquet(path).select(*_PICK)


@S.query("sink_csv_gz", with_sql(SCORED_SQL) + "SELECT area, state, score, tier FROM scored")
def sink_csv_gz(spark, sf):
    path = fresh_path(spark, "scored-csv")
    sink.write_csv_gz(R.scored(spark, sf).select(*_PICK), path)
    return spark.read.schema("area string, state string, score double, tier int").option("header", "true").csv(path)


@S.query("sink_columnar_json", with_sql(SCORED_SQL) + """SELECT area, city, CAST(round_even(pctile, 0) AS BIGINT) AS pctile,
  CAST(n_dims_scored AS INTEGER) AS n_dims_scored, scoreable FROM scored""")
def sink_columnar_json(spark, sf):
    frames = sink.columnar_records(R.scored(spark, sf), "state", "area", ["city", "pctile", "n_dims_scored", "scoreable"])
    path = fresh_path(spark, "frames")
    sink.write_json(frames, path, ["state"])
    back = spark.read.schema("payload string").json(path)
    return nested.columnar_frame(back, "payload", {
        "area": "string", "city": "string", "pctile": "bigint", "n_dims_scored": "int", "scoreable": "int"}, flags=("scoreable",))


@S.query("sink_prefix_shards", with_sql(SCORED_SQL) + """SELECT substr(zip, 1, 3) AS prefix, zip, round(score, 4) AS score,
  score IS NOT NULL AS has_score FROM scored""")
def sink_prefix_shards(spark, sf):
    shards = sink.prefix_shards(R.scored(spark, sf), "zip", ["state", "score", "tier", "scoreable"])
    path = fresh_path(spark, "shards")
    shards = shards.withColumn("part", F.col("prefix"))
    sink.write_json(shards.repartitionByRange("part", "zip"), path, ["part"])  # a hot prefix spans several tasks
    back = spark.read.schema("prefix string, zip string, record string").json(path)
    score = F.get_json_object("record", "$.score").cast("double")
    return back.select("prefix", "zip", score.alias("score"), F.col("record").contains('"score"').alias("has_score"))


_MORE = {"area": ("identifier", "Area code", ""), "population": ("context", "Total quantity", "pieces"), "score": ("score", "Composite", "score 0-100"), "tier": ("score", "Decile", "1-10")}
_ENTRIES = {e[0]: e for e in sink.model_entries(R.MODEL, _MORE)}
# columns of the scored table, the last without an entry
_DICT = {"area": "string", "population": "double", "score": "double", "tier": "int", **{m.column: "double" for _, m in R.MODEL.measures},
         **{c: "double" for c in [*R.SUBS, *DIMS]}, "o_tax": "double"}


def _entry_sql(c: str) -> str:
    names = ["group", "description", "source", "direction", "resolution", "units"]
    cells = [f"""'{v.replace("'", "''")}'""" for v in _ENTRIES[c][1:]] if c in _ENTRIES else ["'undocumented'", *["NULL"] * 5]
    return ", ".join(f'{v} AS "{n}"' for v, n in zip(cells, names))


@S.query("data_dictionary", with_sql(SCORED_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, '{d}' AS dtype, {_entry_sql(c)} FROM scored" for c, d in _DICT.items()))
def data_dictionary(spark, sf):
    """Every column of the model with group, source, direction, resolution and units."""
    entries = spark.createDataFrame(list(_ENTRIES.values()), sink.ENTRY)
    return sink.data_dictionary(R.scored(spark, sf).select(*_DICT), entries)


_QUANTS = (5, 25, 50, 75, 95)
_PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in list(DIMS)[i + 1 :]]


@S.query("run_metrics", with_sql(SCORED_SQL) + " UNION ALL ".join(
    f"SELECT 'score' AS stage, '{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM scored" for n, e in [
        ("rows", "count(*)"), ("with_score", "count(score)"), ("low_confidence", "count_if(low_confidence)"),
        ("institutional", "count_if(institutional)"), *[(f"p{q}", f"round(quantile_cont(score, {q / 100}) FILTER (WHERE scoreable), 6)") for q in _QUANTS],
        *[(f"corr {a} {b}", f"round(corr({a}, {b}), 6)") for a, b in _PAIRS]]))
def run_metrics(spark, sf):
    """Counts, dimension correlations and the quantiles of the score, a fingerprint to compare builds by."""
    df = R.scored(spark, sf)
    rows = sink.run_metrics(df, "score", {
        "rows": F.count(F.lit(1)), "with_score": F.count("score"), "low_confidence": F.count_if("low_confidence"),
        "institutional": F.count_if("institutional"), **{f"corr {a} {b}": F.round(safe_corr(a, b), 6) for a, b in _PAIRS}})
    names = [f"p{q}" for q in _QUANTS]
    at = exact_quantiles(df.where("scoreable"), "score", [q / 100 for q in _QUANTS], names=names).select(*[F.round(n, 6).alias(n) for n in names])
    return rows.unionByName(at.unpivot([], names, "metric", "value").withColumn("stage", F.lit("score")))


@S.query("csv_export_ranked", with_sql(SCORED_SQL) + """SELECT row_number() OVER (ORDER BY score DESC, area) AS rank, area,
  coalesce(city, county_name, '') AS place, state, round(score, 1) AS value, tier
  FROM scored WHERE scoreable AND NOT low_confidence AND NOT institutional AND n_dims_scored >= 3 AND score IS NOT NULL""")
def csv_export_ranked(spark, sf):
    from zonometry.operators.serve import headline

    rows = headline(R.scored(spark, sf), "score", {"score"})
    ranked = global_index(rows.select("area", "city", "county_name", "state", "score", "tier"),
                          [F.col("score").desc(), F.col("area")], "pos", "export")
    out = ranked.select(
        (F.col("pos") + 1).alias("rank"), "area", place_label(F.col("city"), F.col("county_name"), F.lit("")).alias("place"),
        "state", F.round("score", 1).alias("value"), "tier")
    path = land_csv(out, "ranked")
    return spark.read.schema(out.schema).option("header", "true").csv(path)


QUERIES, SQL = S.queries, S.sql
