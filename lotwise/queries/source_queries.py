"""HTML pages, page files, runs, predictions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from lotwise.functions.text import collected_text, page_number
from lotwise.queries.base import query, r, table
from lotwise.session import shared_folder
from lotwise.schemas import RAW_LISTINGS
from lotwise.sources import files, html, runs
from lotwise.sources.predictions import append_predictions, prediction_rows, read_predictions
from lotwise.streaming.landing import land_once, listing_stream
from lotwise.streaming.scoring import score_stream

_LINKS = r"""regexp_extract_all(html, '(?s)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1)"""


@query(f"SELECT page_id, len({_LINKS})::bigint AS n_links, {_LINKS}[1] AS first_link FROM pages")
def page_links(spark, sf):
    p = table(spark, sf, "pages")
    links = html.flat_elements(html.without_scripts(F.col("html")), "a")
    hrefs = F.transform(F.filter(links, lambda e: html.attribute(e["open"], "href").isNotNull()), lambda e: html.attribute(e["open"], "href"))
    return p.select(
        "page_id", F.size(hrefs).cast("long").alias("n_links"), F.try_element_at(hrefs, F.lit(1)).alias("first_link")
    )


@query(
    """
    WITH c AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<article>(.*?)</article>', 1)) AS body FROM pages)
    SELECT page_id, 4 AS tier, 0 AS pos, 'article' AS tag, length(body)::bigint AS chars, md5(body) AS digest FROM c
    """
)
def page_cards(spark, sf):
    found = html.cards(table(spark, sf, "pages"))
    return found.select(
        "page_id", "tier", "pos", "tag", F.length("inner").cast("long").alias("chars"), F.md5("inner").alias("digest")
    )


_BOX = "'<div>R$ ' || p_partkey || '</div><DIV class=\"small Card\">x<div><b>' || p_size || '</b></div ></DIV> tail'"


@query(
    f"""
    WITH p AS (SELECT *, CAST(floor(p_partkey / 10) AS BIGINT) AS page_id FROM part),
    n AS (SELECT *, page_id % 4 + 1 AS t, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS i FROM p),
    c AS (
      SELECT page_id, t, i AS pos, 'a' AS tag, p_name AS body FROM n WHERE t <= 2
      UNION ALL SELECT page_id, t, 2 * i, 'div', {_BOX} FROM n WHERE t = 3
      UNION ALL SELECT page_id, t, 2 * i + 1, 'div', 'x<div><b>' || p_size || '</b></div >' FROM n WHERE t = 3
      UNION ALL SELECT page_id, t, i, 'article', p_name || '<span>' || p_size || '</span>' FROM n WHERE t = 4)
    SELECT page_id, CAST(t AS INT) AS tier, CAST(pos AS INT) AS pos, tag, length(body)::bigint AS chars, md5(body) AS digest FROM c
    """
)
def page_tiers(spark, sf):
    """Pages whose cards are of each of the four kinds, boxes within boxes among them."""
    k, name = F.col("p_partkey"), F.col("p_name")
    page = F.floor(k / 10)
    box = F.concat(
        F.lit("<div>R$ "), k, F.lit('</div><DIV class="small Card">x<div><b>'), F.col("p_size"), F.lit("</b></div ></DIV> tail")
    )
    kind = page % 4
    card = (
        F.when(kind == 0, F.concat(F.lit('<a href="/imovel/'), k, F.lit('">'), name, F.lit("</a>")))
        .when(kind == 1, F.concat(F.lit("<a data-testid='Property-Card' href='/x'>"), name, F.lit("</a>")))
        .when(kind == 2, F.concat(F.lit('</div><div id="a" class="wide CARD">'), box, F.lit("</div>")))
        .otherwise(F.concat(F.lit("<article>"), name, F.lit("<span>"), F.col("p_size"), F.lit("</span></article>")))
    )
    rows = table(spark, sf, "part").select(page.alias("page_id"), k.alias("k"), card.alias("card"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda c: c["card"]), "\n")
    found = html.cards(rows.groupBy("page_id").agg(body.alias("html")))
    return found.select("page_id", "tier", "pos", "tag", F.length("inner").cast("long").alias("chars"), F.md5("inner").alias("digest"))


_STREETS = ["Rua das Flores", "Avenida Brasil", "R. Sete"]


def listing_pages(spark, sf) -> DataFrame:
    """Listing markup written from the part table: ten cards per page, four layouts in turn."""
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    street = F.element_at(F.array(*[F.lit(s) for s in _STREETS]), (k % 3 + 1).cast("int"))
    rooms, baths = (size % 5).cast("string"), (size % 4).cast("string")
    price = F.concat(F.lit("R$ "), F.translate(F.format_number(F.col("p_retailprice") * 1000, 0), ",", "."))
    title = F.concat(
        F.lit("Casa com "), (size * 3).cast("string"), F.lit(" m², "), rooms, F.lit(" quartos, "), baths,
        F.lit(" banheiros em "), street, F.lit(", Bairro"),
    )
    spans = F.concat(
        F.lit("<div><span>"), rooms, F.lit(" <b>quartos</b></span><span>"), baths,
        F.lit(" banheiros</span><span>"), (size * 3).cast("string"), F.lit(",5 m&sup2;</span></div>"),
    )
    layout = k % 4
    card = (
        F.when(layout == 0, F.concat(F.lit('<a title="'), title, F.lit('" href="/imovel/'), k, F.lit('/"><h2>'), F.col("p_name"),
               F.lit(' &amp; co</h2><p data-cy="rp-cardProperty-street-txt"> Rua '), F.col("p_brand"), F.lit(" </p>"), price, F.lit("</a>")))
        .when(layout == 1, F.concat(F.lit('<a href="http://x.example/imovel/'), k, F.lit('">'), spans, price, F.lit(",50</a>")))
        .when(layout == 2, F.concat(F.lit("<a class='c' href='/imovel/"), k, F.lit("' title='"), title, F.lit("'><!-- R$ 1 --> sem valor</a>")))
        .otherwise(F.concat(F.lit('<a href="/imovel/'), k, F.lit('">nada</a>')))
    )
    rows = p.select(F.floor(k / 10).alias("page_id"), k.alias("k"), card.alias("card"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda c: c["card"]), "\n")
    pages = rows.groupBy("page_id").agg(body.alias("body"))
    return pages.select(
        "page_id",
        F.lit("u").alias("url"),
        F.concat(F.lit("<html><body><nav><a href='/x'>x</a></nav>"), "body", F.lit("</body></html>")).alias("html"),
    )


@query(
    """
    WITH p AS (SELECT *, p_partkey % 4 AS lay, list_extract(['Rua das Flores', 'Avenida Brasil', 'R. Sete'], CAST(p_partkey % 3 + 1 AS INT)) AS st,
                      CAST(floor(p_partkey / 10) AS BIGINT) AS page_id FROM part)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS INT) AS pos, lay,
      CASE lay WHEN 0 THEN 'R$ ' || replace(format('{:,}', CAST(round_even(p_retailprice * 1000, 0) AS BIGINT)), ',', '.')
               WHEN 1 THEN 'R$ ' || replace(format('{:,}', CAST(round_even(p_retailprice * 1000, 0) AS BIGINT)), ',', '.') || ',50' END AS preco,
      CASE lay WHEN 0 THEN 'Rua ' || p_brand WHEN 2 THEN st END AS rua,
      CASE lay WHEN 0 THEN p_name || ' & co' WHEN 2 THEN st END AS endereco,
      CASE WHEN lay < 3 THEN CAST(p_size % 5 AS DOUBLE) END AS quartos,
      CASE WHEN lay < 3 THEN CAST(p_size % 4 AS DOUBLE) END AS banheiros,
      CASE lay WHEN 0 THEN CAST(p_size * 3 AS DOUBLE) WHEN 2 THEN CAST(p_size * 3 AS DOUBLE) WHEN 1 THEN p_size * 3 + 0.5::double END AS area_m2,
      CASE lay WHEN 0 THEN 'https://host.example/imovel/' || p_partkey || '/' WHEN 1 THEN 'http://x.example/imovel/' || p_partkey
               WHEN 2 THEN 'https://host.example/imovel/' || p_partkey END AS link,
      'cidade-' || (page_id % 3) AS cidade, 'pr' AS estado, '2026-02-09 08:' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || ':00' AS data_coleta
    FROM p QUALIFY lay < 3
    """
)
def page_listings(spark, sf):
    city = F.concat(F.lit("cidade-"), (F.col("page_id") % 3).cast("string"))
    when = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-02-09 08:00:00")) + F.col("page_id") % 60 * 60)
    rows = html.extract_listings(listing_pages(spark, sf), "https://host.example", city, "pr", when)
    number = F.regexp_extract("link", r"imovel/(\d+)", 1).cast("long")
    return rows.select(
        "page_id", "pos", (number % 4).alias("lay"), "preco", "rua", "endereco", "quartos", "banheiros", "area_m2", "link",
        "cidade", "estado", "data_coleta",
    )


@query(
    """
    SELECT page_id, CAST(CASE page_id % 3 WHEN 0 THEN length(html) % 90 + 1 WHEN 1 THEN greatest(page_id % 7, 2) ELSE 10 END AS INT) AS paginas,
           CAST(coalesce(try_cast(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS INT), 0) AS INT) AS pagina_url FROM pages
    """
)
def page_count(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    stated = F.concat(F.lit("<p>Página 1 de <b></b> "), F.lit("de "), (F.length("html") % 90 + 1).cast("string"), F.lit(" páginas</p>"))
    labels = F.concat(F.lit("<button aria-label='Ir para página "), (k % 7).cast("string"), F.lit("'>x</button><button aria-label=\"página 2\"/></button>"))
    added = F.when(k % 3 == 0, stated).when(k % 3 == 1, labels).otherwise(F.lit(""))
    in_url = page_number(F.concat(F.lit("pagina"), F.regexp_extract("url", r"page=([0-9]+)", 1)))
    return p.select(
        "page_id",
        html.page_count(F.concat(F.col("html"), added)).alias("paginas"),
        in_url.alias("pagina_url"),
    )


@query(
    """
    SELECT count(*) FILTER (p_partkey % 4 = 0) AS with_street, count(*) AS cards,
           round(count(*) FILTER (p_partkey % 4 = 0) / CAST(count(*) AS DOUBLE), 8) AS share FROM part
    """
)
def coverage_share(spark, sf):
    return html.street_coverage(html.cards(listing_pages(spark, sf))).withColumn("share", r("share", 8))


@query(
    """
    WITH h AS (SELECT DISTINCT event_type, CAST(floor((epoch(ts) - 1704067200) / 3600) + 1 AS BIGINT) AS page FROM events WHERE value > 60),
    s AS (SELECT event_type, page FROM h UNION ALL SELECT DISTINCT event_type, 0 FROM h),
    g AS (SELECT *, lead(page) OVER (PARTITION BY event_type ORDER BY page) AS nxt FROM s),
    c AS (SELECT event_type, min(page) AS last_page FROM g WHERE nxt IS NULL OR nxt - page >= 3 GROUP BY 1)
    SELECT event_type, last_page, count(*) AS pages FROM h JOIN c USING (event_type) WHERE page <= last_page GROUP BY 1, 2
    """
)
def empty_run_cutoff(spark, sf):
    e = table(spark, sf, "events")
    hour = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3600) + 1
    pages = e.groupBy("event_type", hour.alias("page")).agg(F.count_if(F.col("value") > 60).alias("n"))
    kept = html.useful_pages(pages, ["event_type"], "page")
    return kept.groupBy("event_type", "last_page").agg(F.count(F.lit(1)).alias("pages"))


@query(
    """
    SELECT c_custkey, CAST(floor(c_custkey / 100) AS INT) AS pagina, 'cidade-' || (c_nationkey % 3) AS cidade, c_name, c_acctbal,
           c_name || ', "n" ' || c_mktsegment AS endereco FROM customer
    """
)
def file_roundtrip(spark, sf):
    c = table(spark, sf, "customer")
    folder = shared_folder(spark, "pages")
    rows = c.select(
        "c_custkey", "c_name", "c_acctbal",
        F.concat(F.col("c_name"), F.lit(', "n" '), F.col("c_mktsegment")).alias("endereco"),
        F.concat(F.lit("cidade-"), (F.col("c_nationkey") % 3).cast("string")).alias("cidade"),
        F.lit("pr").alias("estado"),
        F.floor(F.col("c_custkey") / 100).cast("int").alias("pagina"),
    )
    files.write_pages(rows, folder)
    schema = StructType([f for f in rows.schema if f.name not in ("cidade", "estado", "pagina")])
    schema = schema.add("cidade", StringType()).add("estado", StringType()).add("pagina", IntegerType())
    back = files.read_written_pages(spark, folder, schema)
    return back.select("c_custkey", "pagina", "cidade", "c_name", "c_acctbal", "endereco")


@query(
    """
    WITH g AS (SELECT o_orderpriority AS experiment, date_trunc('month', o_orderdate) AS start_time, count(*) AS n, avg(o_totalprice) AS rmse
               FROM orders GROUP BY 1, 2),
    v AS (SELECT *, CAST(row_number() OVER (PARTITION BY experiment ORDER BY start_time) AS INT) AS version FROM g)
    SELECT experiment, strftime(start_time, '%Y-%m') AS run_id, version, round(rmse, 4) AS rmse, CAST(n AS VARCHAR) AS n_rows,
           start_time = max(start_time) OVER (PARTITION BY experiment) AS latest FROM v
    """
)
def run_registry(spark, sf):
    o = table(spark, sf, "orders")
    month = F.date_trunc("month", F.col("o_orderdate")).alias("start_time")
    log = o.groupBy(F.col("o_orderpriority").alias("experiment"), month).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("rmse")
    )
    log = log.select(
        "experiment", "start_time", F.date_format("start_time", "yyyy-MM").alias("run_id"),
        F.create_map(F.lit("n_rows"), F.col("n").cast("string")).alias("params"),
        F.create_map(F.lit("rmse"), F.col("rmse")).alias("metrics"),
    )
    folder = shared_folder(spark, "runs")
    log.write.parquet(folder)
    log = spark.read.parquet(folder)
    numbered = runs.versions(
        log.select(F.col("experiment").alias("name"), "run_id", F.col("start_time").alias("created_at"))
    )
    newest = runs.latest_runs(log).withColumn("latest", F.lit(True))
    return (
        log.join(numbered.withColumnRenamed("name", "experiment"), ["experiment", "run_id"])
        .join(newest, ["experiment", "run_id"], "left")
        .select(
            "experiment", "run_id", "version", r(F.col("metrics.rmse"), 4).alias("rmse"),
            F.col("params.n_rows").alias("n_rows"), F.coalesce("latest", F.lit(False)).alias("latest"),
        )
    )


@query(
    """
    SELECT 'vendas' AS experiment, o_orderpriority AS run_name, CAST(count(*) AS VARCHAR) AS n_rows, round(avg(o_totalprice), 4) AS rmse,
           round(max(o_totalprice), 4) AS baseline_rmse, '/modelos/' || o_orderpriority AS model_path FROM orders GROUP BY ALL
    """
)
def logged_runs(spark, sf):
    """A run logged for every order priority, with parameters, metrics, baseline and model, read back."""
    folder = shared_folder(spark, "log")
    sums = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("a"), F.max("o_totalprice").alias("m")
    )
    for row in sums.collect():  # one row for each experiment
        name = row["o_orderpriority"]
        runs.log_run(spark, folder, "vendas", name, {"n_rows": row["n"]}, {"rmse": row["a"]}, {"rmse": row["m"]}, f"/modelos/{name}")
    return runs.read_runs(spark, folder).where("run_id is not null and end_time >= start_time").select(
        "experiment", "run_name", F.col("params.n_rows").alias("n_rows"), r(F.col("metrics.rmse"), 4).alias("rmse"),
        r(F.col("metrics.baseline_rmse"), 4).alias("baseline_rmse"), "model_path",
    )


@query(
    """
    SELECT CAST(l_quantity AS INT) AS quartos, l_extendedprice AS area_m2, l_returnflag AS bairro, 'modelo' AS modelo, '1.0.0' AS versao_modelo,
           'Cidade' AS cidade, round_even(exp(l_discount * 10), 2) AS preco_predito, CAST(NULL AS DOUBLE) AS score_parque,
           true AS carimbado, count(*) AS n FROM lineitem GROUP BY ALL
    """
)
def prediction_log(spark, sf):
    li = table(spark, sf, "lineitem")
    scored = li.select(
        F.col("l_quantity").alias("quartos"), F.col("l_extendedprice").alias("area_m2"), F.col("l_returnflag").alias("bairro"),
        F.lit("Cidade").alias("cidade"), F.bround(F.exp(F.col("l_discount") * 10), 2).alias("preco_estimado"),
    )
    folder = shared_folder(spark, "predictions")
    append_predictions(prediction_rows(scored, "modelo", "1.0.0"), folder)
    back = read_predictions(spark, folder)
    stamped = F.col("id").isNotNull() & F.col("created_at").isNotNull()
    return back.groupBy(
        "quartos", "area_m2", "bairro", "modelo", "versao_modelo", "cidade", "preco_predito", "score_parque", stamped.alias("carimbado")
    ).agg(F.count(F.lit(1)).alias("n"))


def _event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    stream = _event_stream(spark, sf)
    folder = shared_folder(spark, "stream-dedup")
    land_once(stream, ["user_id", "event_type"], f"{folder}/table", f"{folder}/state")
    return spark.read.parquet(f"{folder}/table").select("user_id", "event_type")


_WAVES = ((1, 2), (0, 3), (4,))  # page 0 comes late


@query(
    """
    WITH l AS (SELECT 'R$ ' || o_orderkey AS preco, 'Rua ' || o_orderpriority AS rua, 'u' || o_custkey AS link, o_totalprice AS area_m2,
        CAST(o_orderkey % 5 AS INT) AS pagina, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS lote, o_orderkey,
        strftime(o_orderdate, '%Y-%m-%d') || ' 08:00:00' AS data_coleta FROM orders)
    SELECT preco, rua, link, area_m2, data_coleta, CAST(lote AS INT) AS batch FROM l
    QUALIFY row_number() OVER (PARTITION BY link ORDER BY lote, pagina, o_orderkey) = 1
    """
)
def stream_landing(spark, sf):
    """Page files that arrive in three waves, one of them late: whole rows of the first arrival of every link."""
    k, folder = F.col("o_orderkey"), shared_folder(spark, "landing")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("R$ "), k.cast("string")).alias("preco"), F.concat(F.lit("Rua "), F.col("o_orderpriority")).alias("rua"),
        F.lit("x").alias("endereco"), F.lit(1.0).alias("quartos"), F.lit(1.0).alias("banheiros"), F.col("o_totalprice").alias("area_m2"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("link"), F.lit("c").alias("cidade"), F.lit("pr").alias("estado"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 08:00:00")).alias("data_coleta"), k,
    )
    for wave in _WAVES:
        for page in wave:
            mine = rows.where(k % 5 == page).orderBy(k).select(*RAW_LISTINGS.fieldNames())
            named = mine.write.mode("append").option("mapreduce.output.basename", f"c_pr_pagina{page}")
            named.option("header", True).option("escape", '"').csv(f"{folder}/pages")
        land_once(listing_stream(spark, f"{folder}/pages"), ["link"], f"{folder}/table", f"{folder}/state")
    landed = spark.read.parquet(f"{folder}/table")
    return landed.select("preco", "rua", "link", "area_m2", "data_coleta", "batch")


@query(
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS data_coleta, round_even(exp(least(value, 100) / 10), 2) AS preco_estimado, 'BRL' AS moeda FROM events
    """
)
def stream_score(spark, sf):
    folder = shared_folder(spark, "stream-score")

    def scorer(batch: DataFrame) -> DataFrame:
        return batch.select(
            "event_id",
            collected_text(F.col("ts")).alias("data_coleta"),
            F.bround(F.exp(F.least("value", F.lit(100)) / 10), 2).alias("preco_estimado"),
            F.lit("BRL").alias("moeda"),
        )

    score_stream(_event_stream(spark, sf), scorer, f"{folder}/table", f"{folder}/state")
    return spark.read.parquet(f"{folder}/table").drop("lote")
