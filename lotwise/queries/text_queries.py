"""Parsing, classes, bands, filters and column work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotwise.functions import numeric, rules, text
from lotwise.operators.dedup import keep_first, union_all
from lotwise.operators.filters import (
    finite,
    geocode_failed,
    has_coordinates,
    minimum_address,
    ordered_features,
    reachable,
    substring_share,
    with_violations,
    without_last,
)
from lotwise.operators.profile import columns_like, numeric_columns, value_counts
from lotwise.queries.base import query, r, table


@query(
    """
    SELECT user_id, event_type, event_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS primeiro FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
    WHERE rn = 1
    """
)
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    first = keep_first(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("user_id", "event_type", "event_id", "value", text.collected_text(F.col("ts")).alias("primeiro"))


@query(
    """
    SELECT nation, segment, count(*) AS quantidade FROM (
      SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer
      UNION ALL SELECT s_nationkey, NULL FROM supplier)
    GROUP BY ALL
    """
)
def union_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return union_all([c, s]).groupBy("nation", "segment").agg(F.count(F.lit(1)).alias("quantidade"))


@query(
    """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS preco,
           o_orderkey % 50 = 0 AS rejeitado,
           'R$ ' || format('{:,.2f}', o_totalprice) AS rotulo
    FROM orders
    """
)
def money_parse(spark, sf):
    o = table(spark, sf, "orders")
    written = F.concat(F.lit("R$ "), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    given = F.when(F.col("o_orderkey") % 50 == 0, F.lit("Sob consulta")).otherwise(written)
    return o.select(
        "o_orderkey",
        text.money(given).alias("preco"),
        text.money_rejected(given).alias("rejeitado"),
        text.money_label(F.col("o_totalprice")).alias("rotulo"),
    )


_KINDS = ["Casa", "Apartamento", "Lote/Terreno", "Sala/Conjunto", "Sobrado", "Fazenda"]


@query(
    """
    SELECT p_partkey,
           CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(p_size % 4 AS DOUBLE) END AS vagas_garagem,
           CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE 'Bairro ' || p_brand END AS bairro,
           CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE
             CASE p_partkey % 6 WHEN 0 THEN 'Casa' WHEN 1 THEN 'Apartamento' WHEN 2 THEN 'Lote/Terreno'
                  WHEN 3 THEN 'Sala/Conjunto' WHEN 4 THEN 'Sobrado' ELSE 'Fazenda' END END AS tipo_imovel
    FROM part
    """
)
def text_extract(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (key % 6 + 1).cast("int"))
    deal = F.when(key % 5 == 4, F.lit(" para alugar")).otherwise(F.lit(" para comprar"))
    parking = F.when(key % 4 == 3, F.lit("")).otherwise(
        F.concat(F.lit(", "), (F.col("p_size") % 4).cast("string"), F.lit(" vagas"))
    )
    prefix = F.when(key % 3 == 0, F.lit(" emImóvel Bairro ")).otherwise(F.lit(" em Bairro "))
    where = F.when(key % 10 == 9, F.lit("")).otherwise(F.concat(prefix, F.col("p_brand"), F.lit(", Cidade")))
    address = F.concat(kind, deal, F.lit(", "), F.col("p_size").cast("string"), F.lit(" m²"), parking, where)
    return p.select(
        "p_partkey",
        text.parking_spots(address).alias("vagas_garagem"),
        text.neighbourhood(address).alias("bairro"),
        text.property_type(address).alias("tipo_imovel"),
    )


@query(
    r"""
    SELECT doc_id, length(nullif(regexp_extract(text, 'em\s*([^,]+)', 1), '')) AS found_chars,
           try_cast(nullif(regexp_extract(text, '(\d+)', 1), '') AS BIGINT) AS first_number
    FROM documents
    """
)
def document_matches(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.length(text.first_match(F.col("text"), r"em\s*([^,]+)")).cast("long").alias("found_chars"),
        text.first_match(F.col("text"), r"(\d+)").try_cast("long").alias("first_number"),
    )


_CLASS_TEXTS = [
    "Lote ", "Terreno com casa ", "Cobertura ", "Casa duplex ", "Sobrado ", "Casa de Vila ",
    "Galpão/Depósito ", "Sala ", "Prédio/Edifício inteiro ", "Fazenda ",
]
_SCHOOL_TEXTS = ["Escola Municipal ", "Colégio Santa ", "IFPR ", "CMEI ", "Escola "]


@query(
    """
    WITH t AS (SELECT lower(CASE WHEN p_partkey % 11 = 10 THEN NULL ELSE
               list_extract(['Lote ','Terreno com casa ','Cobertura ','Casa duplex ','Sobrado ','Casa de Vila ',
                 'Galpão/Depósito ','Sala ','Prédio/Edifício inteiro ','Fazenda '], CAST(p_partkey % 10 + 1 AS INT))
               || p_name END) AS x,
             lower(list_extract(['Escola Municipal ','Colégio Santa ','IFPR ','CMEI ','Escola '],
               CAST(p_partkey % 5 + 1 AS INT)) || p_type) AS s FROM part),
    k AS (SELECT CASE WHEN x IS NULL THEN 'outros'
             WHEN x LIKE '%terreno%' OR x LIKE '%lote%' THEN 'terreno'
             WHEN regexp_matches(x, 'apartamento|cobertura|duplex|flat|kitnet') THEN 'apartamento'
             WHEN regexp_matches(x, 'casa|sobrado|vila') THEN 'casa'
             WHEN regexp_matches(x, 'comercial|loja|box|galpão|deposito|depósito|sala|conjunto') THEN 'comercial'
             WHEN regexp_matches(x, 'prédio|edificio|edifício') THEN 'predio' ELSE 'outros' END AS tipo_imovel_cat,
           CASE WHEN regexp_matches(s, 'municipal|estadual|federal|cmei|emei|emef|eef|ifpr|ifsp|ifsc|ifrs')
             THEN 'publica' ELSE 'privada' END AS tipo_escola FROM t)
    SELECT tipo_imovel_cat, tipo_escola, count(*) AS n,
           round(count(*) * 1.0::double / sum(count(*)) OVER (), 8) + 0.0::double AS share FROM k GROUP BY ALL
    """
)
def classify_rules(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    kind = F.concat(F.element_at(F.array(*[F.lit(t) for t in _CLASS_TEXTS]), (key % 10 + 1).cast("int")), "p_name")
    school = F.concat(F.element_at(F.array(*[F.lit(t) for t in _SCHOOL_TEXTS]), (key % 5 + 1).cast("int")), "p_type")
    counts = p.groupBy(
        rules.classify(F.when(key % 11 != 10, kind)).alias("tipo_imovel_cat"),
        rules.school_class(school).alias("tipo_escola"),
    ).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", r(F.col("n") / total, 8))


@query(
    """
    WITH a AS (SELECT CAST(p_size * 10 - 20 AS DOUBLE) + CASE WHEN p_partkey % 3 = 0 THEN 0.01 ELSE 0 END AS area FROM part),
    k AS (SELECT CASE WHEN area <= 0 THEN NULL WHEN area <= 50 THEN 'Até 50' WHEN area <= 80 THEN '50–80'
           WHEN area <= 120 THEN '80–120' WHEN area <= 200 THEN '120–200' WHEN area <= 400 THEN '200–400' ELSE '400+' END AS faixa,
         CASE WHEN area <= 50 THEN 'Até 50' WHEN area <= 80 THEN '50–80'
           WHEN area <= 120 THEN '80–120' WHEN area <= 200 THEN '120–200' WHEN area <= 400 THEN '200–400' ELSE '400+' END AS faixa_score
         FROM a)
    SELECT faixa, faixa_score, count(*) AS n,
      CASE faixa WHEN 'Até 50' THEN 0 WHEN '50–80' THEN 1 WHEN '80–120' THEN 2 WHEN '120–200' THEN 3
                 WHEN '200–400' THEN 4 WHEN '400+' THEN 5 END AS ordem FROM k GROUP BY ALL
    """
)
def band_right_closed(spark, sf):
    p = table(spark, sf, "part")
    area = (F.col("p_size") * 10 - 20).cast("double") + F.when(F.col("p_partkey") % 3 == 0, F.lit(0.01)).otherwise(F.lit(0.0))
    bands = p.select(rules.area_band(area).alias("faixa"), rules.scoring_band(area).alias("faixa_score"))
    counts = bands.groupBy("faixa", "faixa_score").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ordem", rules.band_order(F.col("faixa"))).orderBy("ordem")


@query(
    """
    SELECT p_brand, count(*) AS n, round(count(*) * 1.0::double / sum(count(*)) OVER (), 8) + 0.0::double AS share
    FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 25
    """
)
def value_share(spark, sf):
    return value_counts(table(spark, sf, "part"), "p_brand", top=25).withColumn("share", r("share", 8))


@query(
    """
    WITH q AS (SELECT CAST(l_quantity - 25 AS DOUBLE) AS quartos, CAST(l_linenumber * 4 - 6 AS DOUBLE) AS banheiros,
             CAST(l_linenumber AS DOUBLE) AS vagas_garagem,
             CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice / 10 - 200 END AS area_m2,
             CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_returnflag END AS bairro, l_discount - 0.02 AS s FROM lineitem)
    SELECT violations, count(*) AS n FROM (SELECT concat_ws(',',
        CASE WHEN area_m2 IS NULL THEN 'area_m2:missing' END, CASE WHEN bairro IS NULL THEN 'bairro:missing' END,
        CASE WHEN quartos < 0 THEN 'quartos:low' END, CASE WHEN quartos > 20 THEN 'quartos:high' END,
        CASE WHEN banheiros < 0 THEN 'banheiros:low' END, CASE WHEN banheiros > 20 THEN 'banheiros:high' END,
        CASE WHEN area_m2 <= 0 THEN 'area_m2:low' END, CASE WHEN area_m2 > 10000 THEN 'area_m2:high' END,
        CASE WHEN s < 0 THEN 'score_parque:low' END) AS violations FROM q) GROUP BY violations
    """
)
def validate_ranges(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        (F.col("l_quantity") - 25).alias("quartos"),
        (F.col("l_linenumber") * 4 - 6).alias("banheiros"),
        F.col("l_linenumber").alias("vagas_garagem"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_extendedprice") / 10 - 200).alias("area_m2"),
        F.when(F.col("l_partkey") % 23 != 0, F.col("l_returnflag")).alias("bairro"),
        (F.col("l_discount") - 0.02).alias("score_parque"),
    )
    checked = with_violations(rows, not_negative=["score_parque"])
    return checked.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round_even(l_extendedprice / 1000, 0) AS BIGINT) AS milhares,
           CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS metade, CAST(l_linenumber AS DOUBLE) AS linha,
           CAST(NULL AS DOUBLE) AS ausente, l_returnflag
    FROM lineitem
    """
)
def project_cast(spark, sf):
    li = table(spark, sf, "lineitem").drop("l_shipdate")
    keys = [c for c in columns_like(li, "key")]
    money = [c for c in numeric_columns(li) if c not in keys]
    slim = li.select(*keys, *money, "l_returnflag").withColumns(
        {
            "milhares": numeric.half_even_long(F.col("l_extendedprice") / 1000),
            "metade": numeric.half_even_long(F.col("l_quantity") / 2),
        }
    )
    features = F.struct(*ordered_features(slim, ["l_linenumber", "ausente"], ["l_returnflag"]).columns)
    wide = slim.withColumn("ausente", F.lit(None).cast("double")).withColumn("f", features)
    return wide.select(
        *keys, "l_linenumber", "milhares", "metade",
        F.col("f.l_linenumber").cast("double").alias("linha"), "f.ausente", "f.l_returnflag",
    )


@query(
    """
    SELECT l_orderkey, l_partkey, l_linenumber,
           round(l_extendedprice / nullif(l_quantity - 25, 0), 6) + 0.0::double AS preco_m2,
           round(l_linenumber / nullif(CAST(l_quantity % 4 AS DOUBLE), 0), 6) + 0.0::double AS banheiro_por_quarto FROM lineitem
    """
)
def ratios(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        r(numeric.price_per_area(F.col("l_extendedprice"), F.col("l_quantity") - 25), 6).alias("preco_m2"),
        r(numeric.bath_per_room(F.col("l_linenumber"), F.col("l_quantity") % 4), 6).alias("banheiro_por_quarto"),
    )


@query(
    """
    WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '  ' || c_name || ' ' END AS rua,
                      CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE n_name || '  ' END AS bairro
               FROM customer JOIN nation ON c_nationkey = n_nationkey),
    k AS (SELECT *, trim(rua) || ', ' || trim(bairro) || ', Cidade, PR, Brasil' AS cheia,
                 trim(rua) || ', Cidade, PR, Brasil' AS curta FROM a)
    SELECT c_custkey, cheia, curta,
           CASE WHEN cheia IS NULL THEN bairro || ', Cidade, PR, Brasil' ELSE cheia END AS chave,
           upper(trim(bairro)) AS maiusculas, 'Nation' || substring(trim(bairro), 7) || ' Sul' AS titulo, lower(trim(rua)) AS minusculas,
           replace(replace(rua, 'Customer', 'Rua'), '#', ' ') AS trocada,
           rua IS NOT NULL AND bairro IS NOT NULL AS minimo FROM k
    """
)
def address_keys(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    key = F.col("c_custkey")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey",
        F.when(key % 7 != 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("rua"),
        F.when(key % 5 != 0, F.concat("n_name", F.lit("  "))).alias("bairro"),
    )
    suffix = ("Cidade", "PR", "Brasil")
    full = text.geocode_key(F.col("rua"), F.col("bairro"), *suffix)
    return rows.select(
        "c_custkey",
        full.alias("cheia"),
        text.short_key(F.col("rua"), *suffix).alias("curta"),
        F.when(full.isNull(), text.short_key(F.col("bairro"), *suffix, trimmed=False)).otherwise(full).alias("chave"),
        F.upper(text.strip(F.col("bairro"))).alias("maiusculas"),
        text.title(F.concat(text.strip(F.col("bairro")), F.lit(" sUL"))).alias("titulo"),
        F.lower(text.strip(F.col("rua"))).alias("minusculas"),
        F.replace(F.replace("rua", F.lit("Customer"), F.lit("Rua")), F.lit("#"), F.lit(" ")).alias("trocada"),
        minimum_address().alias("minimo"),
    )


@query(
    """
    WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 0.0
               ELSE o_totalprice END AS preco FROM orders)
    SELECT o_orderkey, round(ln(CASE WHEN preco < 1 THEN 1 ELSE preco END), 8) + 0.0::double AS log_preco,
           round(ln(1 + preco), 8) + 0.0::double AS log1p_preco,
           round_even(exp(round(ln(CASE WHEN preco < 1 THEN 1 ELSE preco END), 8)), 2) AS volta FROM p
    """
)
def log_targets(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    price = F.when(key % 9 == 0, F.lit(None).cast("double")).when(key % 10 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    rows = o.select("o_orderkey", price.alias("preco"))
    log = F.round(numeric.log_target(F.col("preco")), 8)
    return rows.select(
        "o_orderkey",
        (log + F.lit(0.0)).alias("log_preco"),
        r(F.log1p("preco"), 8).alias("log1p_preco"),
        numeric.price_from_log(log).alias("volta"),
    )


@query(
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS data_coleta,
           strftime(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S'), '%Y%m%d %H') AS hora FROM events
    """
)
def timestamp_text(spark, sf):
    e = table(spark, sf, "events")
    shown = text.collected_text(F.col("ts"))
    return e.select(
        "event_id",
        shown.alias("data_coleta"),
        F.date_format(text.collected_at(shown), "yyyyMMdd HH").alias("hora"),
    )


@query(
    """
    WITH s AS (SELECT l_orderkey, sum(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1),
    j AS (SELECT o_orderkey, o_totalprice, q, p, o_orderkey % 5 AS g FROM orders LEFT JOIN s ON o_orderkey = l_orderkey),
    f AS (SELECT *, CASE WHEN g = 0 THEN NULL ELSE q END AS lat, CASE WHEN g = 1 THEN NULL ELSE p END AS lon FROM j)
    SELECT count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS com_coordenadas,
           count(*) FILTER (lat IS NULL OR lon IS NULL) AS falhas,
           count(*) FILTER (q IS NULL) AS sem_itens,
           count(*) FILTER (greatest(lat * 1000, lon) < 100000) AS alcance,
           count(*) FILTER (g IN (1, 2)) AS tipos,
           count(*) - 1 AS sem_ultimo,
           max(o_orderkey) FILTER (o_orderkey < (SELECT max(o_orderkey) FROM f)) AS novo_ultimo,
           count(*) FILTER (o_totalprice > 1000 AND g <> 3 AND lat IS NOT NULL) AS finitos,
           round(avg(CASE WHEN CAST(o_orderkey AS VARCHAR) LIKE '%7%' THEN 1.0::double ELSE 0.0::double END), 8) AS com_sete
    FROM f
    """
)
def row_filters(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    sums = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))
    rows = o.join(sums, o.o_orderkey == sums.l_orderkey, "left").withColumn("g", F.col("o_orderkey") % 5)
    rows = rows.withColumns({"lat": F.when(F.col("g") != 0, F.col("q")), "lon": F.when(F.col("g") != 1, F.col("p"))})

    inf = F.when(F.col("g") == 3, F.lit(float("inf"))).when(F.col("o_totalprice") > 1000, F.col("o_totalprice"))
    rows = rows.withColumns(
        {"da": F.col("lat") * 1000, "db": F.col("lon"), "x": inf, "chave": F.col("o_orderkey").cast("string")}
    )
    out = rows.agg(
        F.count_if(has_coordinates()).alias("com_coordenadas"),
        F.count_if(geocode_failed()).alias("falhas"),
        F.count_if(F.col("q").isNull()).alias("sem_itens"),
        F.count_if(reachable(["da", "db"])).alias("alcance"),
        F.count_if(F.col("g").isin(1, 2)).alias("tipos"),
        F.count_if(finite(["x", "lat"])).alias("finitos"),
        F.round(substring_share("chave", "7"), 8).alias("com_sete"),
    )
    kept = without_last(o, ["o_orderkey"]).agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("m")).alias("s"))
    last = out.withColumn("s", kept.scalar())
    return last.withColumns({"sem_ultimo": F.col("s.n"), "novo_ultimo": F.col("s.m")}).drop("s")
