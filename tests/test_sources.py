import gzip
import json
import random
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from lotwise.sources import files, html, poi, predictions, runs
from lotwise.schemas import RAW_LISTINGS

HEAD = ",".join(RAW_LISTINGS.fieldNames())


def line(link, price="R$ 100.000", address='"Casa para comprar, 1 vaga emCentro, X"', when="2026-02-09 08:00:00"):
    return f"{price},Rua A,{address},2.0,1.0,50.0,{link},c,pr,{when}"


@pytest.fixture()
def page_folder():
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    pages = {
        "c_pr_pagina1.csv": [line("u1"), line("u2", address='"Casa ""boa"" emCentro, X"')],
        "c_pr_pagina10.csv": [line("u3", "R$ 10"), line("u1", "R$ 9")],
        "c_pr_pagina2.csv": [line("u3", "R$ 2"), line("u4")],
        "d_sp_pagina1.csv": [line("u9")],
        "notes.csv": ["x"],
    }
    for name, rows in pages.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write("\n".join([HEAD, *rows]) + "\n")
    with open(os.path.join(folder, "c_pr_pagina3.csv"), "w") as f:
        f.write("other,header\n1,2\n")
    with open(os.path.join(folder, "script_pagina.py"), "w") as f:
        f.write("pass\n")
    return folder


def test_page_files(spark, page_folder):
    rows = files.read_pages(spark, page_folder, "c", "pr")
    assert sorted(r["link"] for r in rows.collect()) == ["u1", "u1", "u2", "u3", "u3", "u4"]
    assert {r["pagina"] for r in rows.collect()} == {1, 2, 10}
    first = {r["link"]: r["preco"] for r in files.read_listings(spark, page_folder).collect()}
    assert first["u3"] == "R$ 10" and first["u1"] == "R$ 100.000" and set(first) == {"u1", "u2", "u3", "u4", "u9"}
    quoted = rows.where("link = 'u2'").first()["endereco"]
    assert quoted == 'Casa "boa" emCentro, X'
    assert files.read_listings(spark, page_folder, "nowhere", "xx").columns == RAW_LISTINGS.fieldNames()
    assert files.read_listings(spark, page_folder, "nowhere", "xx").isEmpty()


def test_file_report_shows_skipped_files(spark, page_folder):
    got = {r["file_name"]: r["rows"] for r in files.file_report(spark, page_folder).collect()}
    assert got == {"c_pr_pagina1.csv": 2, "c_pr_pagina10.csv": 2, "c_pr_pagina2.csv": 2, "c_pr_pagina3.csv": 0, "d_sp_pagina1.csv": 1}


def test_sinks(spark, page_folder):
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = files.read_listings(spark, page_folder)
    path = files.write_united(rows, out, "c", "pr")
    assert path.endswith("imoveis_c_pr_completo")
    assert files.scan_csv(spark, path, RAW_LISTINGS).count() == 5
    with pytest.raises(ValueError):
        files.write_united(rows.limit(0), out)
    files.land(rows, f"{out}/landed")
    plan = spark.read.parquet(f"{out}/landed").where("estado = 'pr'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(estado" in plan


def test_quarantine(spark):
    """Whole, cut short, unreadable and empty files, a header alone, and rows that do not fit."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    good = "\n".join([HEAD, *(line(f"u{i}") for i in range(3000))]) + "\n"
    packed = gzip.compress(good.encode())
    contents = {
        "c_pr_pagina1.csv": good.encode(), "c_pr_pagina2.csv.gz": packed, "c_pr_pagina3.csv.gz": packed[: len(packed) // 2] + packed[-8:],
        "c_pr_pagina4.csv.gz": b"no gzip at all", "c_pr_pagina5.csv": b"", "c_pr_pagina6.csv": (HEAD + "\n").encode(),
        "c_pr_pagina7.csv": f"{HEAD}\n{line('a').replace('50.0', 'large')}\n{line('b')}\na,b\n".encode(), "other.csv": b"x",
    }
    for name, content in contents.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
    found = {(r["file_name"], r["reason"], r["row"]) for r in files.quarantine(spark, folder).collect()}
    assert {f[:2] for f in found if f[1] != "bad row"} == {
        ("c_pr_pagina3.csv.gz", "cut short"), ("c_pr_pagina4.csv.gz", "unreadable")}
    assert {f[2] for f in found if f[1] == "bad row" and f[0] == "c_pr_pagina7.csv"} == {line("a").replace("50.0", "large"), "a,b"}
    report = {r["file_name"]: (r["rows"], r["bad_rows"]) for r in files.file_report(spark, folder).collect()}
    assert report["c_pr_pagina7.csv"] == (3, 2) and report["c_pr_pagina1.csv"] == (3000, 0)


def test_poi_response(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    corners = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    doc = {"version": 0.6, "generator": "g", "osm3s": {}, "elements": [
        {"type": "node", "id": 10 + i, "lat": a, "lon": b} for i, (a, b) in enumerate(corners)] + [
        {"type": "way", "id": 1, "nodes": [10, 11, 12, 13, 10], "tags": {"shop": "supermarket", "name": "M"}},
        {"type": "way", "id": 1, "nodes": [10, 11, 12, 13, 10], "tags": {"shop": "supermarket", "name": "M"}},
        {"type": "node", "id": 20, "lat": 5.0, "lon": 6.0, "tags": {"amenity": "school", "name": "Escola Municipal"}},
        {"type": "node", "id": 21, "lat": 5.0, "lon": 7.0, "tags": {"amenity": "college"}},
        {"type": "node", "id": 22, "lat": 5.0, "lon": 7.0, "tags": {"amenity": "bar"}}]}
    for name, content in {"a.json": doc, "empty.json": {**doc, "elements": []}}.items():
        with open(f"{folder}/{name}", "w") as f:
            json.dump(content, f)
    table = {r["poi_id"]: r for r in poi.poi_table(poi.read_responses(spark, folder)).collect()}
    assert {k: (r["category"], r["lat"], r["lon"]) for k, r in table.items()} == {
        "way/1": ("mercado", 1.0, 1.0), "node/20": ("escola_publicas", 5.0, 6.0), "node/21": ("escolas_privadas", 5.0, 7.0)}


CARD = '<a href="/imovel/x-1" title="Casa para comprar com 80 m², 2 quartos, 1 banheiro em Rua das Flores, Centro"><h2>Casa &amp; jardim emCentro, X</h2><p data-cy="rp-cardProperty-street-txt"> Rua A </p><span>R$ 350.000</span></a>'
SPANS = '<a href="http://h/imovel/2"><span>3 quartos</span><span>0 banheiros</span><span>2 banheiros</span><span>70,5 m&sup2;</span> R$&nbsp;1.200,50</a>'


def extract(spark, *pages):
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return html.extract_listings(df, "https://host", "c", "pr").orderBy("page_id", "pos").collect()


def test_cards(spark):
    full, spans = extract(spark, f'<div class="card">{CARD}</div>{SPANS}<a href="/imovel/z">nada</a>')
    assert (full["preco"], full["rua"], full["endereco"], full["quartos"], full["banheiros"], full["area_m2"], full["link"]) == (
        "R$ 350.000", "Rua A", "Casa & jardim emCentro, X", 2.0, 1.0, 80.0, "https://host/imovel/x-1")
    assert (spans["preco"], spans["quartos"], spans["banheiros"], spans["area_m2"], spans["link"]) == (
        "R$ 1.200,50", 3.0, 2.0, 70.5, "http://h/imovel/2")


def test_title_fallbacks_and_zero(spark):
    one, two = extract(
        spark,
        "<a href='/imovel/1' title='Casa com 0 quartos em avenida Brasil, Sul'><span>4 quartos</span></a>",
        "<a href='imovel/2' data-testid='Property-Card-x' title='Casa 0 quartos em Sul'>R$ 5</a>",
    )
    assert (one["rua"], one["endereco"], one["quartos"]) == ("avenida Brasil", "avenida Brasil", 4.0)
    assert (two["tier"], two["rua"], two["endereco"], two["quartos"], two["link"]) == (2, None, "Sul", 0.0, "imovel/2")


def test_tiers_and_nesting(spark):
    rows = extract(
        spark, "",
        '<div class="CardBox"><div>R$ 10<div class="inner card">R$ 20</div></div></div><div class="x">R$ 5</div>',
        "<article><h2>Casa em X</h2><span>1 <span>quarto</span></span></article><article></article>",
    )
    assert [(r["page_id"], r["tier"], r["preco"], r["endereco"], r["quartos"]) for r in rows] == [
        (1, 3, "R$ 10", None, None), (1, 3, "R$ 20", None, None), (2, 4, None, "Casa em X", 1.0)]


def slow_elements(text, tag):
    """(open, inner) of every element, by a stack."""
    found, stack = [], []
    for m in re.finditer(rf"(?i)<{tag}(?=[\s>/])[^>]*>|</{tag}\s*>", text):
        if m[0][1] != "/":
            found.append([m[0], m.end(), len(text)])
            stack.append(found[-1])
        elif stack:
            stack.pop()[2] = m.start()
    return [(tag_text, text[a:b]) for tag_text, a, b in found]


def test_nested_elements_brute_force(spark):
    rng = random.Random(8)
    pieces = ["<div>", "<DIV class='á'>", "</div>", "</Div >", "<divx>", "é", "x", "<div/>", "<p>", "</p>", "\n"]
    pages = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(pages)), "k long, h string").repartition(5)
    got = {}
    for row in html.nested_elements(df, "k", "h", "div").collect():
        got.setdefault(row["k"], {})[row["pos"]] = (row["open"], row["inner"])
    for k, page in enumerate(pages):
        assert [got.get(k, {})[i] for i in range(len(got.get(k, {})))] == slow_elements(page or "", "div"), page


def test_many_nested_elements(spark):
    """20,000 boxes in one page, in blocks of three within each other."""
    page = "".join(f"<div class='card'>{i}<div><div class='a card'>é{i}</div></div></div>" for i in range(7000))
    found = html.cards(spark.createDataFrame([(1, page)], "page_id int, html string"))
    row = found.agg(F.count(F.lit(1)), F.max("pos"), F.sum(F.length("inner")), F.min("tier")).first()
    cards = [e for e in slow_elements(page, "div") if "card" in e[0]]
    assert tuple(row) == (14000, 13999, sum(len(e[1]) for e in cards), 3)


def test_named_characters(spark):
    cases = {"&amp;&nbsp;&Eacute;&hellip;&NotEqualTilde;&#178;&#xB2;&nope;&": "&\u00a0É…≂̸²²&nope;&", "a &lt b": "a &lt b", "&check;": "✓"}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", html.decode_entities(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in rows.collect()} == cases


def test_page_totals(spark):
    cases = ["Página 1 de 7 páginas", "<button aria-label='página 3'/></button><button aria-label='Página  12'>", "de <b>9</b> páginas", ""]
    rows = spark.createDataFrame([(c,) for c in cases], "h string").select(html.page_count(F.col("h")))
    assert [r[0] for r in rows.collect()] == [7, 12, 10, 10]


def test_useful_pages(spark):
    pages = [("a", p, 1) for p in (1, 2, 3, 5, 8)] + [("a", 4, 0), ("b", 1, 1), ("c", 3, 1)]
    df = spark.createDataFrame(pages, "city string, p int, n int")
    got = sorted((r["city"], r["p"]) for r in html.useful_pages(df, ["city"], "p").collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 1)]


def test_runs_and_registry(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    ids = [runs.log_run(spark, folder, "e", f"r{i}", {"a": i}, {"r2": 0.5}, {"r2": 0.1}, f"/m{i}") for i in range(2)]
    for i in ids:
        runs.register(spark, folder, "model", i, "/m")
    log = runs.read_runs(spark, folder)
    assert runs.latest_run(log, "e").first()["run_id"] == ids[1]
    row = log.where(F.col("run_id") == ids[0]).first()
    assert (row["params"], row["metrics"]) == ({"a": "0"}, {"r2": 0.5, "baseline_r2": 0.1})
    numbered = runs.versions(spark.read.parquet(f"{folder}/registry")).collect()
    assert {r["run_id"]: r["version"] for r in numbered} == {ids[0]: 1, ids[1]: 2}
    with pytest.raises(LookupError):
        runs.load_model(spark, folder, "other")


def test_predictions_append(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    scored = spark.createDataFrame([("C", 2, 10.5)], "cidade string, quartos int, preco_estimado double")
    for _ in range(2):
        predictions.append_predictions(predictions.prediction_rows(scored, "m", "1"), folder)
    lacking = scored.withColumn("cidade", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="no city"):
        predictions.append_predictions(predictions.prediction_rows(lacking, "m", "1"), folder)
    rows = predictions.read_predictions(spark, folder).collect()
    assert len(rows) == 2 and len({r["id"] for r in rows}) == 2
    assert all(r["cidade"] == "C" and r["preco_predito"] == 10.5 and r["modelo"] == "m" for r in rows)
