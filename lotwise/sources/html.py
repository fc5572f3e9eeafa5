"""Listing rows out of a table of pages (page_id, url, html) with string and array functions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.functions.binding import let
from lotwise.functions.text import first_match, strip
from lotwise.session import cut_lineage

# Markers of the listing markup.
LISTING_HREF = "/imovel/"
CARD_TEST_ID = "property-card"
CARD_CLASS = "card"
STREET_MARK = "rp-cardProperty-street-txt"
DEFAULT_PAGE_COUNT = 10

# Patterns of listing titles and texts.
TITLE_WAY = r"(?Uiu)em\s+(Rua|Avenida|Av\.|R\.)\s+([^,]+)"
TITLE_PLACE = r"(?U)em\s+(.+?)(?:,\s*[A-Z]|$)"
TITLE_ROOMS = r"(?Uiu)(\d+)\s+quarto"
TITLE_BATHS = r"(?Uiu)(\d+)\s+banheiro"
TITLE_AREA = r"(?U)(\d+)\s*m²"
TEXT_PRICE = r"(?U)R\$\s*([\d.]+(?:,\d{2})?)"
SPAN_COUNT = r"\d+"
SPAN_AREA = r"\d+[.,]?\d*"

_BREAK, _PAIR, _IS = "\u0001", "\u0002", "\u0003"
# Named characters of HTML 5 that end in a semicolon; those in common use stand first, as a lookup goes through them in turn.
_COMMON = ["amp", "nbsp", "lt", "gt", "quot", "apos", "sup2", *sorted(name2codepoint)]
_ENTITIES = {n: html5[f"{n};"] for n in dict.fromkeys([*_COMMON, *(k[:-1] for k in sorted(html5) if k.endswith(";"))])}


def decode_entities(text: Column) -> Column:
    """&amp;, &sup2;, &#178;, &#xB2; ... to characters; unknown names stay as they are."""
    # one text literal, which is folded into one map; a literal for every name costs more than the decoding
    listed = _PAIR.join(f"{n}{_IS}{c}" for n, c in _ENTITIES.items())
    names = F.str_to_map(F.lit(listed), F.lit(_PAIR), F.lit(_IS))

    def from_code(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code.cast("int")), 8, "0")), "UTF-32")

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&([A-Za-z]+[0-9]*);", 1)
        dec = F.regexp_extract(piece, r"^&#([0-9]{1,7});", 1)
        hexa = F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]{1,6});", 1)
        rest = F.regexp_replace(piece, r"^&#?[A-Za-z0-9]+;", "")
        char = (
            F.when(name != "", F.try_element_at(names, name))
            .when(dec != "", from_code(dec))
            .when(hexa != "", from_code(F.conv(hexa, 16, 10)))
        )
        return F.when(char.isNotNull(), F.concat(char, rest)).otherwise(piece)

    def decoded(t: Column) -> Column:
        pieces = F.split(t, r"(?=&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+[0-9]*);)")
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(t)

    return let(text, decoded)


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def texts(inner: Column) -> Column:
    """Trimmed, non-empty text pieces between the tags."""
    marked = decode_entities(F.regexp_replace(inner, r"(?s)<[^>]*>", _BREAK))
    return F.filter(F.transform(F.split(marked, _BREAK), strip), lambda t: t != "")


def joined_text(inner: Column) -> Column:
    return F.array_join(texts(inner), "")


def attribute(open_tag: Column, name: str) -> Column:
    quoted = first_match(open_tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"')
    return decode_entities(F.coalesce(quoted, first_match(open_tag, rf"(?is)\s{name}\s*=\s*'([^']*)'")))


def _as_elements(found: Column, tag: str) -> Column:
    return F.transform(
        found,
        lambda e: F.struct(
            F.lit(tag).alias("tag"),
            F.regexp_extract(e, r"(?s)^(<[^>]*>)", 1).alias("open"),
            F.regexp_replace(e, rf"(?is)^<[^>]*>|</{tag}\s*>$", "").alias("inner"),
        ),
    )


def flat_elements(html: Column, tag: str) -> Column:
    """Elements that cannot contain themselves (a, p, h2)."""
    return _as_elements(F.regexp_extract_all(html, F.lit(rf"(?is)(<{tag}\b[^>]*>.*?</{tag}\s*>)"), F.lit(1)), tag)


def nested_elements(rows: DataFrame, key: str, html: str, tag: str, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, pos, tag, open, inner) of a table's elements, inner ones included, closed at their own end tags.

    `key` names each row, `wanted` judges open tags, `pos` numbers the wanted elements of a row in document order. The
    tags become events with a running depth (an end tag at depth zero counts for nothing); events of one level are open
    and close in turn, so the next one closes an element, or the text's end does. Texts are cut out by byte places, hence
    the work follows the length of the text and of what is cut out.
    """
    parts = F.split(html, rf"(?i)(?=<{tag}[\s>/])|(?=</{tag}\s*>)")
    events = rows.select(key, F.posexplode(parts).alias("_i", "_part")).select(
        key,
        "_i",
        F.when(F.col("_part").rlike(rf"(?i)^<{tag}[\s>/]"), 1).when(F.col("_part").rlike(rf"(?i)^</{tag}\s*>"), -1).otherwise(0).alias("_step"),
        F.regexp_extract("_part", r"(?s)^(<[^>]*>)", 1).alias("open"),
        F.octet_length("_part").alias("_size"),
    )
    order = Window.partitionBy(key).orderBy("_i")
    events = events.select(
        "*", F.sum("_step").over(order).alias("_sum"), (F.sum("_size").over(order) - F.col("_size")).alias("_start")
    )
    events = events.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order)))
    events = events.withColumn("_above", F.lag("_depth", 1, 0).over(order)).where("_step = 1 OR (_step = -1 AND _above > 0)")
    level = F.greatest("_depth", "_above").alias("_level")  # of an open its own depth, of a close the one it leaves
    same = Window.partitionBy(key, "_level").orderBy("_i")
    found = events.select("*", level).withColumn("_stop", F.lead("_start").over(same)).where("_step = 1")
    if wanted is not None:
        found = found.where(wanted(F.col("open")))
    found = found.select(
        key, "_i", "open", (F.col("_start") + F.octet_length("open")).alias("_from"), "_stop",
        (F.row_number().over(order) - 1).alias("pos"),
    )
    text = F.col("_text").cast("binary")
    size = F.coalesce("_stop", F.octet_length(text)) - F.col("_from")
    inner = F.substr(text, (F.col("_from") + 1).cast("int"), size.cast("int")).cast("string")
    cut = found.join(rows.select(key, F.col(html).alias("_text")), key)
    return cut.select(key, "pos", F.lit(tag).alias("tag"), "open", inner.alias("inner"))


def cards(pages: DataFrame) -> DataFrame:
    """One row per card (page columns, tier, pos, tag, open, inner); first tier with cards wins.

    Pages without a card of the first two tiers that may hold one of the others are written once, under a number each.
    """
    kept = [c for c in pages.columns if c != "html"]
    links = pages.select(*kept, without_scripts(F.col("html")).alias("_html")).withColumn(
        "_links", flat_elements(F.col("_html"), "a")
    )
    listing = F.filter("_links", lambda e: F.contains(attribute(e["open"], "href"), F.lit(LISTING_HREF)))
    marked = F.filter(
        "_links", lambda e: F.contains(F.lower(attribute(e["open"], "data-testid")), F.lit(CARD_TEST_ID))
    )

    def tier(n: int, found: Column) -> Column:
        return let(found, lambda c: F.when(F.size(c) > 0, F.struct(F.lit(n).alias("tier"), c.alias("cards"))))

    linked = links.select(*kept, "_html", F.coalesce(tier(1, listing), tier(2, marked)).alias("_t"))
    flat = linked.where(F.col("_t").isNotNull()).select(
        *kept, F.col("_t.tier").alias("tier"), F.posexplode("_t.cards").alias("pos", "_c")
    )
    has_box = F.col("_html").rlike(r"(?is)<div\b[^>]*class\s*=[^>]*card")
    has_article = F.col("_html").rlike(r"(?i)<article[\s>]")
    rest = linked.where(F.col("_t").isNull() & (has_box | has_article)).select(*kept, "_html")
    rest = cut_lineage(rest.withColumn("_page", F.monotonically_increasing_id()), "pages")
    in_class = lambda tag: F.contains(F.lower(attribute(tag, "class")), F.lit(CARD_CLASS))
    boxes = nested_elements(rest.where(has_box), "_page", "_html", "div", in_class).withColumn("tier", F.lit(3))
    boxed = boxes.select("_page").distinct()
    articles = nested_elements(rest.where(has_article).join(boxed, "_page", "left_anti"), "_page", "_html", "article")
    nested = boxes.unionByName(articles.withColumn("tier", F.lit(4))).join(rest.select("_page", *kept), "_page")
    columns = [*kept, "tier", "pos", "tag", "open", "inner"]
    return flat.select(*kept, "tier", "pos", "_c.*").unionByName(nested.select(*columns))


def _element_text(inner: Column, pattern: str) -> Column:
    """Text of the first element with the pattern; empty when it is empty, null when absent."""
    return F.when(inner.rlike(pattern), joined_text(F.regexp_extract(inner, pattern, 1)))


def _first_nonzero(title_value: Column, spans: Column, wanted, number: str) -> Column:
    """Value from the title, else the first non-zero one from a span; zero counts as missing."""
    found = F.filter(
        F.transform(
            F.filter(spans, wanted),
            lambda t: F.replace(first_match(t, number, 0), F.lit(","), F.lit(".")).try_cast("double"),
        ),
        lambda v: v.isNotNull(),
    )

    def pick(values: Column) -> Column:
        other = F.try_element_at(F.filter(values, lambda v: v != 0), F.lit(1))
        zero = F.coalesce(title_value, F.when(F.size(values) > 0, F.lit(0.0)))
        return F.coalesce(F.nullif(title_value, F.lit(0.0)), other, zero)

    return let(found, pick)


def listings_from_cards(
    found: DataFrame, host: str, city: Column | str, state: Column | str, collected: Column | None = None
) -> DataFrame:
    """Raw listing rows of the cards that show a price or an address; the cards are written once, under a number each."""
    inner = F.col("inner")
    found = cut_lineage(found.withColumn("_card", F.monotonically_increasing_id()), "cards")
    with_spans = found.where(inner.rlike(r"(?i)<span[\s>/]"))
    spans = nested_elements(with_spans, "_card", "inner", "span").select("_card", F.struct("pos", joined_text(inner).alias("text")).alias("_s"))
    spans = spans.groupBy("_card").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    rows = found.join(spans, "_card", "left").withColumns(
        {
            "_title": attribute(F.col("open"), "title"),
            "_href": F.when(F.col("tag") == "a", attribute(F.col("open"), "href")),
            "_text": F.array_join(texts(inner), " "),
            "_spans": F.coalesce(F.transform("_s", lambda e: e["text"]), F.array().cast("array<string>")),
        }
    )
    title, href, spans = F.col("_title"), F.col("_href"), F.col("_spans")
    street_title = strip(F.concat_ws(" ", first_match(title, TITLE_WAY, 1), first_match(title, TITLE_WAY, 2)))
    street = F.coalesce(
        _element_text(inner, rf"(?is)<p\b[^>]*data-cy\s*=\s*[\"']{STREET_MARK}[\"'][^>]*>(.*?)</p\s*>"),
        F.nullif(street_title, F.lit("")),
    )
    address = F.coalesce(
        _element_text(inner, r"(?is)<h2\b[^>]*>(.*?)</h2\s*>"),
        strip(first_match(title, TITLE_PLACE)),
    )
    price = first_match(F.col("_text"), TEXT_PRICE)

    def from_title(pattern: str) -> Column:
        return first_match(title, pattern).try_cast("double")

    rows = rows.withColumns(
        {
            "preco": F.concat(F.lit("R$ "), price),
            "rua": street,
            "endereco": address,
            "quartos": _first_nonzero(
                from_title(TITLE_ROOMS), spans, lambda t: F.contains(F.lower(t), F.lit("quarto")), SPAN_COUNT
            ),
            "banheiros": _first_nonzero(
                from_title(TITLE_BATHS), spans, lambda t: F.contains(F.lower(t), F.lit("banheiro")), SPAN_COUNT
            ),
            "area_m2": _first_nonzero(
                from_title(TITLE_AREA),
                spans,
                lambda t: F.contains(t, F.lit("m²")) | F.contains(F.lower(t), F.lit("m2")),
                SPAN_AREA,
            ),
            "link": F.when(F.startswith(href, F.lit("http")), href)
            .when(F.startswith(href, F.lit("/")), F.concat(F.lit(host), href))
            .otherwise(href),
            "cidade": F.lit(city) if isinstance(city, str) else city,
            "estado": F.lit(state) if isinstance(state, str) else state,
            "data_coleta": F.date_format(
                collected if collected is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"
            ),
        }
    )
    rows = rows.where(F.col("preco").isNotNull() | (F.coalesce("endereco", F.lit("")) != ""))
    return rows.drop("_title", "_href", "_text", "_spans", "_s", "_card", "tag", "open", "inner")


def extract_listings(pages: DataFrame, host: str, city, state, collected: Column | None = None) -> DataFrame:
    return listings_from_cards(cards(pages), host, city, state, collected)


def page_count(html: Column, default: int = DEFAULT_PAGE_COUNT) -> Column:
    """Total pages: 'de N página' in the text, else the largest button label, else the default."""
    clean = without_scripts(html)
    marked = decode_entities(F.regexp_replace(clean, r"(?s)<[^>]*>", _BREAK))
    stated = first_match(marked, r"(?Uiu)de\s+(\d+)\s+página").try_cast("int")
    labels = F.transform(
        F.regexp_extract_all(clean, F.lit(r"(?is)(<button\b[^>]*>)"), F.lit(1)),
        lambda tag: first_match(attribute(tag, "aria-label"), r"(?Uiu)página\s+(\d+)").try_cast("int"),
    )
    return F.coalesce(stated, F.array_max(labels), F.lit(default))


def useful_pages(found: DataFrame, city: list[str], page: str, n: str = "n") -> DataFrame:
    """Non-empty pages before the first two consecutive empty (or absent) ones, per city.

    A page ends the useful range when neither of the next two pages has rows; the range is cut
    at the earliest such page. Page 0 stands for the start.
    """
    filled = found.where(F.col(n) > 0).select(*city, F.col(page).alias("_p")).distinct()
    start = found.select(*city).distinct().withColumn("_p", F.lit(0).cast(found.schema[page].dataType))
    last = filled.unionByName(start)
    for ahead in (1, 2):
        nearer = filled.withColumn("_p", F.col("_p") - ahead)
        last = last.join(nearer, [*city, "_p"], "left_anti")
    cut = last.groupBy(*city).agg(F.min("_p").alias("last_page"))
    return found.where(F.col(n) > 0).join(cut, city).where(F.col(page) <= F.col("last_page"))


def street_coverage(found: DataFrame) -> DataFrame:
    """Share of cards with the street element, with the two counts."""
    has = F.col("inner").rlike(rf"(?is)<p\b[^>]*data-cy\s*=\s*[\"']{STREET_MARK}[\"']")
    return found.agg(
        F.count_if(has).alias("with_street"),
        F.count(F.lit(1)).alias("cards"),
        F.try_divide(F.count_if(has).cast("double"), F.count(F.lit(1))).alias("share"),
    )
