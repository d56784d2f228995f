"""Raw records of the registries to canonical notices, as projections; only tree walks and XML use a small Python helper."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, date_prefix, safe_double
from ..functions.text import notice_hash, slugify
from ..schema import NOTICE
from .trees import PANELS, XML_FIELDS, extract_xml, tree_values

#: Fixed values of the sources' vocabularies.
CRZ_ATTACHMENTS = "https://www.crz.gov.sk/data/att"
ITMS_STATUS = {"Ukoncene": "awarded", "Ukončené": "awarded", "Zrusene": "cancelled", "Zrušené": "cancelled", "Prebieha": "announced"}
TED_AWARD_TYPES = ("can-standard", "can-modif", "can-social", "can-desg", "can-tran")
TED_NOTICE_TYPES = ("cn-standard", "cn-social", "cn-desg")
TED_LANGUAGES = ("slk", "eng", "ces", "deu", "fra")
NKOD_TYPES = {"result": "contract_award", "planning": "contract_notice", "change": "contract_modification"}
XML_TYPES = {"CN": "contract_notice", "CAN": "contract_award", "PIN": "prior_information", "CORR": "other", "CM": "contract_modification"}

CRZ_RAW = (
    "id bigint, contract_identifier string, subject string, subject_description string, contracting_authority_name string, contracting_authority_cin_raw string, contracting_authority_cin bigint, supplier_name string, supplier_cin_raw string, supplier_cin bigint, signed_on string, effective_from string, published_at string, contract_price_amount string, contract_price_total_amount string, attachments array<struct<id:bigint,title:string,file_name:string,file_size:bigint>>"
)


def lookup(mapping: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in mapping.items() for x in p]), key), F.lit(default))


def organisation(name: Column, ico: Column, sources: list[str], slug: Column | None = None, **more: Column) -> Column:
    """A struct of the canonical organisation type."""
    own = {"ico": ico, "name": name, "name_slug": slug if slug is not None else slugify(name), "country_code": F.lit("SK"), "sources": F.array(*map(F.lit, sources)), **more}
    return F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NOTICE["procurer"].dataType])


def award(supplier: Column, value: Column, currency: Column, signed: Column | None = None) -> Column:
    own = {"supplier": supplier, "value": value, "currency": currency, "signing_date": signed if signed is not None else F.lit(None)}
    return F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NOTICE["awards"].dataType.elementType])


def canonical(raw: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Exactly the canonical columns; the slug of the title and the content hash are added."""
    filled = {"status": F.lit("unknown"), "currency": F.lit("EUR"), "cpv_codes_additional": F.array(), "attachments": F.array(), "awards": F.array(), **columns}
    out = raw.select(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NOTICE])
    out = out.withColumn("title_slug", F.coalesce("title_slug", slugify("title")))
    return out.withColumn("content_hash", notice_hash())


# contracts register


def plausible_date(c: Column, now_year: int) -> Column:
    d = date_prefix(c)
    return F.when(F.year(d).between(2000, now_year + 1), d)


def coerced_ico(prefix: str) -> Column:
    return F.coalesce(blank_to_null(F.col(f"{prefix}_cin_raw")), F.col(f"{prefix}_cin").cast("string"))


def crz_notices(raw: DataFrame, now_year: int) -> DataFrame:
    signed = F.coalesce(*[plausible_date(F.col(c), now_year) for c in ("signed_on", "published_at", "effective_from")])
    value = safe_double("contract_price_total_amount")
    supplier = award(organisation(F.col("supplier_name"), coerced_ico("supplier"), ["crz"]), value, F.lit("EUR"), signed)
    files = F.transform(F.filter(F.coalesce("attachments", F.array()), lambda a: F.coalesce(a["file_name"], F.lit("")) != ""), lambda a: F.struct(a["title"].alias("title"), F.concat(F.lit(CRZ_ATTACHMENTS + "/"), a["file_name"]).alias("url"), a["file_name"].alias("file_name"), a["file_size"].alias("file_size")))
    key = F.col("id").cast("string")
    return canonical(
        raw,
        {
            "source": F.lit("crz"), "source_id": key, "crz_contract_id": key, "notice_type": F.lit("contract_award"), "status": F.lit("awarded"),
            "title": F.coalesce(blank_to_null(F.col("subject")), blank_to_null(F.col("contract_identifier")), F.lit("Unnamed contract")), "description": F.col("subject_description"),
            "procurer": F.when(F.coalesce("contracting_authority_name", F.lit("")) != "", organisation(F.col("contracting_authority_name"), coerced_ico("contracting_authority"), ["crz"])),
            "awards": F.when(F.coalesce("supplier_name", F.lit("")) != "", F.array(supplier)).otherwise(F.array()), "attachments": files,
            "final_value": value, "estimated_value": safe_double("contract_price_amount"), "publication_date": signed,
        },
    )


# structural funds monitoring

SUPPLIER_REF = "struct<id:bigint,nazov:string,ico:string>"
ITMS_RAW = (
    f"id bigint, kod string, nazov string, predpokladanaHodnotaZakazky double, stav string, datumZverejneniaVoVestniku string, hlavnyPredmetHlavnySlovnik struct<id:bigint,kod:string>, obstaravatelSubjekt struct<id:bigint,nazov:string,ico:string,subjekt:struct<href:string,id:bigint>>, zadavatel struct<subjekt:struct<id:bigint,ico:string,dic:string>>, _subject struct<id:bigint,nazov:string,ico:string,dic:string>, _contracts array<struct<id:bigint,celkovaSumaZmluvy:double,hlavnyDodavatelDodavatelObstaravatel:{SUPPLIER_REF},_supplier:{SUPPLIER_REF},_suppliers:array<{SUPPLIER_REF}>>>"
)


def itms_enrich(listed: DataFrame, detail: DataFrame, contracts: DataFrame, suppliers: DataFrame, subjects: DataFrame) -> DataFrame:
    """The raw record from five landing tables by left joins: list (id), detail (id, ...), contracts (procurement_id, id,
    celkovaSumaZmluvy, supplier_ids), suppliers and subjects (id, nazov, ico). A missing lookup leaves the reference null."""
    flat = contracts.select("procurement_id", "id", "celkovaSumaZmluvy", F.posexplode_outer("supplier_ids").alias("pos", "supplier_id"))
    named = flat.join(suppliers.select(F.col("id").alias("supplier_id"), F.struct("id", "nazov", "ico").alias("s")), "supplier_id", "left")
    per = named.groupBy("procurement_id", "id", "celkovaSumaZmluvy").agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("pos", "s")))).alias("s"))
    # records have few contracts each
    nested = per.groupBy("procurement_id").agg(F.array_sort(F.collect_list(F.struct("id", "celkovaSumaZmluvy", F.lit(None).cast(SUPPLIER_REF).alias("hlavnyDodavatelDodavatelObstaravatel"), F.lit(None).cast(SUPPLIER_REF).alias("_supplier"), F.transform("s", lambda x: x["s"]).alias("_suppliers")))).alias("_contracts"))
    subject = subjects.select(F.col("id").alias("_sid"), F.struct("id", "nazov", "ico", F.lit(None).cast("string").alias("dic")).alias("_subject"))
    rows = listed.select("id").join(detail, "id", "left").join(nested, F.col("id") == F.col("procurement_id"), "left").drop("procurement_id")
    return rows.join(subject, F.col("obstaravatelSubjekt.subjekt.id") == F.col("_sid"), "left").drop("_sid")


def itms_notices(raw: DataFrame) -> DataFrame:
    contracts = F.coalesce("_contracts", F.array().cast(raw.schema["_contracts"].dataType))

    def one(s: Column, c: Column) -> Column:
        return award(organisation(F.coalesce(s["nazov"], F.lit("")), s["ico"], ["itms"]), c["celkovaSumaZmluvy"], F.lit("EUR"))

    def known(s: Column) -> Column:
        return (F.coalesce(s["ico"], F.lit("")) != "") | (F.coalesce(s["nazov"], F.lit("")) != "")

    def of(c: Column) -> Column:
        single = F.coalesce(c["_supplier"], c["hlavnyDodavatelDodavatelObstaravatel"])
        refs = F.when(F.size(c["_suppliers"]) > 0, c["_suppliers"]).otherwise(F.array(single))
        return F.transform(F.filter(refs, lambda s: F.coalesce(known(s), F.lit(False))), lambda s: one(s, c))

    subject, legacy = F.col("_subject"), F.col("obstaravatelSubjekt")
    name0, ico0 = F.coalesce(subject["nazov"], F.lit("")), F.coalesce(blank_to_null(subject["ico"]), blank_to_null(F.col("zadavatel.subjekt.ico")))
    bare = (name0 == "") & ico0.isNull()
    name, ico = F.when(bare, F.coalesce(legacy["nazov"], F.lit(""))).otherwise(name0), F.when(bare, blank_to_null(legacy["ico"])).otherwise(ico0)
    slug = F.when(name != "", slugify(name)).otherwise(F.concat(F.lit("itms-subject-"), F.coalesce(legacy["subjekt"]["id"].cast("string"), F.lit(""))))
    done = F.col("stav").isin("Ukoncene", "Ukončené") & (F.size(contracts) > 0)
    return canonical(
        raw,
        {
            "source": F.lit("itms"), "source_id": F.col("id").cast("string"), "notice_type": F.when(done, "contract_award").otherwise("contract_notice"), "status": lookup(ITMS_STATUS, F.col("stav"), "unknown"),
            "title": F.coalesce(blank_to_null(F.col("nazov")), F.lit("Unnamed procurement")), "cpv_code": F.col("hlavnyPredmetHlavnySlovnik.kod"), "estimated_value": F.col("predpokladanaHodnotaZakazky"),
            "procurer": F.when((name != "") | ico.isNotNull(), organisation(name, ico, ["itms"], slug)), "awards": F.flatten(F.transform(contracts, of)), "publication_date": date_prefix("datumZverejneniaVoVestniku"),
        },
    )


# European notices: polymorphic JSON as VARIANT


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _texts(v: Column) -> Column:
    """The texts of a variant: a string as one, a list's strings."""
    return F.when(_is(v, "STRING"), F.array(F.try_variant_get(v, "$", "string"))).when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<string>"))


def _languages(v: Column) -> Column:
    """The values of an object by language; null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _texts_by_language(v: Column, by: Column) -> Column:
    """The texts of the preferred language, of any language (`by`), or of a value without languages; empty ones left out."""
    real = lambda texts: F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != "")
    some = lambda texts: F.when(F.size(texts) > 0, texts)
    preferred = [some(real(_texts(F.try_element_at(by, F.lit(x))))) for x in TED_LANGUAGES]
    other = F.get(F.filter(F.transform(F.map_values(by), lambda x: real(_texts(x))), lambda t: F.size(t) > 0), 0)
    return F.coalesce(F.when(by.isNotNull(), F.coalesce(*preferred, other)), some(real(_texts(v))))


def pick_language(v: Column) -> Column:
    return F.get(_texts_by_language(v, _languages(v)), 0)


def first_text(v: Column) -> Column:
    return F.get(_texts(v), 0)


def first_number(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.when(~_is(v, "ARRAY"), F.try_variant_get(v, "$", "string"))).try_cast("double")


def ted_date(c: Column) -> Column:
    return F.coalesce(date_prefix(c), F.try_to_date(F.substring(c, 1, 8), "yyyyMMdd"))


def ted_filter(raw: DataFrame, since: str | None = None, until: str | None = None, awards_only: bool = False, country: str = "SVK") -> DataFrame:
    """The search's predicates: country, award types, dates. Rows (raw: variant)."""
    country_, kind, date = (F.try_variant_get("raw", f"$['{x}']", "variant") for x in ("buyer-country", "notice-type", "publication-date"))
    found = F.struct(F.coalesce(_texts(country_), F.array()).alias("countries"), first_text(kind).alias("kind"), ted_date(first_text(date)).alias("day"))
    # generated, so that the predicates are not pushed below the parsing, which they would then repeat for each use
    out = raw.withColumn("_found", F.explode(F.array(found))).where(F.array_contains("_found.countries", country))
    if awards_only:
        out = out.where(F.col("_found.kind").isin(*TED_AWARD_TYPES))
    out = out.where(F.col("_found.day") >= F.lit(since).cast("date")) if since else out
    out = out.where(F.col("_found.day") <= F.lit(until).cast("date")) if until else out
    return out.drop("_found")


def ted_notices(raw: DataFrame) -> DataFrame:
    """From rows (raw: variant)."""

    def f(name: str) -> Column:
        return F.col(f"_{name}")

    fields = ("publication-number", "publication-date", "notice-type", "notice-title", "buyer-name", "classification-cpv", "tender-value", "tender-value-cur", "winner-name", "winner-identifier", "organisation-name-tenderer", "organisation-identifier-tenderer", "result-value-lot", "result-value-cur-lot", "result-value-notice", "result-value-cur-notice", "ND_OJ")
    rows = raw.select(*[F.try_variant_get("raw", f"$['{x}']", "variant").alias("_" + x.replace("-", "_")) for x in fields])
    # every variant is opened once, in a projection of its own; what follows reads plain columns
    languages, lists, numbers = ("buyer_name", "notice_title", "winner_name", "organisation_name_tenderer"), ("winner_identifier", "organisation_identifier_tenderer"), ("result_value_notice", "tender_value")
    single = ("notice_type", "publication_date", "ND_OJ", "tender_value_cur", "result_value_cur_notice", "classification_cpv")
    rows = rows.withColumns({f"_by_{x}": _languages(f(x)) for x in languages})
    rows = rows.withColumns({f"_texts_{x}": _texts_by_language(f(x), f(f"by_{x}")) for x in languages} | {f"_texts_{x}": _texts(f(x)) for x in lists} | {f"_first_{x}": first_text(f(x)) for x in single} | {f"_number_{x}": first_number(f(x)) for x in numbers})
    kind = f("first_notice_type")
    published = F.coalesce(f("first_publication_date"), F.lit(""))
    key = F.coalesce(blank_to_null(f("first_ND_OJ")), F.concat(F.lit("ted-"), published, F.lit("-"), F.coalesce(F.try_variant_get(f("publication_number"), "$", "string"), F.lit(""))))
    names = F.coalesce(f("texts_winner_name"), f("texts_organisation_name_tenderer"), F.array().cast("array<string>"))
    ids = F.coalesce(f("texts_winner_identifier"), f("texts_organisation_identifier_tenderer"), F.array().cast("array<string>"))
    ico = F.get(F.filter(ids, lambda x: F.coalesce(x.rlike(r"^\d{8}$"), F.lit(False))), 0)
    lots, lot_currencies = (F.try_variant_get(f(x), "$", "array<string>") for x in ("result_value_lot", "result_value_cur_lot"))
    notice_value = F.coalesce(f("number_result_value_notice"), f("number_tender_value"))
    notice_currency = F.coalesce(f("first_result_value_cur_notice"), f("first_tender_value_cur"), F.lit("EUR"))

    def one(name: Column, i: Column) -> Column:
        lot, currency = F.get(lots, i), F.get(lot_currencies, i)
        return award(organisation(name, ico, ["ted"]), F.when(lot.isNotNull(), lot.try_cast("double")).otherwise(notice_value), F.coalesce(currency, notice_currency))

    buyer = F.get(f("texts_buyer_name"), 0)
    return canonical(
        rows,
        {
            "source": F.lit("ted"), "source_id": key, "ted_notice_id": key,
            "notice_type": F.when(kind.isin(*TED_AWARD_TYPES), "contract_award").when(kind.isin(*TED_NOTICE_TYPES), "contract_notice").otherwise("other"),
            "status": F.when(kind.isin(*TED_AWARD_TYPES), "awarded").when(kind.isin(*TED_NOTICE_TYPES), "announced").otherwise("unknown"),
            "title": F.coalesce(F.get(f("texts_notice_title"), 0), key), "final_value": f("number_tender_value"), "currency": F.coalesce(f("first_tender_value_cur"), F.lit("EUR")),
            "cpv_code": f("first_classification_cpv"), "procurer": F.when(buyer.isNotNull(), organisation(buyer, F.lit(None), ["ted"])), "awards": F.transform(names, one), "publication_date": ted_date(published),
        },
    )


# gazette: component trees

#: Codes of an item, and those of its panels by group.
ITEM_CODES = {"ted": "BT-04-notice", "kind": "BT-03-notice", "order": "DL-Metadata-Order", "partner": "DL-Metadata-Partner", "cpv": "BT-262-Lot", "final": "BT-720-Tender_value", "est_lot": "BT-27-Lot", "est_proc": "BT-27-Procedure", "cur_tender": "BT-720-Tender-Currency", "cur_lot": "BT-27-Lot-Currency"}
PANEL_CODES = {
    "GR-Organisations": {"name": "BT-500-Organization-Company", "cin": "BT-501-Organization-Company-CIN", "street_a": "BT-510(a)-Organization-Company", "street_b": "BT-510(b)-Organization-Company", "city": "BT-513-Organization-Company", "postal_code": "BT-512-Organization-Company", "country": "BT-514-Organization-Company"},
    "GR-LotResult": {"state": "BT-142-LotResult", "tenders": "OPT-320-LotResult", "lot_value": "BT-710-LotResult_value", "lot_currency": "BT-710-LotResult_currency"},
    "GR-LotTender": {"value": "BT-720-Tender_value", "currency": "BT-720-Tender_currency", "party": "OPT-310-Tender", "party_label": "BT-3201-Tender"},
    "GR-TenderingParty": {"org": "OPT-300-Tenderer"},
}


def item_trees(items: DataFrame) -> DataFrame:
    """Items with `flat`, the first values of ITEM_CODES, and `panels`, for their `data`, a JSON text; one that is no tree has
    no values. A row stays a row, so what follows within an item needs no shuffle."""
    keys, panel_keys = list(ITEM_CODES.values()), frozenset(c for codes in PANEL_CODES.values() for c in codes.values())
    rest = [c for c in items.columns if c != "data"]
    panel = pa.struct([("grp", pa.string()), ("panel", pa.int32()), ("labels", pa.list_(pa.string())), ("vals", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, panels = [], []
            for data in batch.column("data").to_pylist():
                try:
                    tree = json.loads(data)
                except (TypeError, ValueError):
                    tree = None
                values, found = tree_values(tree if isinstance(tree, dict) else {}, keys, panel_keys)
                flat.append(values)
                panels.append(found)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(flat, pa.list_(pa.string())), pa.array(panels, pa.list_(panel))], [*rest, "flat", "panels"])

    kept = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in rest)
    return items.select(*rest, "data").mapInArrow(run, f"{kept}, flat array<string>, panels {PANELS}")


def panels_of(group: str) -> Column:
    """An item's panels of a group: (panel_id, panel, codes...) by id and place."""
    pattern = r"\(([A-Z]+-\d+)\)\s*$"

    def one(p: Column) -> Column:
        label = F.get(F.filter(F.transform(p["labels"], lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != ""), 0)
        return F.struct(label.alias("panel_id"), p["panel"].alias("panel"), *[F.try_element_at(p["vals"], F.lit(c)).alias(n) for n, c in PANEL_CODES[group].items()])

    return F.array_sort(F.transform(F.filter("panels", lambda p: p["grp"] == group), one))


def with_arrays(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with more columns, generated, so that what uses them several times does not repeat them."""
    return df.withColumn("_a", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select("*", "_a.*").drop("_a")


def parse_amount(c: Column) -> Column:
    return F.translate(c, "  ", "").try_cast("double")


def _latest(panels: str) -> Column:
    """The last panel of each id, of panels sorted by id and place."""
    later = lambda x, i: F.coalesce(F.get(panels, i + 1)["panel_id"] == x["panel_id"], F.lit(False))
    return F.filter(panels, lambda x, i: x["panel_id"].isNotNull() & ~later(x, i))


def _by_id(panels: Column) -> Column:
    return F.map_from_entries(F.transform(panels, lambda x: F.struct(x["panel_id"], x)))


def with_awards(trees: DataFrame) -> DataFrame:
    """Trees with `orgs`, the organisation panels with a name, the last of each id; and `awards`: selected lot results looked
    up in tenders, tendering parties and organisations; what has no match at some step is dropped."""
    rows = with_arrays(
        trees,
        _orgs=F.filter(panels_of("GR-Organisations"), lambda o: F.coalesce(o["name"], F.lit("")) != ""),
        _tenders=panels_of("GR-LotTender"),
        _parties=F.filter(panels_of("GR-TenderingParty"), lambda p: p["org"].isNotNull()),
        _results=F.filter(F.array_sort(F.transform(panels_of("GR-LotResult"), lambda r: F.struct(r["panel"], r["state"], r["tenders"], r["lot_value"]))), lambda r: (r["state"] == "selec-w") & (F.coalesce(r["tenders"], F.lit("")) != "")),
    )
    rows = with_arrays(rows, orgs=_latest("_orgs"), _tender=_by_id(_latest("_tenders")), _party=_by_id(_latest("_parties"))).drop("_orgs", "_tenders", "_parties")
    rows = with_arrays(rows, _org=_by_id(F.col("orgs")))

    def matches(r: Column) -> Column:
        ids = F.when(r["tenders"].startswith("["), F.regexp_extract_all(r["tenders"], F.lit(r"(TEN-\d+)"), F.lit(1))).otherwise(F.array(r["tenders"]))
        tenders = F.array_compact(F.transform(ids, lambda t: F.try_element_at("_tender", t)))
        return F.transform(tenders, lambda t: F.struct(t.alias("t"), r["lot_value"].alias("lot_value"), F.try_element_at("_org", F.try_element_at("_party", F.coalesce(blank_to_null(t["party"]), t["party_label"]))["org"]).alias("o")))

    found = F.filter(F.flatten(F.transform("_results", matches)), lambda m: m["o"].isNotNull())

    def one(m: Column) -> Column:
        o = m["o"]
        address = F.struct(blank_to_null(F.concat_ws(" ", o["street_a"], o["street_b"])).alias("street"), o["city"].alias("city"), o["postal_code"].alias("postal_code"), F.coalesce(o["country"], F.lit("SK")).alias("country_code"))
        return award(organisation(o["name"], eight_digits(o["cin"]), ["vestnik", "uvo"], address=address), F.coalesce(parse_amount(m["t"]["value"]), parse_amount(m["lot_value"])), F.coalesce(m["t"]["currency"], F.lit("EUR")))

    return with_arrays(rows, _found=found).withColumn("awards", F.transform("_found", one)).drop("_found", "_results", "_tender", "_party", "_org")


def eight_digits(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{8}$"), c)


def split_label(c: Column) -> Column:
    """The name before a closing ``(ID: n)``."""
    return blank_to_null(F.trim(F.regexp_replace(c, r"\(ID:\s*[^)]+\)\s*$", "")))


def nkod_notices(items: DataFrame) -> DataFrame:
    """From rows (item, name, data, publish_date, year, number) of gazette items."""
    rows = with_awards(item_trees(items.select("item", "name", "publish_date", "year", "number", "data")))
    rows = rows.withColumns({n: F.get("flat", i) for i, n in enumerate(ITEM_CODES)}).withColumn("partner_name", split_label(F.col("partner")))
    named = lambda o: F.lower(F.trim(o["name"])) == F.lower(F.trim(F.col("partner_name")))
    first = F.array_min(F.transform(F.filter("orgs", named), lambda o: F.struct(o["panel"], o["name"], eight_digits(o["cin"]).alias("ico"))))
    rows = with_arrays(rows, _org=first)
    kind = lookup(NKOD_TYPES, F.col("kind"), "other")
    name = F.coalesce("_org.name", "partner_name")
    return canonical(
        rows,
        {
            "source": F.lit("vestnik"), "source_id": F.col("item"), "notice_type": kind, "status": F.when(kind == "contract_award", "awarded").when(kind == "contract_notice", "announced").otherwise("unknown"),
            "title": F.coalesce(split_label(F.col("order")), blank_to_null(F.col("name")), F.lit("Untitled notice")), "procurer": F.when(F.col("partner_name").isNotNull(), organisation(name, F.col("_org.ico"), ["vestnik", "uvo"])),
            "awards": F.col("awards"), "cpv_code": blank_to_null(F.col("cpv")), "final_value": parse_amount(F.col("final")), "estimated_value": parse_amount(F.coalesce(blank_to_null(F.col("est_lot")), F.col("est_proc"))),
            "currency": F.coalesce(blank_to_null(F.col("cur_tender")), blank_to_null(F.col("cur_lot")), F.lit("EUR")), "publication_date": date_prefix("publish_date"),
            "vestnik_number": F.concat_ws("/", F.when(F.col("year").isNotNull() & F.col("number").isNotNull(), F.col("number").cast("string")), F.when(F.col("year").isNotNull() & F.col("number").isNotNull(), F.col("year").cast("string"))), "ted_notice_id": blank_to_null(F.col("ted")),
        },
    ).withColumn("vestnik_number", blank_to_null(F.col("vestnik_number")))


# gazette: XML

def xml_fields(files: DataFrame) -> DataFrame:
    """Fields of rows (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) if c is not None and (r := extract_xml(p, c))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in XML_FIELDS.split(", ")])

    return files.select("path", "content").mapInPandas(run, XML_FIELDS)


def xml_notices(raw: DataFrame) -> DataFrame:
    kind = lookup(XML_TYPES, F.col("form_type"), "other")
    return canonical(
        raw,
        {
            "source": F.lit("vestnik"), "source_id": F.col("notice_id"), "notice_type": kind, "status": F.when(kind == "contract_award", "awarded").when(kind == "contract_notice", "announced").otherwise("unknown"),
            "title": F.coalesce(blank_to_null(F.col("title")), blank_to_null(F.col("notice_id")), F.lit("Untitled notice")), "procurer": F.when(F.coalesce("procurer_name", F.lit("")) != "", organisation(F.col("procurer_name"), F.col("procurer_ico"), ["vestnik"])),
            "cpv_code": F.col("cpv_code"), "final_value": safe_double("total_value"), "estimated_value": safe_double("estimated_value"), "currency": F.col("currency"), "publication_date": date_prefix("publication_date"),
        },
    )


# flat tables from canonical notices


def flat_notices(notices: DataFrame) -> DataFrame:
    """Canonical notices as the flat rows that the operators take."""
    key = F.concat_ws("|", "source", "source_id")
    return notices.select(key.alias("notice_id"), F.col("procurer.ico").alias("procurer_ico"), F.col("procurer.name").alias("procurer_name"), *[c for c in notices.columns if c not in ("procurer", "awards", "attachments")])


def award_fact(notices: DataFrame) -> DataFrame:
    """One row an award."""
    key = F.concat_ws("|", "source", "source_id")
    return notices.select(key.alias("notice_id"), F.posexplode("awards").alias("pos", "a")).select("notice_id", "pos", F.col("a.supplier.ico").alias("supplier_ico"), F.col("a.supplier.name").alias("supplier_name"), F.col("a.value").alias("award_value"), F.col("a.signing_date").alias("signing_date"))
