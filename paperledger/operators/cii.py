"""E-invoice XML (cross-industry invoice) to candidate envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, clean
from ..plans.schemas import INVOICE

#: The elements read. Attributes get an underscore; all values stay text. Elements that may repeat by
#: mistake are arrays, and a repeated one reads as null.
_T = "array<struct<_VALUE:string,_schemeID:string,_unitCode:string>>"
_DATE = f"struct<DateTimeString:{_T}>"
_PARTY = (
    f"struct<ID:{_T},Name:{_T},SpecifiedTaxRegistration:array<struct<ID:{_T}>>,"
    f"PostalTradeAddress:struct<PostcodeCode:{_T},LineOne:{_T},CityName:{_T},CountryID:{_T}>>"
)
_PRICE = f"struct<ChargeAmount:{_T}>"
_ITEM = (
    f"struct<AssociatedDocumentLineDocument:struct<LineID:{_T},IncludedNote:struct<Content:{_T}>>,SpecifiedTradeProduct:struct<Name:{_T}>,"
    f"SpecifiedLineTradeAgreement:struct<GrossPriceProductTradePrice:{_PRICE},NetPriceProductTradePrice:{_PRICE}>,"
    f"SpecifiedLineTradeDelivery:struct<BilledQuantity:{_T}>,"
    f"SpecifiedLineTradeSettlement:struct<ApplicableTradeTax:array<struct<RateApplicablePercent:{_T}>>,SpecifiedTradeSettlementLineMonetarySummation:struct<LineTotalAmount:{_T}>>>"
)
SCHEMA = (
    f"ExchangedDocument struct<ID:{_T},IssueDateTime:{_DATE}>, "
    f"SupplyChainTradeTransaction struct<IncludedSupplyChainTradeLineItem:array<{_ITEM}>,"
    f"ApplicableHeaderTradeAgreement:struct<SellerTradeParty:{_PARTY},BuyerTradeParty:{_PARTY}>,"
    f"ApplicableHeaderTradeSettlement:struct<InvoiceCurrencyCode:{_T},"
    f"SpecifiedTradeSettlementPaymentMeans:array<struct<PayeePartyCreditorFinancialAccount:array<struct<IBANID:{_T}>>>>,"
    f"ApplicableTradeTax:array<struct<CalculatedAmount:{_T},BasisAmount:{_T},RateApplicablePercent:{_T}>>,"
    f"SpecifiedTradePaymentTerms:struct<Description:{_T},DueDateDateTime:{_DATE}>,"
    f"SpecifiedTradeSettlementHeaderMonetarySummation:struct<LineTotalAmount:{_T},TaxBasisTotalAmount:{_T},TaxTotalAmount:{_T},GrandTotalAmount:{_T}>>>, "
    "_corrupt_record string"
)
ROOT = "CrossIndustryInvoice"
OPTIONS = {"rowTag": ROOT, "ignoreNamespace": "true", "mode": "PERMISSIVE", "valueTag": "_VALUE", "attributePrefix": "_", "columnNameOfCorruptRecord": "_corrupt_record", "inferSchema": "false"}


def _one(v: Column) -> Column:
    """The text of an element that stands once; null where it repeats."""
    return F.when(F.size(v) == 1, clean(F.get(v, F.lit(0))["_VALUE"]))


def _number(v: Column) -> Column:
    text = _one(v)
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text)


def _date(v: Column) -> Column:
    s = _one(v["DateTimeString"])
    return F.coalesce(F.when(s.rlike("^[0-9]{8}$"), F.regexp_replace(s, "^(.{4})(..)(..)$", "$1-$2-$3")), F.nullif(F.regexp_extract(s, "^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit("")))


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def _tax_ids(party: Column) -> Column:
    """The last registration of scheme VA (else the first without a known scheme that looks like one) and of FC."""
    ids = F.transform(F.filter(party["SpecifiedTaxRegistration"], lambda r: F.size(r["ID"]) == 1), lambda r: F.struct(F.get(r["ID"], F.lit(0))["_schemeID"].alias("scheme"), _one(r["ID"]).alias("value")))
    ids = F.filter(ids, lambda r: r["value"].isNotNull())

    def step(a: Column, r: Column) -> Column:
        shaped = a["vat"].isNull() & _compact(r["value"]).rlike(r"^[A-Z]{2}[A-Za-z0-9_]+$")
        vat = F.when(r["scheme"] == "VA", _compact(r["value"])).when(F.coalesce(r["scheme"] != "FC", F.lit(True)) & shaped, _compact(r["value"])).otherwise(a["vat"])
        return F.struct(vat.alias("vat"), F.when(r["scheme"] == "FC", r["value"]).otherwise(a["tax"]).alias("tax"))

    none = F.lit(None).cast("string")
    return F.aggregate(ids, F.struct(none.alias("vat"), none.alias("tax")), step)


def parse(xml: Column) -> Column:
    """The raw struct; null parts, and ``_corrupt_record``, where the text is no such document."""
    return F.from_xml(xml, SCHEMA, OPTIONS)


def envelope(doc: Column) -> tuple[Column, Column]:
    """From a parsed document: the candidate invoice, and why there is none (null if there is one)."""
    exchanged, transaction = doc["ExchangedDocument"], doc["SupplyChainTradeTransaction"]
    error = F.when(doc["_corrupt_record"].isNotNull(), F.lit("malformed XML")).when(exchanged.isNull() | transaction.isNull(), F.lit(f"no {ROOT} with its two parts"))
    agreement, settlement = transaction["ApplicableHeaderTradeAgreement"], transaction["ApplicableHeaderTradeSettlement"]
    seller, buyer = agreement["SellerTradeParty"], agreement["BuyerTradeParty"]
    address = seller["PostalTradeAddress"]
    place = F.when(address.isNotNull(), F.struct(*[_one(address[e]).alias(n) for n, e in (("street", "LineOne"), ("postal_code", "PostcodeCode"), ("city", "CityName"), ("country_code", "CountryID"))]))
    accounts = F.transform(settlement["SpecifiedTradeSettlementPaymentMeans"], lambda m: F.when(F.size(m["PayeePartyCreditorFinancialAccount"]) == 1, F.upper(_compact(_one(F.get(m["PayeePartyCreditorFinancialAccount"], F.lit(0))["IBANID"])))))
    ibans = F.coalesce(F.filter(accounts, lambda i: i.isNotNull()), F.array().cast("array<string>"))
    ids = _tax_ids(seller)
    none = F.lit(None)
    sums = settlement["SpecifiedTradeSettlementHeaderMonetarySummation"]
    vat = F.transform(settlement["ApplicableTradeTax"], lambda t: F.struct(_number(t["RateApplicablePercent"]).try_cast("double").alias("rate"), _number(t["BasisAmount"]).alias("net"), _number(t["CalculatedAmount"]).alias("tax")))

    def item(x: Column) -> Column:
        doc_line, deal, settled = x["AssociatedDocumentLineDocument"], x["SpecifiedLineTradeAgreement"], x["SpecifiedLineTradeSettlement"]
        q = x["SpecifiedLineTradeDelivery"]["BilledQuantity"]
        number = _one(doc_line["LineID"])
        rate = F.when(F.size(settled["ApplicableTradeTax"]) == 1, _number(F.get(settled["ApplicableTradeTax"], F.lit(0))["RateApplicablePercent"]))
        return F.struct(
            F.when(number.rlike("^[0-9]+$"), number.try_cast("int")).alias("position"),
            F.coalesce(_one(x["SpecifiedTradeProduct"]["Name"]), _one(doc_line["IncludedNote"]["Content"])).alias("description"),
            _number(q).alias("quantity"),
            F.when(F.size(q) == 1, clean(F.get(q, F.lit(0))["_unitCode"])).alias("unit"),
            F.coalesce(_number(deal["NetPriceProductTradePrice"]["ChargeAmount"]), _number(deal["GrossPriceProductTradePrice"]["ChargeAmount"])).alias("unit_price"),
            rate.try_cast("double").alias("tax_rate"),
            _number(settled["SpecifiedTradeSettlementLineMonetarySummation"]["LineTotalAmount"]).alias("line_total"),
        )

    items = F.filter(F.transform(transaction["IncludedSupplyChainTradeLineItem"], item), lambda x: x["description"].isNotNull())
    terms = settlement["SpecifiedTradePaymentTerms"]
    invoice = F.struct(
        _one(exchanged["ID"]).alias("invoice_number"),
        _date(exchanged["IssueDateTime"]).alias("issue_date"),
        _date(terms["DueDateDateTime"]).alias("due_date"),
        _one(settlement["InvoiceCurrencyCode"]).alias("currency"),
        none.cast("string").alias("locale"),
        F.when(seller.isNotNull(), F.struct(_one(seller["Name"]).alias("name"), ids["vat"].alias("vat_id"), ids["tax"].alias("tax_number"), ibans.alias("ibans"), place.alias("address"))).alias("seller"),
        F.when(buyer.isNotNull(), F.struct(_one(buyer["Name"]).alias("name"), _one(buyer["ID"]).alias("customer_number"), none.cast("struct<street:string,postal_code:string,city:string,country_code:string>").alias("address"))).alias("buyer"),
        F.when(sums.isNotNull(), F.struct(F.coalesce(_number(sums["TaxBasisTotalAmount"]), _number(sums["LineTotalAmount"])).alias("net"), _number(sums["TaxTotalAmount"]).alias("tax"), _number(sums["GrandTotalAmount"]).alias("gross"))).alias("totals"),
        F.when(F.size(vat) > 0, vat).alias("vat_breakdown"),
        F.when(F.size(items) > 0, items).alias("line_items"),
        _one(terms["Description"]).alias("payment_terms"),
    ).cast(INVOICE)
    return F.when(error.isNull(), invoice), error


def read_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """``df`` with ``invoice`` and ``error``. Rows with an error are for the text lane."""
    parsed = df.withColumn("_doc", parse(F.col(xml)))
    invoice, error = envelope(F.col("_doc"))
    return parsed.withColumns({"invoice": invoice, "error": error}).drop("_doc")
