"""Structured data: validators over JSON-LD and generators of it.

The validators walk JSON of any shape, one value per row (Arrow batches); the
generators are struct expressions, since ``to_json`` leaves nulls out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.schemas import struct

FINDINGS = T.ArrayType(struct("severity string, rule string, message string"))
# Types without rich results, by the check that reports them.
RETIRED_PRODUCT = {
    "Vehicle": "Vehicle Listing rich result retired June 2025.",
    "VehicleListing": "Vehicle Listing rich result retired June 2025.",
    "ClaimReview": "Claim Review rich result retired June 2025.",
    "EstimatedSalary": "Estimated Salary rich result retired June 2025.",
    "LearningVideo": "Learning Video rich result retired June 2025.",
    "Course": "The Course rich result is still live but the Course Info carousel variant was retired June 2025. Verify which use-case applies.",
    "SpecialAnnouncement": "Special Announcement rich result deprecated July 2025.",
}
RETIRED_MARKUP = {
    "HowTo": "deprecated September 2023",
    "SpecialAnnouncement": "deprecated July 31, 2025",
    "CourseInfo": "retired June 2025",
    "EstimatedSalary": "retired June 2025",
    "LearningVideo": "retired June 2025",
    "ClaimReview": "retired June 2025; fact-check rich results discontinued",
    "VehicleListing": "retired June 2025; vehicle listing structured data discontinued",
}
PLACEHOLDERS = ("[Business Name]", "[City]", "[State]", "[Phone]", "[Address]", "[Your", "[INSERT", "REPLACE", "[URL]", "[Email]")
CONTEXTS = ("https://schema.org", "http://schema.org")


def _types(node: object) -> list[str]:
    kind = node.get("@type") if isinstance(node, dict) else None
    return [k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]


def _nodes(value: object) -> Iterator[dict]:
    """All objects of a JSON value, outer before inner, in order."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def _lacks(node: dict, field: str) -> bool:
    return node.get(field) in (None, "", [])


def product_findings(payload: str | None, eu: bool = False) -> list[dict]:
    """Findings on one JSON-LD value that should describe a product; invalid JSON is one Critical finding."""
    out: list[dict] = []
    add = lambda severity, rule, message: out.append({"severity": severity, "rule": rule, "message": message})
    try:
        data = json.loads(payload or "")
    except ValueError:
        add("Critical", "invalid-json", "The payload is not valid JSON.")
        return out
    nodes = list(_nodes(data))
    for kind in (k for n in nodes for k in _types(n) if k in RETIRED_PRODUCT):
        add("Critical", "deprecated-type", f"@type={kind!r}: {RETIRED_PRODUCT[kind]}")
    products = [n for n in nodes if "Product" in _types(n)]
    if not products:
        add("High", "missing-product", 'No @type="Product" block found in the JSON-LD.')
    for p in products:
        for field, severity, word in (("name", "High", "missing"), ("image", "High", "missing"), ("offers", "High", "missing"), ("description", "Medium", "recommended")):
            if _lacks(p, field):
                add(severity, f"{word}-product-{field}", f"Product lacks {field!r}.")
        offers = p.get("offers")
        offers = [o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)]
        for o in offers:
            if "Offer" not in _types(o) or "AggregateOffer" in _types(o):
                add("High", "merchant-listing-offer-type", "Merchant listings require offers.@type='Offer'.")
            for field in ("price", "priceCurrency", "availability"):
                if _lacks(o, field):
                    add("Medium", f"recommended-offer-{field}", f"Offer lacks {field!r}.")
        first = offers[0] if offers else {}
        for key, missing, prefix, fields in (
            ("hasMerchantReturnPolicy", "missing-return-policy", "return-policy", ("applicableCountry", "returnPolicyCategory")),
            ("shippingDetails", "missing-shipping-details", "shipping", ("shippingDestination", "deliveryTime")),
        ):
            found = p.get(key) or first.get(key)
            if not found:
                add("Medium", missing, f"Product (or its first Offer) lacks {key}.")
            elif isinstance(found, dict):
                for field in fields:
                    if field not in found:
                        add("Medium", f"{prefix}-{field}", f"{key} lacks {field!r}.")
        specs = [o.get("priceSpecification") for o in offers]
        tiers = any(isinstance(s, dict) and s.get("@type") == "UnitPriceSpecification" and s.get("validForMemberTier") for s in specs)
        if not p.get("hasMemberProgram") and not tiers:
            add("Medium", "missing-member-program", "No MemberProgram or loyalty-tier pricing declared.")
        if eu and "energyEfficiencyClass" not in p:
            add("High", "missing-eu-energy-class", "In-scope products require energyEfficiencyClass.")
    if products and not any("ProductGroup" in _types(n) for n in nodes):
        add("Info", "no-product-group", "Consider ProductGroup if the product has variants.")
    return out


def validate_products(rows: DataFrame, payload: str = "payload", eu: bool = False) -> DataFrame:
    """rows with findings, ok (no Critical or High) and counts by severity."""

    @F.pandas_udf(FINDINGS)
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda x: product_findings(x, eu))

    df = rows.withColumn("findings", check(payload))
    count = lambda severity: F.size(F.filter("findings", lambda f: f["severity"] == severity)).cast("long")
    df = df.withColumns({s.lower(): count(s) for s in ("Critical", "High", "Medium", "Info")})
    return df.withColumn("ok", (F.col("critical") == 0) & (F.col("high") == 0))


_LD = re.compile(r"""<script\s+type=["']application/ld\+json["']\s*>(.*?)</script>""", re.DOTALL | re.IGNORECASE)


def markup_errors(html: str | None) -> list[str]:
    """Errors of the JSON-LD blocks of a page: JSON, context, type, placeholders, retired types."""
    out = []
    for k, raw in enumerate(_LD.findall(html or ""), 1):
        try:
            data = json.loads(raw.strip())
        except ValueError as e:
            out.append(f"Block {k}: Invalid JSON; {e}")
            continue
        for node in data if isinstance(data, list) else [data]:
            if not isinstance(node, dict):
                continue
            if "@context" not in node:
                out.append(f"Block {k}: Missing @context")
            elif node["@context"] not in CONTEXTS:
                out.append(f"Block {k}: @context should be 'https://schema.org'")
            if "@type" not in node:
                out.append(f"Block {k}: Missing @type")
            text = json.dumps(node).lower()
            out += [f"Block {k}: Contains placeholder text: {p}" for p in PLACEHOLDERS if p.lower() in text]
            kind = node.get("@type", "")
            if isinstance(kind, str) and kind in RETIRED_MARKUP:
                out.append(f"Block {k}: @type '{kind}' is {RETIRED_MARKUP[kind]}")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def check_markup(html: pd.Series) -> pd.Series:
    return html.map(markup_errors)


def _thing(kind: str, **fields: Column) -> Column:
    named = [F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[c.alias(k) for k, c in fields.items()]]
    return F.to_json(F.struct(*named))


def _part(kind: str, **fields: Column) -> Column:
    """An inner object, left out where all its fields are null."""
    any_ = F.coalesce(*[c.cast("string") for c in fields.values()]).isNotNull()
    return F.when(any_, F.struct(F.lit(kind).alias("@type"), *[c.alias(k) for k, c in fields.items()]))


def reservation(kind: str, number: Column, name: Column, start: Column, status: Column | None = None) -> Column:
    """JSON-LD of a reservation of some kind (such as FoodEstablishmentReservation)."""
    status = F.coalesce(status if status is not None else F.lit(None).cast("string"), F.lit("https://schema.org/ReservationConfirmed"))
    return _thing(kind, reservationId=number, reservationStatus=status, underName=_part("Person", name=name), startTime=start)


def order_action(target: Column, name: Column, currency: Column | None = None) -> Column:
    entry = F.when(target.isNotNull(), F.struct(F.lit("EntryPoint").alias("@type"), target.alias("urlTemplate")))
    return _thing("OrderAction", target=entry, name=name, priceCurrency=currency if currency is not None else F.lit(None).cast("string"))


def discussion(headline: Column, text: Column, author: Column, published: Column, likes: Column, comments: Column) -> Column:
    stat = lambda kind, n: F.when(n.isNotNull(), F.struct(F.lit("InteractionCounter").alias("@type"), F.lit(f"https://schema.org/{kind}").alias("interactionType"), n.alias("userInteractionCount")))
    stats = F.filter(F.array(stat("LikeAction", likes), stat("CommentAction", comments)), lambda x: x.isNotNull())
    return _thing("DiscussionForumPosting", headline=headline, text=text, author=_part("Person", name=author), datePublished=published, interactionStatistic=F.when(F.size(stats) > 0, stats))


def profile(name: Column, handle: Column, same_as: Column) -> Column:
    person = F.struct(F.lit("Person").alias("@type"), name.alias("name"), handle.alias("alternateName"), F.when(F.size(same_as) > 0, same_as).alias("sameAs"))
    return _thing("ProfilePage", mainEntity=person)
