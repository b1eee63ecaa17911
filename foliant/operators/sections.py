"""Form and item to canonical section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import once

#: Section, items of a 10-K, items of a 20-F.
SECTIONS = (
    ("business_overview", "1", "4"),
    ("properties", "2", "4"),
    ("risk_factors", "1A", "3.D"),
    ("unresolved_staff_comments", "1B", "4A"),
    ("cybersecurity", "1C", "16K"),
    ("legal_proceedings", "3", ""),
    ("mine_safety_disclosures", "4", "16-bundle"),
    ("market_for_registrant_equity", "5", "9"),
    ("reserved_selected_financial_data", "6", "3.A"),
    ("mdna", "7", "5"),
    ("market_risk_disclosures", "7A", "11"),
    ("financial_statements", "8", "17 18"),
    ("accountant_changes", "9", ""),
    ("controls_and_procedures", "9A", "15"),
    ("other_information", "9B", ""),
    ("foreign_jurisdiction_inspection", "9C", "16-bundle"),
    ("directors_and_governance", "10", "6"),
    ("executive_compensation", "11", "6.B"),
    ("security_ownership", "12", "6.E 7"),
    ("related_party_transactions", "13", "7"),
    ("principal_accountant_fees", "14", "16-bundle"),
    ("exhibits", "15", "19"),
    ("form_summary", "16", ""),
    ("signatures", "signatures", "signatures"),
    ("offer_statistics_timetable", "", "2"),
    ("capitalization_indebtedness", "", "3.B"),
    ("reasons_for_offer_proceeds", "", "3.C"),
    ("additional_information", "", "10"),
    ("description_of_securities", "", "12"),
    ("defaults_dividend_arrearages", "", "13"),
    ("material_modifications_rights", "", "14"),
)
#: Words on a cover that decide between sections of one item.
KEYWORDS = {
    "security_ownership": ("beneficial owner", "share ownership", "shares beneficially owned"),
    "related_party_transactions": ("related part", "related-party", "affiliated transaction"),
}


def lookup(spark: SparkSession) -> DataFrame:
    """J04's table: a row a form, item and section, in the order of sections."""
    rows = [
        (
            form, item.upper(), name, i
        ) for i, (name, k, f) in enumerate(SECTIONS) for form, items in (("10-K", k), ("20-F", f)) for item in items.split()
    ]
    return spark.createDataFrame(rows, "form_type string, item string, section string, place int")


def candidates(docs: DataFrame, form: str = "form_type", item: str = "item") -> DataFrame:
    """``docs`` with ``sections``, all that its form and item may mean, in order; empty for none."""
    table = lookup(docs.sparkSession).groupBy(F.col("form_type").alias("__f"), F.col("item").alias("__i")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda s: s["section"]).alias("sections")
    )
    key = (F.col(form) == F.col("__f")) & (F.upper(F.trim(F.col(item))) == F.col("__i"))
    return docs.join(F.broadcast(table), key, "left").drop("__f", "__i").withColumn(
        "sections", F.coalesce("sections", F.array().cast("array<string>"))
    )


def said(text: Column) -> Column:
    """The sections of ``KEYWORDS`` that have a keyword in the text, in order."""

    def named(low: Column) -> Column:
        hits = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)) for name, words in KEYWORDS.items()]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    return once(F.lower(F.coalesce(text, F.lit(""))), named)


def decided(sections: Column, named: Column) -> Column:
    """The only candidate, else the first that the text names (``said``), else null."""
    return F.when(F.size(sections) <= 1, F.get(sections, 0)).otherwise(F.get(F.filter(named, lambda n: F.array_contains(sections, n)), 0))


def canonical_section(docs: DataFrame, form: str = "form_type", item: str = "item", text: str = "text", named: str | None = None) -> DataFrame:
    """J05; ``named`` is a column of what the text says, where ``said`` of it is known already."""
    found = candidates(docs, form, item)
    return found.withColumn("section", decided(F.col("sections"), said(F.col(text)) if named is None else F.col(named))).drop("sections")
