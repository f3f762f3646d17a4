"""Logical schemas of the four input tables, stated once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Column headings of the input files -> our names and types.
SALES = {
    "Row ID": ("row_id", "bigint"),
    "Order ID": ("order_id", "string"),
    "Order Date": ("order_date", "timestamp"),
    "Ship Date": ("ship_date", "timestamp"),
    "Ship Mode": ("ship_mode", "string"),
    "Customer ID": ("customer_id", "string"),
    "Country/Region": ("country", "string"),
    "City": ("city", "string"),
    "State/Province": ("state", "string"),
    "Postal Code": ("postal_code", "string"),
    "Division": ("division", "string"),
    "Region": ("region", "string"),
    "Product ID": ("product_id", "string"),
    "Product Name": ("product_name", "string"),
    "Sales": ("sales", "double"),
    "Units": ("units", "bigint"),
    "Gross Profit": ("gross_profit", "double"),
    "Cost": ("cost", "double"),
}
PRODUCTS = {
    "Division": ("division", "string"),
    "Product Name": ("product_name", "string"),
    "Factory": ("factory", "string"),
    "Product ID": ("product_id", "string"),
    "Unit Price": ("unit_price", "double"),
    "Unit Cost": ("unit_cost", "double"),
}
FACTORIES = {
    "Factory": ("factory", "string"),
    "Latitude": ("latitude", "double"),
    "Longitude": ("longitude", "double"),
}
TARGETS = {
    "Division": ("division", "string"),
    "Target": ("target", "double"),
}

# Texts that a data-frame CSV reader takes as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Date spellings accepted on reading, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "M-d-yyyy")

# Columns a row must agree in to count as an exact copy of another row.
SALES_BUSINESS_COLUMNS = tuple(name for name, _ in SALES.values() if name != "row_id")
SALES_MEASURES = ("sales", "units", "gross_profit", "cost")


@dataclass(frozen=True)
class TableSpec:
    """One logical input: heading -> (name, type), and what must be there."""

    name: str
    columns: dict[str, tuple[str, str]]
    required: tuple[str, ...]

    def missing_headings(self, headings: list[str]) -> list[str]:
        known = set(headings)
        return [
            h for h, (name, _) in self.columns.items()
            if name in self.required and h not in known and name not in known
        ]


# Columns the merge, the reports or the regressors cannot do without.
SALES_TABLE = TableSpec(
    "sales",
    SALES,
    (
        "order_id", "order_date", "ship_date", "ship_mode", "division", "region",
        "product_id", "product_name", "sales", "units", "gross_profit", "cost",
    ),
)
PRODUCTS_TABLE = TableSpec(
    "products",
    PRODUCTS,
    ("division", "product_name", "product_id", "factory", "unit_price", "unit_cost"),
)
FACTORIES_TABLE = TableSpec("factories", FACTORIES, ("factory",))
TARGETS_TABLE = TableSpec("targets", TARGETS, ("division", "target"))


def check_required(df: DataFrame, spec: TableSpec) -> None:
    """Fail before any job runs when a required column is absent."""
    absent = spec.missing_headings(df.columns)
    if absent:
        raise ValueError(f"{spec.name}: missing columns {absent}; found {df.columns}")
