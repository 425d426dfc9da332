"""Known starting data: the product list, the corrections of the index sheet and of the payment sheet."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ledgerwork.sources.schemas import SCHEMAS

# Product names.
PRODUCTS = [
    "Compteur",
    "Pompe",
    "Filtre",
    "Réservoir",
    "Tuyau irrigation",
    "Capteur de niveau",
    "Vanne à bille",
    "Distributeur",
    "Adoucisseur",
    "Kit de traitement",
    "Divers",
]
# Contract, index or date that names the reading, previous index. Later ones win.
READING_FIXES = [
    ("73", 1.0, None, -4.0),
    ("147", 1.0, None, -2.0),
    ("72", 6.0, None, -7.0),
    ("127", 7.0, None, -1.0),
    ("102", 1.0, None, 1.0),
    ("106", 1.0, None, -6.0),
    ("33", 2.0, None, 0.0),
    ("11", 7.0, None, 6.0),
    ("137", 1.0, None, -8.0),
    ("10", 4.0, None, -11.0),
    ("53", 12.0, None, 1.0),
    ("102", None, date(2024, 1, 1), 286.0),
    ("3", None, date(2024, 3, 1), 308.0),
]
# Position of the row in the payment sheet (first data row = 0), settlement date.
PAYMENT_FIXES = [
    (341, "2025-01-02"),
    (342, "2025-01-02"),
    (1690, "2024-10-11"),
    (1581, "2024-08-30"),
    (1847, "2024-11-4"),
    (1569, None),
    (1635, None),
]


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in PRODUCTS], SCHEMAS["product"])


def reading_fixes(spark: SparkSession) -> DataFrame:
    """For `readings.apply_corrections`."""
    rows = [(seq, *fix) for seq, fix in enumerate(READING_FIXES, 1)]
    return spark.createDataFrame(
        rows, "seq int, contract_no string, index_m3 double, read_on date, prev_index double"
    )


def payment_fixes(spark: SparkSession) -> DataFrame:
    """For `imports.clean_payments`, on a sheet whose `row_no` is the row's position; see
    `fill.number_rows` for one that has gaps."""
    return spark.createDataFrame(PAYMENT_FIXES, "row_no long, settled_raw string")
