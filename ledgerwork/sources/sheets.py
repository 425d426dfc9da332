"""Spreadsheet exports: CSV read as text, with the headers mapped to staging names.

Spark has no spreadsheet source; each sheet is exported to one or more CSV files first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwork.functions.ranges import in_ranges, numbered

# The headers of the source sheets and the staging names used here.
# Columns that are not listed are dropped.
SHEETS = {
    "subscribers": {"N_Contrat": "contract_raw", "Nom_complet": "name", "Mnt_due": "fee_raw"},
    "index": {
        "N_contrat": "contract_raw",
        "Index_initial": "dec",
        "Jan": "jan",
        "Fev": "feb",
        "Mars": "mar",
        "Avr": "apr",
        "Mai": "may",
        "Juin": "jun",
        "Juil": "jul",
        "Aout": "aug",
        "Sep": "sep",
        "Oct": "oct",
    },
    "payments": {
        "N_contrat": "contract_raw",
        "mois_consome": "due_raw",
        "Date encaissements": "settled_raw",
        "Reçu N°": "receipt_raw",
        "FG.1": "mgmt_raw",
        "perte": "loss_raw",
        "Total_recettes": "amount_raw",
    },
    "quarter": {
        "N_contrat": "contract_no",
        " cons_mars": "amount_mar",
        "N_recue_mars": "receipt_mar",
        "Date_mars": "date_mar",
        " cons_avril": "amount_apr",
        "N_recue_avril": "receipt_apr",
        "Date_avril": "date_apr",
        " cons_mai": "amount_may",
        "N_recue_mai": "receipt_may",
        "Date_mai": "date_may",
        " cons_juin": "amount_jun",
        "N_recue_juin": "receipt_jun",
        "Date_juin": "date_jun",
    },
    "memberships": {
        "Code": "contract_raw",
        "الالاسم الكامل": "name",
        "Unnamed: 13": "paid_raw",
        "Unnamed: 14": "receipt_raw",
        "Unnamed: 15": "amount_raw",
        "Unnamed: 16": "collector_receipt",
        "Montant payé Abonnements 04 2024": "collector_amount_raw",
    },
    "previous_office": {"N_contrat": "contract_raw", "PAYE": "amount_raw"},
}


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """All-text staging frame of one sheet plus `row_no`, which grows in file order.

    Of one file, `row_no` is the byte offset of the file split plus the row's place in its task: unique
    and ordered, without a sort or a pass over the data, and not gap-free. Several files (a folder or a
    pattern) are one sheet in the order of their paths; its rows are numbered 0, 1, ... by path, split and
    place, over ranges of equal row count.
    """
    names = SHEETS[sheet]
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    columns = [F.col(f"`{header}`").alias(name) for header, name in names.items()]
    start = F.col("_metadata.file_block_start")
    if len(raw.inputFiles()) == 1:
        return raw.select((start + place).alias("row_no"), *columns)
    placed = raw.select(F.col("_metadata.file_path").alias("_path"), start.alias("_start"), place.alias("_at"), *columns)
    return numbered(in_ranges(placed, ["_path", "_start", "_at"]), 0, "row_no").select("row_no", *names.values())
