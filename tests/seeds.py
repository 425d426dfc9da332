"""The sample books, row by row. Used as golden inputs."""

from __future__ import annotations

from datetime import date

# Contract, identity card, block, meter, name, fee, joined on, address.
SUBSCRIBERS = [
    ("01", "Bk234", "1", "CP001", "John Doe", 1500.50, "2024-01-01", "hamou"),
    ("02", "BK123", "2", "CP002", "Jane Smith", 2000.00, "2024-02-01", "baala"),
    ("03", "BK45", "3", "CP003", "Ahmed Ali", 1750.75, "2024-03-10", "789 Boulevard Zerktouni, Fès"),
    ("04", "CIN004", "2", "CP004", "Sarah Karim", 1850.00, "2024-03-15", "321 Rue Ibn Battuta, Marrakech"),
    ("05", "CIN005", "3", "CP005", "Youssef Haddad", 1450.25, "2024-04-01", "654 Avenue Hassan II, Tanger"),
    ("06", "CIN006", "4", "CP006", "Fatima Zahra", 2100.00, "2024-04-20", "876 Rue Oqba Ibn Nafia, Agadir"),
    ("07", "CIN007", "4", "CP007", "Mohamed Chraibi", 1950.30, "2024-05-01", "543 Boulevard Moulay Youssef, Oujda"),
    ("08", "CIN008", "4", "CP008", "Hajar El Alaoui", 1800.00, "2024-05-10", "234 Rue Al Mounir, Meknès"),
    ("09", "CIN009", "1", "CP009", "Rachid Benomar", 1650.60, "2024-06-01", "123 Rue Dakhla, Tétouan"),
    ("10", "CIN010", "3", "CP010", "Samira Lahlou", 1750.80, "2024-06-15", "456 Avenue Abdelmoumen, Laâyoune"),
]
# Contract, receipt, amount, paid on.
MEMBERSHIP_PAYMENTS = [
    ("01", "1", 500.00, "2024-01-10"),
    ("01", "2", 500.00, "2024-02-10"),
    ("01", "3", 500.00, "2024-03-10"),
    ("01", "4", 0.50, "2024-04-01"),
    ("02", "5", 1000.00, "2024-02-15"),
    ("02", "6", 1000.00, "2024-03-15"),
    ("03", "7", 500.00, "2024-03-15"),
    ("03", "8", 500.00, "2024-04-05"),
    ("04", "9", 800.00, "2024-03-20"),
    ("04", "10", 800.00, "2024-04-05"),
    ("05", "11", 800.00, "2024-04-10"),
    ("06", "12", 500.00, "2024-04-25"),
    ("06", "13", 500.00, "2024-05-05"),
    ("07", "14", 1000.00, "2024-05-15"),
    ("08", "15", 1800.00, "2024-05-25"),
    ("09", "16", 1650.60, "2024-06-10"),
    ("10", "17", 600.00, "2024-06-20"),
    ("10", "18", 1150.80, "2024-07-01"),
]
# Contract, index, read on.
READINGS = [
    ("01", 2, "2024-06-01"),
    ("01", 4, "2024-07-01"),
    ("01", 5, "2024-08-01"),
    ("01", 6, "2024-09-01"),
    ("01", 7, "2024-10-01"),
    ("01", 10, "2024-11-01"),
    ("02", 3, "2024-06-01"),
    ("02", 9, "2024-07-01"),
    ("02", 14, "2024-08-01"),
    ("02", 18, "2024-09-01"),
    ("02", 19, "2024-10-01"),
    ("02", 22, "2024-11-01"),
    ("03", 1, "2024-06-01"),
    ("03", 7, "2024-07-01"),
    ("03", 10, "2024-08-01"),
    ("03", 11, "2024-09-01"),
    ("03", 15, "2024-10-01"),
    ("03", 20, "2024-11-01"),
    ("04", 10, "2024-06-01"),
    ("04", 13, "2024-07-01"),
    ("04", 19, "2024-08-01"),
    ("04", 22, "2024-09-01"),
    ("04", 26, "2024-10-01"),
    ("04", 28, "2024-11-01"),
    ("05", 1, "2024-06-01"),
    ("05", 7, "2024-07-01"),
    ("05", 9, "2024-08-01"),
    ("05", 17, "2024-09-01"),
    ("05", 20, "2024-10-01"),
    ("05", 28, "2024-11-01"),
]
# Contract, receipt, amount, month paid, settled on.
PAYMENTS = [
    ("01", "1", 14.00, "2024-06-15", "2024-06-16"),
    ("01", "6", 14.00, "2024-07-01", "2024-07-02"),
    ("01", "5", 7.00, "2024-08-15", "2024-08-16"),
    ("01", "6", 7.00, "2024-09-01", "2024-09-02"),
    ("01", "2", 7.00, "2024-10-15", "2024-10-16"),
    ("02", "2", 21.00, "2024-06-15", "2024-06-16"),
    ("02", "7", 42.00, "2024-07-01", "2024-07-02"),
    ("02", "11", 35.00, "2024-08-15", "2024-08-16"),
    ("02", "15", 28.00, "2024-09-01", "2024-09-02"),
    ("03", "9", 7.00, "2024-06-15", "2024-06-16"),
    ("03", "16", 42.00, "2024-07-01", "2024-07-02"),
    ("03", "15", 21.00, "2024-08-15", "2024-08-16"),
    ("03", "16", 7.00, "2024-09-01", "2024-09-02"),
    ("03", "12", 28.00, "2024-10-15", "2024-10-16"),
    ("03", "10", 35.00, "2024-11-15", "2024-11-16"),
    ("04", "3", 21.00, "2024-09-01", "2024-10-02"),
    ("04", "7", 70.00, "2024-06-15", "2024-08-16"),
    ("04", "12", 14.00, "2024-11-01", "2024-11-02"),
    ("05", "12", 7.00, "2024-06-01", "2024-06-02"),
]


def subscribers(spark):
    rows = [(*row[:6], date.fromisoformat(row[6]), row[7]) for row in SUBSCRIBERS]
    columns = "contract_no string, id_card string, block_no string, meter_no string, name string, joining_fee double, joined_on date, address string"
    return spark.createDataFrame(rows, columns)


def membership_payments(spark):
    rows = [(*row[:3], date.fromisoformat(row[3])) for row in MEMBERSHIP_PAYMENTS]
    return spark.createDataFrame(rows, "contract_no string, receipt_no string, amount double, paid_on date")


def readings(spark, fees: float = 0.0):
    """The sample indexes; the previous index of a contract's first month is 0."""
    rows, previous = [], {}
    for contract, index, day in READINGS:
        rows.append((contract, date.fromisoformat(day), float(index), previous.get(contract, 0.0), fees, 0.0))
        previous[contract] = float(index)
    return spark.createDataFrame(
        rows, "contract_no string, read_on date, index_m3 double, prev_index double, mgmt_fee double, loss_fee double"
    )


def consumption_payments(spark):
    rows = [(*row[:3], date.fromisoformat(row[3]), date.fromisoformat(row[4]), 0.0, 0.0) for row in PAYMENTS]
    return spark.createDataFrame(
        rows,
        "contract_no string, receipt_no string, amount double, due_on date, settled_on date, mgmt_fee double, loss_fee double",
    )
