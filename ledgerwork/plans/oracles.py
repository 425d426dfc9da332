"""DuckDB SQL for every registered query, written from the rules and not from the Spark code.

Joins are the literal ones where the Spark jobs use a rewrite. Each text lists the domain
tables it needs as CTEs over the driver's views.
"""

from __future__ import annotations

import re

CTES = {
    "order_usage": """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) order_day, o_orderpriority, SUM(l_quantity) q
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""",
    "subscriber": """SELECT CAST(c_custkey AS VARCHAR) contract_no, CAST(c_nationkey AS VARCHAR) block_no, c_name AS name,
        CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE COALESCE(f.paid, 0) + (c_custkey % 3) * 100.0e0 END joining_fee
        FROM customer LEFT JOIN (SELECT o_custkey, SUM(ROUND(o_totalprice)) paid FROM orders
            WHERE o_orderstatus = 'F' GROUP BY 1) f ON o_custkey = c_custkey""",
    "membership_payment": """SELECT CAST(o_custkey AS VARCHAR) contract_no, CAST(o_orderkey AS VARCHAR) receipt_no,
        ROUND(o_totalprice) amount, CAST(o_orderdate AS DATE) paid_on FROM orders WHERE o_orderstatus = 'F'""",
    "reading0": """SELECT CAST(o_custkey AS VARCHAR) contract_no, CAST(date_trunc('month', order_day) AS DATE) read_on,
        SUM(q) used FROM order_usage GROUP BY 1, 2""",
    "reading1": """SELECT contract_no, read_on, SUM(used) OVER (PARTITION BY contract_no ORDER BY read_on
        ROWS UNBOUNDED PRECEDING) index_m3 FROM reading0""",
    "meter_reading": """SELECT contract_no, read_on, index_m3,
        LAG(index_m3) OVER (PARTITION BY contract_no ORDER BY read_on) prev_index,
        CASE WHEN read_on >= DATE '1996-03-01' THEN 10.0e0 ELSE 0.0e0 END mgmt_fee,
        CASE WHEN read_on >= DATE '1996-07-01' THEN 5.0e0 ELSE 0.0e0 END loss_fee FROM reading1""",
    "consumption_payment": """SELECT CAST(o_custkey AS VARCHAR) contract_no, CAST(o_orderkey AS VARCHAR) receipt_no,
        CASE o_orderpriority WHEN '2-HIGH' THEN 7 * q + 15 WHEN '3-MEDIUM' THEN 3 * q WHEN '5-LOW' THEN 7 * q + 20 ELSE 7 * q END amount,
        CAST(date_trunc('month', order_day) AS DATE) due_on,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE order_day + 10 END settled_on,
        10.0e0 mgmt_fee, 5.0e0 loss_fee
        FROM (SELECT * FROM order_usage UNION ALL SELECT * FROM order_usage WHERE o_orderpriority = '3-MEDIUM') u
        WHERE o_orderpriority <> '1-URGENT'""",
    "block_reading": """SELECT block_no, read_on,
        SUM(used + 2) OVER (PARTITION BY block_no ORDER BY read_on ROWS UNBOUNDED PRECEDING) index_m3
        FROM (SELECT block_no, read_on, SUM(used) used FROM reading0 r JOIN subscriber s ON s.contract_no = r.contract_no GROUP BY 1, 2) x""",
    "product": """SELECT CAST(p_partkey AS VARCHAR) product FROM part
        UNION ALL SELECT 'spare ' || p_partkey FROM part WHERE p_partkey % 50 = 0""",
    "purchase": """SELECT l_orderkey purchase_id, CAST(l_partkey AS VARCHAR) product, CAST(l_shipdate AS DATE) bought_on,
        l_quantity qty, ROUND(l_extendedprice) unit_price, CAST(l_orderkey AS VARCHAR) receipt_no,
        CAST(l_suppkey AS VARCHAR) vendor FROM lineitem WHERE l_returnflag = 'A'""",
    "product_use": """SELECT CAST(l_partkey AS VARCHAR) product, CAST(l_shipdate AS DATE) used_on, l_quantity qty,
        'order ' || l_orderkey note FROM lineitem WHERE l_returnflag = 'R'""",
    "supplier_bill": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, SUM(l_quantity) index_m3,
        SUM(ROUND(l_extendedprice)) amount_due, 'F' || strftime(date_trunc('month', l_shipdate), '%Y%m') invoice_no
        FROM lineitem GROUP BY 1, 4""",
    "supplier_payment": """SELECT CAST(strftime(month, '%Y%m') AS BIGINT) * 10 + k payment_id, month,
        CASE WHEN month(month) % 3 = 1 THEN amount_due ELSE FLOOR(amount_due / 2) END amount,
        'R' || strftime(month, '%Y%m') || '-' || k receipt_no, month + 20 paid_on
        FROM supplier_bill JOIN (SELECT 1 k UNION ALL SELECT 2) s ON month(month) % 3 >= k""",
    "maintenance": """SELECT o_orderkey job_id, CAST(o_orderdate AS DATE) done_on, 'order ' || o_orderkey note,
        'worker ' || o_custkey worker, ROUND(o_totalprice) worker_pay FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "maintenance_detail": """SELECT l_orderkey job_id, CAST(l_partkey AS VARCHAR) product, l_quantity qty FROM lineitem""",
    "raw_payment": """SELECT o_orderkey * 10 + k row_no,
        CASE WHEN o_orderkey % 97 = 0 THEN 'Total du mois' ELSE CAST(o_custkey AS VARCHAR) END contract_raw,
        CASE WHEN k = 2 THEN NULL ELSE CAST(CAST(date_trunc('month', order_day) AS DATE) AS VARCHAR) END due_raw,
        CASE WHEN o_orderkey % 41 = 0 THEN 'NR' WHEN o_orderkey % 43 = 0 THEN ',' WHEN o_orderkey % 47 = 0 THEN NULL
            ELSE CAST(order_day AS VARCHAR) END settled_raw,
        CASE WHEN o_orderkey % 13 = 0 THEN 'nan' WHEN o_orderkey % 29 = 0 THEN NULL
            ELSE CAST(o_orderkey + 1000 AS VARCHAR) || '.0' END receipt_raw,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 10.0e0 END mgmt_fee,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 5.0e0 END loss_fee,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 0.0e0 WHEN o_orderkey = 5003 THEN -16831.0e0 ELSE q * 7 END amount
        FROM (SELECT *, 1 k FROM order_usage UNION ALL SELECT *, 2 FROM order_usage WHERE o_orderpriority = '3-MEDIUM') u""",
    "payment_fixes": """SELECT o_orderkey * 10 + 1 row_no, strftime(o_orderdate, '%Y-%m-%d') settled_raw
        FROM orders WHERE o_orderkey % 43 = 0 AND o_orderpriority = '2-HIGH'""",
    "wide_payment": """SELECT CAST(o_custkey AS VARCHAR) contract_no, month(order_day) m, CAST(o_orderkey AS VARCHAR) receipt_no,
        CASE WHEN month(order_day) <> 3 THEN q WHEN o_custkey % 23 = 0 THEN NULL WHEN q > 100 THEN CAST('1' || CAST(q AS INT) AS DOUBLE) ELSE q END amount,
        CASE WHEN month(order_day) = 4 AND o_custkey % 29 = 0 THEN NULL ELSE order_day END settled_on FROM order_usage""",
    "reading_fixes": """SELECT -1 seq, contract_no, index_m3, CAST(NULL AS DATE) read_on, 0.0e0 prev_index
        FROM meter_reading WHERE prev_index IS NULL
        UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), NULL, CAST(date_trunc('month', o_orderdate) AS DATE),
        ROUND(o_totalprice / 1000) FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "raw_membership": """SELECT o_orderkey row_no, CASE WHEN o_orderkey % 37 <> 0 THEN o_custkey END contract,
        CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END paid_on, CAST(o_orderkey AS VARCHAR) receipt_no,
        CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE ROUND(o_totalprice) END amount, o_orderkey % 3 source
        FROM orders WHERE o_orderstatus = 'F'""",
    "reading_batch": """SELECT (year(read_on) * 12 + month(read_on)) * 1000000000 + CAST(contract_no AS BIGINT) submitted_seq, contract_no,
        CASE WHEN CAST(contract_no AS BIGINT) % 13 = 0 AND month(read_on) = 2 THEN -1.0e0 ELSE index_m3 END index_m3, read_on
        FROM meter_reading WHERE read_on >= DATE '2001-01-01'""",
    "all_batch": """SELECT * FROM reading_batch UNION ALL SELECT submitted_seq + 1000000000000000, 'N' || contract_no, index_m3, read_on
        FROM reading_batch WHERE CAST(contract_no AS BIGINT) % 17 = 0""",
    "older_reading": """SELECT * FROM meter_reading WHERE read_on < DATE '2001-01-01'""",
    "known_contract": """SELECT contract_no FROM subscriber UNION ALL SELECT 'N' || contract_no FROM subscriber WHERE CAST(contract_no AS BIGINT) % 34 = 0""",
    "payment_batch": """SELECT contract_no, CAST(CAST(receipt_no AS BIGINT) % 400 AS VARCHAR) receipt_no,
        CASE WHEN CAST(receipt_no AS BIGINT) % 11 = 0 THEN -amount ELSE amount END amount, due_on, settled_on FROM consumption_payment
        UNION ALL SELECT 'L' || contract_no, receipt_no, amount, due_on, settled_on FROM consumption_payment WHERE CAST(receipt_no AS BIGINT) % 23 = 0""",
    "listed_purchase": """SELECT * REPLACE (CASE WHEN purchase_id % 13 = 0 THEN 'odd ' || product ELSE product END AS product) FROM purchase""",
    "unlisted_jobs": "SELECT DISTINCT job_id FROM maintenance_detail WHERE product IN ('7', '77')",
    "bills": """SELECT contract_no, strftime(read_on, '%Y-%m') AS month, read_on, index_m3, index_m3 - prev_index qty_m3,
        (index_m3 - prev_index) * 7 base_amount, mgmt_fee, loss_fee, (index_m3 - prev_index) * 7 + mgmt_fee + loss_fee total FROM meter_reading""",
    "dated": """SELECT contract_no, strftime(due_on, '%Y-%m') AS month, settled_on, receipt_no, amount FROM consumption_payment WHERE settled_on IS NOT NULL""",
    "ledger": """SELECT b.contract_no, b.month, p.settled_on, p.receipt_no, b.index_m3, b.qty_m3, b.base_amount, b.mgmt_fee, b.loss_fee,
        b.total, p.amount, b.total - COALESCE(p.amount, 0) credit
        FROM bills b LEFT JOIN dated p ON b.contract_no IS NOT DISTINCT FROM p.contract_no AND b.month IS NOT DISTINCT FROM p.month""",
    "open_rows": "SELECT * FROM ledger WHERE credit IS NULL OR credit <> 0",
    "unpaid": """SELECT o.contract_no, o.month, o.index_m3, o.qty_m3, o.total, o.amount, g.remaining FROM open_rows o JOIN (
        SELECT contract_no, month, total - COALESCE(SUM(amount), 0) remaining FROM open_rows
        WHERE contract_no IS NOT NULL AND month IS NOT NULL AND total IS NOT NULL
        GROUP BY contract_no, month, total HAVING total - COALESCE(SUM(amount), 0) <> 0) g
        ON o.contract_no = g.contract_no AND o.month = g.month""",
    "unpaid_net": """SELECT b.contract_no, b.month, b.qty_m3, b.total, COALESCE(p.paid, 0) paid, b.total - COALESCE(p.paid, 0) remaining
        FROM (SELECT contract_no, month, SUM(qty_m3) qty_m3, SUM(total) total FROM bills GROUP BY 1, 2) b
        LEFT JOIN (SELECT contract_no, month, SUM(amount) paid FROM dated GROUP BY 1, 2) p ON b.contract_no = p.contract_no AND b.month = p.month
        WHERE b.total - COALESCE(p.paid, 0) <> 0""",
    "credit": """SELECT s.contract_no, s.block_no, CAST(NULL AS VARCHAR) meter_no, s.name, s.joining_fee,
        COALESCE(s.joining_fee - SUM(m.amount), s.joining_fee) credit, CAST(NULL AS DATE) joined_on, CAST(NULL AS VARCHAR) address
        FROM subscriber s LEFT JOIN membership_payment m ON s.contract_no = m.contract_no
        GROUP BY s.contract_no, s.block_no, s.name, s.joining_fee""",
    "block_rows": """SELECT block_no, read_on, strftime(read_on, '%m-%Y') month_label, index_m3,
        index_m3 - COALESCE(LAG(index_m3) OVER (PARTITION BY block_no ORDER BY strftime(read_on, '%Y-%m')), 0) usage_m3 FROM block_reading""",
    "subscriber_rows": """SELECT q.contract_no, s.name, s.block_no, strftime(q.read_on, '%m-%Y') month_label, q.index_m3,
        q.index_m3 - COALESCE(LAG(q.index_m3) OVER (PARTITION BY q.contract_no ORDER BY strftime(q.read_on, '%Y-%m')), 0) usage_m3
        FROM meter_reading q JOIN subscriber s ON s.contract_no = q.contract_no""",
    "account": """SELECT c.month, strftime(c.month, '%B %Y') month_name, c.index_m3, c.amount_due, c.invoice_no, p.paid_on, p.receipt_no, c.amount_due - COALESCE(p.amount, 0) credit
        FROM supplier_bill c LEFT JOIN supplier_payment p ON c.month = p.month""",
    "book": """SELECT contract_no id, paid_on moved_on, 'membership' reason, CAST(NULL AS DOUBLE) mgmt_fee, CAST(NULL AS DOUBLE) loss_fee, amount debit, CAST(NULL AS DOUBLE) credit FROM membership_payment
        UNION ALL SELECT contract_no, settled_on, 'consumption', mgmt_fee, loss_fee, amount, NULL FROM consumption_payment
        UNION ALL SELECT CAST(payment_id AS VARCHAR), paid_on, 'supplier', NULL, NULL, NULL, abs(amount) FROM supplier_payment
        UNION ALL SELECT CAST(job_id AS VARCHAR), done_on, 'maintenance', NULL, NULL, NULL, abs(worker_pay) FROM maintenance
        UNION ALL SELECT CAST(purchase_id AS VARCHAR), bought_on, 'material', NULL, NULL, NULL, abs(qty * unit_price) FROM purchase""",
    "cleaned": """SELECT *, CASE WHEN receipt_raw IS NULL OR length(receipt_raw) < 4 THEN '0' ELSE CAST(CAST(CAST(receipt_raw AS DOUBLE) AS BIGINT) AS VARCHAR) END receipt_no,
        last_value(TRY_CAST(due_raw AS DATE) IGNORE NULLS) OVER (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) filled,
        TRY_CAST(settled_fixed AS DATE) settled_on FROM (
            SELECT r.*, CASE WHEN f.row_no IS NOT NULL THEN f.settled_raw ELSE r.settled_raw END settled_fixed
            FROM raw_payment r LEFT JOIN payment_fixes f ON f.row_no = r.row_no
            WHERE contract_raw NOT LIKE 'Total%' AND amount IS NOT NULL AND amount <> 0) x""",
    "seen": """SELECT b.*, l.last_on, l.last_index FROM all_batch b LEFT JOIN (
        SELECT contract_no, MAX(read_on) last_on, arg_max(index_m3, read_on) last_index FROM older_reading GROUP BY 1) l ON l.contract_no = b.contract_no""",
    "membership_batch": """SELECT CAST(receipt_no AS BIGINT) submitted_seq, contract_no,
        CASE WHEN CAST(receipt_no AS BIGINT) % 11 = 0 THEN NULL ELSE receipt_no END receipt_no,
        CASE WHEN CAST(receipt_no AS BIGINT) % 3 = 0 THEN amount * 2 ELSE amount END amount, paid_on
        FROM (SELECT * REPLACE (amount + (CAST(receipt_no AS BIGINT) % 100) / 100.0e0 AS amount) FROM membership_payment) p WHERE CAST(receipt_no AS BIGINT) % 2 = 1""",
    "opening": """SELECT s.contract_no, COALESCE(s.joining_fee - SUM(m.amount), s.joining_fee) credit
        FROM subscriber s LEFT JOIN (SELECT * FROM membership_payment WHERE CAST(receipt_no AS BIGINT) % 2 = 0) m ON m.contract_no = s.contract_no
        GROUP BY s.contract_no, s.joining_fee""",
    "candidates": """SELECT b.* REPLACE (CAST(ROUND(b.amount, 2) AS DECIMAL(18, 2)) AS amount), CAST(o.credit AS DECIMAL(18, 2)) credit, row_number() OVER (PARTITION BY b.contract_no ORDER BY submitted_seq) place
        FROM membership_batch b JOIN opening o ON o.contract_no = b.contract_no WHERE b.receipt_no IS NOT NULL AND o.credit IS NOT NULL""",
    "walk": """SELECT contract_no, place, submitted_seq, amount <= credit taken, CASE WHEN amount <= credit THEN credit - amount ELSE credit END remains
        FROM candidates WHERE place = 1
        UNION ALL SELECT c.contract_no, c.place, c.submitted_seq, c.amount <= w.remains, CASE WHEN c.amount <= w.remains THEN w.remains - c.amount ELSE w.remains END
        FROM walk w JOIN candidates c ON c.contract_no = w.contract_no AND c.place = w.place + 1""",
    "checked_readings": """SELECT s.submitted_seq, s.contract_no, s.index_m3, s.read_on,
        COALESCE((SELECT arg_max(e.index_m3, e.read_on) FROM all_batch e WHERE e.contract_no = s.contract_no AND e.submitted_seq < s.submitted_seq
            AND e.index_m3 >= 0 AND s.last_on IS NOT NULL AND e.read_on >= s.last_on), s.last_index) prev_index, 10.0e0 mgmt_fee, 5.0e0 loss_fee,
        CASE WHEN s.contract_no NOT IN (SELECT contract_no FROM known_contract) THEN 'unknown contract' WHEN s.index_m3 < 0 THEN 'negative index' WHEN s.last_on IS NULL THEN 'no earlier reading' END reason FROM seen s""",
    "new_subscribers": """SELECT c_custkey + again * 1000000000 submitted_seq, CAST(c_custkey AS VARCHAR) contract_no, CAST(c_nationkey AS VARCHAR) block_no,
        CASE WHEN c_custkey % 37 = 0 THEN '' ELSE c_name END AS name, ROUND(c_acctbal) joining_fee,
        CASE WHEN c_custkey % 37 = 0 OR c_name = '' THEN 'missing field' WHEN ROUND(c_acctbal) < 0 THEN 'negative fee'
            WHEN c_nationkey NOT BETWEEN 1 AND 15 THEN 'unknown block' WHEN c_custkey % 2 = 0 THEN 'contract exists' END own_reason
        FROM (SELECT *, 0 again FROM customer UNION ALL SELECT *, 1 FROM customer WHERE c_custkey % 10 = 1) c""",
}

LEDGER = "contract_no, month, settled_on, receipt_no, index_m3, qty_m3, base_amount, mgmt_fee, loss_fee, total, amount, credit"
MONTHLY = "SUM(base_amount) base_amount, SUM(mgmt_fee) mgmt_fee, SUM(loss_fee) loss_fee"
CASH = """COALESCE(SUM(mgmt_fee), 0) mgmt_total, COALESCE(SUM(loss_fee), 0) loss_total,
    COALESCE(SUM(debit - COALESCE(mgmt_fee, 0) - COALESCE(loss_fee, 0)), 0) debit_total, COALESCE(SUM(credit), 0) credit_total,
    COALESCE(SUM(debit - COALESCE(mgmt_fee, 0) - COALESCE(loss_fee, 0)), 0) + COALESCE(SUM(mgmt_fee), 0) + COALESCE(SUM(loss_fee), 0)
    - COALESCE(SUM(credit), 0) balance"""
CHECK_MONTH = """SELECT 'block' side, NULL contract_no, block_no, month_label, index_m3, usage_m3 FROM block_rows
    UNION ALL SELECT 'subscriber', contract_no, block_no, month_label, index_m3, usage_m3 FROM subscriber_rows"""
OFFICE = "SELECT CAST(contract AS VARCHAR) contract_no, receipt_no, amount, COALESCE(paid_on, DATE '2024-03-01') paid_on FROM raw_membership WHERE source = 0 AND contract IS NOT NULL"
COLLECTOR = "SELECT CAST(contract AS VARCHAR) contract_no, '0' receipt_no, amount, DATE '2024-03-01' paid_on FROM raw_membership WHERE source = 1 AND contract IS NOT NULL"
PREVIOUS = """SELECT CAST(o_custkey AS VARCHAR) contract_no, '0' receipt_no, ROUND(o_totalprice) amount, DATE '2023-12-31' paid_on
    FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 2 AND o_orderkey % 37 <> 0"""

QUERIES = {
    "bills": "SELECT * FROM bills",
    "dated_payments": "SELECT * FROM dated",
    "ledger": f"SELECT {LEDGER} FROM ledger",
    "ledger_filtered": f"SELECT {LEDGER} FROM ledger WHERE month = '1998-10' AND (qty_m3 IS NULL OR qty_m3 <> 0) AND (credit IS NULL OR credit <> 0)",
    "unpaid_bills": "SELECT * FROM unpaid",
    "unpaid_totals": "SELECT contract_no, SUM(remaining) credit_total, COUNT(DISTINCT month) months_unpaid FROM unpaid GROUP BY 1",
    "unpaid_bills_net": "SELECT * FROM unpaid_net",
    "unpaid_totals_net": "SELECT contract_no, SUM(remaining) credit_total, COUNT(DISTINCT month) months_unpaid FROM unpaid_net GROUP BY 1",
    "subscriber_credit": "SELECT * FROM credit",
    "subscribers_filtered": "SELECT * FROM credit WHERE credit > 0 AND block_no IN ('3', '4', '5')",
    "membership_credit": "SELECT contract_no, name, joining_fee, credit FROM credit",
    "membership_history": "SELECT contract_no, receipt_no, amount, paid_on FROM membership_payment",
    "last_reading": """SELECT contract_no, read_on last_read_on, strftime(read_on, '%m-%Y') month_label, index_m3 last_index
        FROM meter_reading r WHERE read_on = (SELECT MAX(x.read_on) FROM meter_reading x WHERE x.contract_no = r.contract_no)""",
    "last_block_reading": """SELECT block_no, read_on last_read_on, strftime(read_on, '%m-%Y') month_label, index_m3 last_index
        FROM block_reading r WHERE read_on = (SELECT MAX(x.read_on) FROM block_reading x WHERE x.block_no = r.block_no)""",
    "block_usage": "SELECT block_no, read_on, month_label, index_m3, usage_m3 FROM block_rows",
    "usage_by_lag": """SELECT contract_no, strftime(read_on, '%Y-%m') AS month, read_on, index_m3, COALESCE(index_m3 - lagged, index_m3) qty_m3,
        COALESCE(index_m3 - lagged, index_m3) * 7 amount
        FROM (SELECT *, LAG(index_m3) OVER (PARTITION BY contract_no ORDER BY read_on) lagged FROM meter_reading) x""",
    # the month is filtered first: one reading per key is left, so nothing comes before it
    "block_check_month": """SELECT 'block' side, NULL contract_no, block_no, '07-1997' month_label, index_m3, index_m3 usage_m3
        FROM block_reading WHERE strftime(read_on, '%m-%Y') = '07-1997'
        UNION ALL SELECT 'subscriber', q.contract_no, s.block_no, '07-1997', q.index_m3, q.index_m3
        FROM meter_reading q JOIN subscriber s ON s.contract_no = q.contract_no WHERE strftime(q.read_on, '%m-%Y') = '07-1997'""",
    "block_check_all": CHECK_MONTH,
    "block_check_lag_first": f"SELECT * FROM ({CHECK_MONTH}) c WHERE month_label = '07-1997'",
    "block_check_totals": """SELECT b.block_no, COALESCE(b.i, 0) block_index_m3, COALESCE(s.u, 0) subscriber_usage_m3
        FROM (SELECT block_no, SUM(index_m3) i FROM block_rows GROUP BY 1) b
        LEFT JOIN (SELECT block_no, SUM(usage_m3) u FROM subscriber_rows GROUP BY 1) s ON s.block_no = b.block_no""",
    "block_gap": """SELECT b.block_no, b.month_label, b.usage_m3 block_usage_m3, COALESCE(s.u, 0) subscriber_usage_m3, b.usage_m3 - COALESCE(s.u, 0) gap_m3
        FROM block_rows b LEFT JOIN (SELECT block_no, month_label, SUM(usage_m3) u FROM subscriber_rows GROUP BY 1, 2) s
        ON s.block_no = b.block_no AND s.month_label = b.month_label""",
    "stock_fanout": """SELECT p.product, COALESCE(SUM(pa.qty), 0) - COALESCE(SUM(pu.qty), 0) stock FROM product p
        LEFT JOIN purchase pa ON p.product = pa.product LEFT JOIN product_use pu ON p.product = pu.product GROUP BY p.product""",
    "stock_on_hand": """SELECT product, stock, CAST(trunc(stock) AS BIGINT) stock_units FROM (SELECT p.product,
        COALESCE((SELECT SUM(qty) FROM purchase a WHERE a.product = p.product), 0)
        - COALESCE((SELECT SUM(qty) FROM product_use u WHERE u.product = p.product), 0) stock FROM product p) x""",
    "stock_with_maintenance": """SELECT product, stock, CAST(trunc(stock) AS BIGINT) stock_units FROM (SELECT p.product,
        COALESCE((SELECT SUM(qty) FROM purchase a WHERE a.product = p.product), 0)
        - COALESCE((SELECT SUM(qty) FROM product_use u WHERE u.product = p.product), 0)
        - COALESCE((SELECT SUM(qty) FROM maintenance_detail d WHERE d.product = p.product), 0) stock FROM product p) x""",
    "purchase_history": "SELECT product, bought_on, qty, unit_price, qty * unit_price amount, receipt_no, vendor FROM purchase",
    "use_history": "SELECT product, used_on, qty, note FROM product_use",
    "supplier_account": "SELECT * FROM account",
    "supplier_totals": "SELECT SUM(credit) credit_total, COUNT(*) FILTER (receipt_no IS NULL) months_unpaid FROM account",
    "supplier_account_net": """SELECT b.month, b.amount_due, COALESCE(p.paid, 0) paid, b.amount_due - COALESCE(p.paid, 0) credit
        FROM supplier_bill b LEFT JOIN (SELECT month, SUM(amount) paid FROM supplier_payment GROUP BY 1) p ON p.month = b.month""",
    "maintenance_history": """SELECT m.job_id, m.done_on, m.note, m.worker, m.worker_pay, d.product, d.qty
        FROM maintenance m JOIN maintenance_detail d ON m.job_id = d.job_id WHERE strftime(m.done_on, '%m') = '07'""",
    "maintenance_history_year": """SELECT m.job_id, m.done_on, m.note, m.worker, m.worker_pay, d.product, d.qty
        FROM maintenance m JOIN maintenance_detail d ON m.job_id = d.job_id WHERE strftime(m.done_on, '%Y-%m') = '1998-07'""",
    "cash_book": "SELECT * FROM book",
    "cash_totals": f"SELECT {CASH} FROM book",
    "cash_totals_text": "SELECT " + ", ".join(f"format('{{:,.2f}}', {c}) {c}" for c in "mgmt_total loss_total debit_total credit_total balance".split())
    + f" FROM (SELECT {CASH} FROM book) t",
    "cash_filtered": "SELECT * FROM book WHERE year(moved_on) = 1997 AND month(moved_on) = 7",
    "cash_filtered_totals": f"SELECT {CASH} FROM book WHERE year(moved_on) = 1997 AND reason = 'consumption'",
    "cash_years": "SELECT DISTINCT CAST(year(moved_on) AS INT) AS year FROM book",
    "cash_reasons": "SELECT DISTINCT reason FROM book",
    "monthly_amounts": f"""SELECT month_label, base_amount, mgmt_fee, loss_fee, paid, credit, base_amount + mgmt_fee + loss_fee due FROM (
        SELECT substr(month, 6, 2) || '-' || substr(month, 1, 4) month_label, {MONTHLY.replace('SUM(base_amount)', 'COALESCE(SUM(base_amount), 0)')},
        COALESCE(SUM(amount), 0) paid, COALESCE(SUM(credit), 0) credit FROM ledger GROUP BY 1) x""",
    "monthly_amounts_net": f"""SELECT month, base_amount, mgmt_fee, loss_fee, paid, credit, base_amount + mgmt_fee + loss_fee due FROM (
        SELECT month, {MONTHLY.replace('SUM(base_amount)', 'COALESCE(SUM(base_amount), 0)')}, COALESCE(SUM(paid), 0) paid,
        COALESCE(SUM(total - COALESCE(paid, 0)), 0) credit
        FROM bills b LEFT JOIN (SELECT contract_no c, month m, SUM(amount) paid FROM dated GROUP BY 1, 2) p ON c = contract_no AND m = month GROUP BY 1) x""",
    "usage_series": """SELECT contract_no, substr(month, 6, 2) || '-' || substr(month, 1, 4) month_label, COALESCE(SUM(qty_m3), 0) qty_m3
        FROM ledger GROUP BY 1, 2""",
    "contracts": "SELECT DISTINCT contract_no FROM meter_reading",
    "invoices": """SELECT r.contract_no, c.name, DATE '2024-12-31' invoice_date, r.month, ROUND(c.credit, 2) membership_credit,
        ROUND(c.credit / 2, 2) membership_to_pay, ROUND(r.total, 2) consumption_credit, ROUND(r.total / 2, 2) consumption_to_pay,
        ROUND(c.credit + r.total, 2) credit_total, ROUND(c.credit / 2 + r.total / 2, 2) to_pay_total, r.qty qty_m3, 10.0e0 mgmt_fee, 5.0e0 loss_fee,
        ROUND(r.qty * 7 + 15, 2) amount_due, 'facture_' || r.contract_no || '_' || r.month file_name
        FROM (SELECT f.contract_no, f.month, f.total, (SELECT SUM(u.qty_m3) FROM unpaid u WHERE u.contract_no = f.contract_no AND u.month = f.month) qty
            FROM (SELECT contract_no, MIN(month) AS month, SUM(remaining) total FROM unpaid GROUP BY 1) f) r
        JOIN credit c ON c.contract_no = r.contract_no""",
    "import_subscribers": "SELECT contract_no, name, joining_fee FROM subscriber",
    "import_index_sheet": """WITH sheet AS (SELECT contract_no, read_on, index_m3, year(read_on) + CASE WHEN month(read_on) = 12 THEN 1 ELSE 0 END y FROM meter_reading),
        cells AS (SELECT c.contract_no || '/' || c.y contract_no, m.k, m.day, COALESCE(MAX(r.index_m3), 0) index_m3
            FROM (SELECT DISTINCT contract_no, y FROM sheet) c
            JOIN (SELECT k, CAST(DATE '2023-12-01' + to_months(k) AS DATE) AS day FROM (SELECT unnest(range(0, 12)) k) n) m ON true
            LEFT JOIN sheet r ON r.contract_no = c.contract_no AND r.y = c.y AND month(r.read_on) = month(m.day) GROUP BY 1, 2, 3)
        SELECT contract_no, day read_on, index_m3, LAG(index_m3) OVER (PARTITION BY contract_no ORDER BY k) prev_index,
        CASE WHEN k < 3 THEN 0.0e0 ELSE 10.0e0 END mgmt_fee, CASE WHEN k < 7 THEN 0.0e0 ELSE 5.0e0 END loss_fee FROM cells""",
    "backfill_prev_index": """SELECT contract_no, read_on, index_m3, (SELECT p.index_m3 FROM meter_reading p WHERE p.contract_no = r.contract_no
        AND strftime(p.read_on, '%Y-%m') < strftime(r.read_on, '%Y-%m') ORDER BY p.read_on DESC LIMIT 1) prev_index, mgmt_fee, loss_fee FROM meter_reading r""",
    "apply_corrections": """SELECT contract_no, read_on, index_m3, CASE WHEN fix IS NULL THEN prev_index ELSE fix.v END prev_index, mgmt_fee, loss_fee FROM (
        SELECT r.*, (SELECT arg_max(struct_pack(v := f.prev_index), f.seq) FROM reading_fixes f
            WHERE f.contract_no = r.contract_no AND (f.index_m3 = r.index_m3 OR f.read_on = r.read_on)) fix FROM meter_reading r) x""",
    "clean_payments": """SELECT contract_raw contract_no, receipt_no, amount, filled due_on, settled_on, COALESCE(mgmt_fee, 0) mgmt_fee,
        COALESCE(loss_fee, 0) loss_fee FROM cleaned WHERE amount <> -16831""",
    "forward_fill": """SELECT row_no, contract_raw, last_value(CAST(due_raw AS DATE) IGNORE NULLS) OVER (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) due_on
        FROM raw_payment""",
    "forward_fill_by_contract": """SELECT row_no, contract_raw, last_value(CAST(due_raw AS DATE) IGNORE NULLS) OVER (PARTITION BY contract_raw ORDER BY row_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) due_on FROM raw_payment""",
    "import_wide_payments": """SELECT contract_no, receipt_no, amount, CAST(make_date(2024, m, 1) AS DATE) due_on, settled_on,
        10.0e0 mgmt_fee, 0.0e0 loss_fee FROM wide_payment WHERE amount IS NOT NULL AND settled_on IS NOT NULL""",
    "ledger_contracts": f"SELECT {LEDGER} FROM ledger WHERE contract_no IN ('4', '7', '10', '13', '100', '1000')",
    "ledger_receipts": f"""SELECT {LEDGER} FROM ledger WHERE CAST(receipt_no AS BIGINT) BETWEEN 1 AND 2000 AND (qty_m3 IS NULL OR qty_m3 <> 0)""",
    "unpaid_bills_contracts": "SELECT * FROM unpaid WHERE contract_no IN ('4', '7', '10', '13', '100', '1000')",
    "subscribers_settled": "SELECT * FROM credit WHERE credit = 0",
    "subscribers_chosen": "SELECT * FROM credit WHERE contract_no IN ('4', '7', '10', '13', '100', '1000')",
    "membership_history_text": "SELECT contract_no, receipt_no, amount, paid_on FROM membership_payment",
    "import_membership_first": """SELECT CAST(contract AS VARCHAR) contract_no, receipt_no, amount, COALESCE(paid_on, DATE '2024-03-01') paid_on
        FROM (SELECT * FROM raw_membership ORDER BY row_no LIMIT 256) r WHERE source = 0 AND contract IS NOT NULL""",
    "stock_of_known_products": """SELECT product, stock, CAST(trunc(stock) AS BIGINT) stock_units FROM (SELECT k.product,
        COALESCE((SELECT SUM(qty) FROM purchase a WHERE CAST(a.product AS BIGINT) % 11 = k.place), 0)
        - COALESCE((SELECT SUM(qty) FROM product_use u WHERE CAST(u.product AS BIGINT) % 11 = k.place), 0) stock
        FROM (VALUES ('Compteur', 0), ('Pompe', 1), ('Filtre', 2), ('Réservoir', 3), ('Tuyau irrigation', 4), ('Capteur de niveau', 5),
        ('Vanne à bille', 6), ('Distributeur', 7), ('Adoucisseur', 8), ('Kit de traitement', 9), ('Divers', 10)) k(product, place)) x""",
    "supplier_totals_early": """SELECT COALESCE(SUM(credit), 0.0e0) credit_total, COUNT(*) FILTER (receipt_no IS NULL) months_unpaid
        FROM account WHERE month < DATE '1990-01-01'""",
    "strict_reading_load": "SELECT * FROM meter_reading",
    "table_copies": """SELECT contract_no, COUNT(*) payments, SUM(amount) amount, COUNT(*) * 15.0e0 fees FROM consumption_payment GROUP BY 1""",
    "payment_sheet_files": """SELECT row_number() OVER (ORDER BY row_no) - 1 row_no, contract_raw, due_raw, settled_raw, receipt_raw, amount FROM raw_payment""",
    "table_round_trip": """SELECT contract_no, COUNT(*) n_readings, SUM(index_m3) index_sum, MAX(read_on) last_read_on FROM (
        SELECT contract_no, read_on, CASE WHEN year(read_on) = 1997 THEN index_m3 + 1 ELSE index_m3 END index_m3 FROM meter_reading
        UNION ALL SELECT 'X' || contract_no, read_on, index_m3 FROM meter_reading WHERE year(read_on) >= 1999) x GROUP BY 1""",
    "import_membership_office": OFFICE,
    "import_membership_collector": COLLECTOR,
    "import_membership_previous": PREVIOUS,
    "load_memberships": f"{OFFICE} UNION ALL {COLLECTOR} UNION ALL {PREVIOUS}",
    "profile_nulls": " UNION ALL ".join(
        f"SELECT '{name}' column_name, COUNT(*) FILTER ({column} IS NULL) null_count FROM raw_payment"
        for name, column in (
            ("row_no", "row_no"),
            ("contract_raw", "contract_raw"),
            ("due_raw", "due_raw"),
            ("settled_raw", "settled_raw"),
            ("receipt_raw", "receipt_raw"),
            ("mgmt_raw", "mgmt_fee"),
            ("loss_raw", "loss_fee"),
            ("amount_raw", "amount"),
        )
    ),
    "rows_per_contract": "SELECT contract_raw, COUNT(*) row_count FROM raw_payment GROUP BY 1",
    "suspicious_rows": """SELECT row_no, contract_raw, settled_raw, receipt_raw, amount, short_date, marked_date, short_receipt, empty_row FROM (SELECT *,
        settled_raw IS NOT NULL AND length(settled_raw) < 4 short_date, settled_raw IS NOT NULL AND settled_raw IN ('NR', ',') marked_date,
        receipt_raw IS NULL OR length(receipt_raw) < 4 short_receipt, (receipt_raw IS NULL OR length(receipt_raw) < 4)
        AND TRY_CAST(settled_raw AS DATE) IS NULL AND amount IS NOT NULL AND amount = 0 empty_row FROM raw_payment) x
        WHERE short_date OR marked_date OR short_receipt OR empty_row""",
    "check_subscribers": """SELECT submitted_seq, contract_no, name, joining_fee, COALESCE(own_reason, CASE WHEN EXISTS (SELECT 1 FROM new_subscribers e
        WHERE e.contract_no = n.contract_no AND e.own_reason IS NULL AND e.submitted_seq < n.submitted_seq) THEN 'contract repeated in batch' END) reason
        FROM new_subscribers n""",
    "check_readings": """SELECT submitted_seq, contract_no, index_m3, read_on, prev_index, mgmt_fee, loss_fee, reason FROM checked_readings""",
    "check_membership_payments": """SELECT b.submitted_seq, b.contract_no, b.receipt_no, b.amount, b.paid_on,
        CASE WHEN b.receipt_no IS NULL THEN 'missing field' WHEN o.credit IS NULL THEN 'no credit known' WHEN NOT w.taken THEN 'amount exceeds credit' END reason
        FROM membership_batch b LEFT JOIN opening o ON o.contract_no = b.contract_no LEFT JOIN walk w ON w.submitted_seq = b.submitted_seq""",
    "check_consumption_payments": """SELECT contract_no, receipt_no, amount, due_on, settled_on, 10.0e0 mgmt_fee, 5.0e0 loss_fee,
        CASE WHEN contract_no NOT IN (SELECT contract_no FROM subscriber) THEN 'unknown contract' WHEN amount < 0 THEN 'negative amount'
            WHEN CAST(receipt_no AS BIGINT) NOT BETWEEN 1 AND 200 THEN 'receipt out of range' END reason FROM payment_batch""",
    "check_block_readings": """SELECT block_no, read_on, index_m3, CASE WHEN CAST(block_no AS INT) NOT BETWEEN 1 AND 15 THEN 'unknown block' END reason FROM block_reading""",
    "check_purchases": """SELECT product, bought_on, CASE WHEN purchase_id % 7 = 0 THEN 0.0e0 ELSE qty END qty, unit_price, receipt_no,
        CASE WHEN purchase_id % 9 = 0 THEN '' ELSE vendor END vendor, CASE WHEN purchase_id % 7 = 0 THEN 0.0e0 ELSE qty * unit_price END amount,
        CASE WHEN purchase_id % 7 = 0 OR purchase_id % 9 = 0 OR unit_price = 0 THEN 'missing field'
            WHEN product NOT IN (SELECT product FROM product) THEN 'unknown product' END reason FROM listed_purchase""",
    "check_uses": """SELECT CASE WHEN CAST(product AS BIGINT) % 13 = 0 THEN 'odd ' || product ELSE product END product, used_on,
        CASE WHEN CAST(product AS BIGINT) % 7 = 0 THEN 0.0e0 ELSE qty END qty, CASE WHEN CAST(product AS BIGINT) % 11 = 0 THEN '' ELSE note END note,
        CASE WHEN CAST(product AS BIGINT) % 7 = 0 OR CAST(product AS BIGINT) % 11 = 0 THEN 'missing field'
            WHEN CAST(product AS BIGINT) % 13 = 0 THEN 'unknown product' END reason FROM product_use""",
    "split_maintenance_jobs": """SELECT 1000 + row_number() OVER (ORDER BY job_id) job_id, done_on, note, worker, worker_pay FROM maintenance m
        WHERE EXISTS (SELECT 1 FROM maintenance_detail d WHERE d.job_id = m.job_id) AND job_id NOT IN (SELECT job_id FROM unlisted_jobs)""",
    "split_maintenance_items": """SELECT 5000 + row_number() OVER (ORDER BY d.job_id, d.product, d.qty) detail_id, j.new_id job_id, d.product, d.qty FROM maintenance_detail d JOIN (
        SELECT job_id, 1000 + row_number() OVER (ORDER BY job_id) new_id FROM maintenance m
        WHERE EXISTS (SELECT 1 FROM maintenance_detail x WHERE x.job_id = m.job_id) AND job_id NOT IN (SELECT job_id FROM unlisted_jobs)) j ON j.job_id = d.job_id""",
    "split_maintenance_rejected": """SELECT job_id submitted_seq, done_on, note, worker, worker_pay,
        CASE WHEN job_id IN (SELECT job_id FROM unlisted_jobs) THEN 'unknown product' ELSE 'no material' END reason FROM maintenance m
        WHERE NOT EXISTS (SELECT 1 FROM maintenance_detail d WHERE d.job_id = m.job_id) OR job_id IN (SELECT job_id FROM unlisted_jobs)""",
    "check_supplier_bills": """SELECT month, index_m3, CASE WHEN month(month) % 5 = 0 THEN 0.0e0 ELSE amount_due END amount_due, invoice_no,
        CASE WHEN month(month) % 5 = 0 OR amount_due = 0 THEN 'missing field' END reason FROM supplier_bill""",
    "check_supplier_payments": """SELECT month, amount, CASE WHEN month(month) % 7 = 0 THEN '' ELSE receipt_no END receipt_no, paid_on,
        CASE WHEN month(month) % 7 = 0 OR amount = 0 THEN 'missing field' END reason FROM supplier_payment""",
}
QUERIES["invoice_files"] = QUERIES["invoices"]


def sql(name: str) -> str:
    """The query with the CTEs it needs, in dependency order."""
    body = QUERIES[name]
    inner = body[len("WITH ") :] if body.startswith("WITH ") else None
    needed = _needed(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{cte} AS ({CTES[cte]})" for cte in needed)
    start = "WITH RECURSIVE" if "walk" in needed else "WITH"
    return f"{start} {ctes},\n{inner}" if inner else f"{start} {ctes}\n{body}"


def _needed(text: str) -> list[str]:
    """CTEs named in a text and, before each, those it builds on."""
    found: list[str] = []
    for cte in CTES:
        if CTES[cte] != text and re.search(rf"\b(FROM|JOIN)\s+{cte}\b", text):
            for inner in [*_needed(CTES[cte]), cte]:
                if inner not in found:
                    found.append(inner)
    return found
