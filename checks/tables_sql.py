"""The test tables' mapping (FIXTURES.md, part C) as SQL, written apart from the
DataFrame form in ``checks.testbed``."""

from tillbook.schema import table_schema

AS_OF = "TIMESTAMP '2001-07-31 12:00:00'"

TABLES = {
    "shop_customers": """
        SELECT c_custkey AS customer_id, 'FirstName' || c_custkey AS first_name, 'LastName' || c_custkey AS last_name,
               'customer' || c_custkey || '@example.com' AS email,
               '555-' || lpad(c_custkey::VARCHAR, 7, '0') AS phone, NULL::VARCHAR AS address,
               'City' || (c_custkey % 50) AS city, 'State' || (c_custkey % 50) AS state,
               (c_custkey % 1000)::VARCHAR AS zip_code, 'USA' AS country,
               TIMESTAMP '2001-07-31 06:00:00' - to_days((c_custkey % 2405)::INT) AS created_at,
               TIMESTAMP '2001-07-31 06:00:00' - to_days((c_custkey % 2405)::INT) AS updated_at,
               (c_custkey * 100) % 10000 AS loyalty_points,
               CASE WHEN c_custkey % 10 = 0 THEN 'PREMIUM' ELSE 'REGULAR' END AS customer_type
        FROM customer""",
    "shop_products": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS subcategory,
               NULL::VARCHAR AS description, p_retailprice::DECIMAL(10,2) AS price,
               round(p_retailprice::DECIMAL(10,2) * 0.5, 2)::DECIMAL(10,2) AS cost,
               NULL::DECIMAL(10,3) AS weight, NULL::VARCHAR AS dimensions,
               'Manufacturer#' || (p_partkey % 5) AS manufacturer,
               'SKU-' || lpad(p_partkey::VARCHAR, 8, '0') AS sku, NULL::TIMESTAMP AS created_at,
               CASE WHEN p_partkey % 25 = 0 THEN 0 ELSE 1 END AS is_active
        FROM part""",
    "shop_stock": """
        SELECT 2 * p_partkey + w AS inventory_id, p_partkey AS product_id, 'WH-' || ((p_partkey + w) % 5) AS warehouse_location,
               CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 120 ELSE 1000 + (p_partkey * 137) % 5000 END AS quantity_available,
               (3 * p_partkey) % 50 AS quantity_reserved, 100::BIGINT AS reorder_level,
               NULL::TIMESTAMP AS last_restock_date, NULL::TIMESTAMP AS updated_at
        FROM part, (VALUES (0), (1)) places(w) WHERE w = 0 OR p_partkey % 3 = 0""",
    "shop_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS order_date,
               CASE o_orderstatus
                 WHEN 'F' THEN ['COMPLETED', 'SHIPPED', 'DELIVERED'][o_orderkey % 3 + 1]
                 WHEN 'O' THEN ['PENDING', 'PROCESSING'][o_orderkey % 2 + 1]
                 ELSE ['CANCELLED', 'PAYMENT_FAILED', 'COMPLETED', 'COMPLETED'][o_orderkey % 4 + 1] END AS status,
               CASE WHEN o_orderkey % 50 <> 3 THEN o_totalprice::DECIMAL(12,2) END AS total_amount,
               round(CASE WHEN o_orderkey % 50 <> 3 THEN o_totalprice::DECIMAL(12,2) END * 0.08, 2)::DECIMAL(10,2) AS tax_amount,
               CASE WHEN o_orderkey % 4 <> 0 THEN ((o_orderkey % 2000)::DECIMAL(8,0) * 0.01)::DECIMAL(8,2) END AS shipping_cost,
               ['CREDIT_CARD', 'DEBIT_CARD', 'PAYPAL', 'BANK_TRANSFER'][o_orderkey % 4 + 1] AS payment_method,
               NULL::VARCHAR AS shipping_address, NULL::VARCHAR AS tracking_number,
               o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS created_at,
               o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS updated_at
        FROM orders WHERE o_custkey % 50 <> 7""",
    "shop_items": """
        SELECT ('0x' || md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 100)::BIGINT,
                 round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, l_returnflag,
                 l_linestatus, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)))[1:15])::BIGINT AS order_item_id,
               l_orderkey AS order_id, l_partkey AS product_id, l_quantity::BIGINT AS quantity,
               (((2 * round(100 * l_extendedprice)::BIGINT + l_quantity::BIGINT) // (2 * l_quantity::BIGINT))::DECIMAL(18,0)
                 * 0.01)::DECIMAL(10,2) AS unit_price,
               round(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2), 2)::DECIMAL(12,2) AS discount,
               l_extendedprice::DECIMAL(12,2) AS subtotal
        FROM lineitem
        WHERE l_partkey % 40 <> 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 <> 7)""",
    "shop_payments": """
        SELECT 2 * order_id AS transaction_id, order_id, 'PAYMENT' AS transaction_type, total_amount AS amount,
               'USD' AS currency, ['Stripe', 'PayPal', 'Square', 'Authorize.Net', 'Braintree'][order_id % 5 + 1] AS payment_gateway,
               NULL::VARCHAR AS gateway_transaction_id,
               CASE WHEN order_id % 20 = 0 THEN 'FAILED' WHEN order_id % 7 = 0 THEN 'PENDING' ELSE 'COMPLETED' END AS status,
               order_date + INTERVAL 1 HOUR AS processed_at, NULL::VARCHAR AS error_message
        FROM shop_orders WHERE order_id % 10 <> 9
        UNION ALL
        SELECT 2 * order_id + 1, order_id, 'REFUND', -total_amount, 'USD',
               ['Stripe', 'PayPal', 'Square', 'Authorize.Net', 'Braintree'][order_id % 5 + 1], NULL, 'COMPLETED',
               order_date + INTERVAL 2 DAY, NULL
        FROM shop_orders WHERE order_id % 17 = 0""",
    "shop_sessions": """
        SELECT user_id || '-' || strftime(ts::DATE, '%Y%m%d') AS session_id, user_id AS customer_id,
               min(ts) AS login_time, max(ts) AS last_activity, NULL::VARCHAR AS ip_address, NULL::VARCHAR AS user_agent,
               NULL::VARCHAR AS session_data,
               CASE WHEN user_id % 5 = 0 AND bool_or(event_type = 'error') THEN 0 ELSE 1 END AS is_active
        FROM events GROUP BY user_id, ts::DATE""",
    "shop_audit": """
        SELECT order_id AS audit_id, 'ORDERS' AS table_name, 'INSERT' AS operation, order_id AS record_id,
               NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value, 'SYSTEM' AS changed_by, order_date AS changed_at
        FROM shop_orders""",
    "old_summary": """
        SELECT DISTINCT order_date::DATE AS summary_date, 0 AS total_orders, 0::DECIMAL(15,2) AS total_revenue,
               0 AS total_customers, 0::DECIMAL(10,2) AS avg_order_value, order_date::DATE::TIMESTAMP AS created_at
        FROM shop_orders WHERE order_date::DATE BETWEEN DATE '2001-07-21' AND DATE '2001-07-28'""",
    "old_analytics": """
        SELECT customer_id, 0 AS total_orders, 0::DECIMAL(12,2) AS total_spent, 0::DECIMAL(10,2) AS avg_order_value,
               NULL::TIMESTAMP AS last_order_date, 'New' AS customer_segment, created_at AS calculated_at
        FROM shop_customers WHERE customer_id % 2 = 0""",
    "old_performance": """
        SELECT product_id, p.period_start, last_day(p.period_start) AS period_end, 0 AS units_sold, 0::DECIMAL(12,2) AS revenue,
               0::DECIMAL(12,2) AS profit, 0 AS return_count, p.period_start::TIMESTAMP AS calculated_at
        FROM shop_products, (VALUES (3, DATE '2001-07-01'), (5, DATE '2001-06-01')) p(step, period_start)
        WHERE product_id % p.step = 0""",
    "old_recommendation": """
        SELECT product_id, 0 AS recommendation_score, TIMESTAMP '2001-07-01' AS last_analyzed
        FROM shop_products WHERE product_id % 3 = 0""",
    "want_stock": """
        SELECT product_id, sum(product_id % 90 + turn * 10)::BIGINT AS quantity,
               sum(CASE WHEN product_id % 33 = 0 THEN product_id % 200 - 5000 ELSE product_id % 100 - 50 END + turn)::BIGINT
                 AS adjustment
        FROM shop_products, (VALUES (1), (2)) turns(turn)
        WHERE product_id % 11 = 0 AND (turn = 1 OR product_id % 22 = 0) GROUP BY product_id""",
    "want_points": """
        SELECT customer_id, sum(customer_id % 70 + turn * 5)::BIGINT AS points
        FROM shop_customers, (VALUES (1), (2)) turns(turn)
        WHERE customer_id % 11 = 0 AND (turn = 1 OR customer_id % 22 = 0) GROUP BY customer_id""",
    "want_orders": "SELECT order_id FROM shop_orders WHERE order_id % 7 = 0",
    "ordered_units": """
        SELECT product_id, sum(quantity)::BIGINT AS units FROM shop_items
        WHERE order_id IN (SELECT order_id FROM want_orders) GROUP BY product_id""",
    "want_lines": """
        SELECT (SELECT max(order_id) FROM shop_orders) + 1 + l_orderkey AS order_id, o_custkey AS customer_id,
               ['CREDIT_CARD', 'DEBIT_CARD', 'PAYPAL', 'BANK_TRANSFER'][l_orderkey % 4 + 1] AS payment_method,
               l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS product_id,
               l_quantity::BIGINT AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 100 = 0""",
}

# Columns of a table version, in the types both engines hand over alike.
_MONEY = {
    "orders": ("total_amount", "tax_amount", "shipping_cost"),
    "order_items": ("unit_price", "discount", "subtotal"),
    "transactions": ("amount",),
    "products": ("price", "cost", "weight"),
    "sales_summary": ("total_revenue", "avg_order_value"),
    "customer_analytics": ("total_spent", "avg_order_value"),
    "product_performance": ("revenue", "profit"),
}
_DATES = {"sales_summary": ("summary_date",), "product_performance": ("period_start", "period_end")}


def columns(table: str, skip: tuple[str, ...] = (), **replaced: str) -> str:
    """Select list of all columns of a table; ``replaced`` gives new expressions."""
    parts = []
    for field in table_schema(table).fields:
        name = field.name
        if name in skip:
            continue
        value = replaced.get(name, name)
        if name in _MONEY.get(table, ()):
            value = f"({value})::DOUBLE"
        elif name in _DATES.get(table, ()):
            value = f"({value})::VARCHAR"
        elif name == "transaction_id":
            value = f"({value})::DOUBLE"
        elif field.dataType.typeName() in ("long", "integer"):
            value = f"({value})::BIGINT"
        parts.append(f"{value} AS {name}")
    return ", ".join(parts)
