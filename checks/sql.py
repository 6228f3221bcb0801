"""SQL with the result each query must give, in DuckDB's dialect.

Written straight from the meaning of each report, with the joins that repeat
rows left in, so that it shares no shortcut with the DataFrame plans.
"""

from __future__ import annotations

import re

from checks.tables_sql import AS_OF, TABLES, columns

# Whole numbers some queries return as NULL; pandas shows them as floats.
NULLABLE_NUMBERS = ("transaction_id", "total_items")

SETTLED = "('COMPLETED', 'SHIPPED', 'DELIVERED')"


def with_tables(body: str) -> str:
    """Prefix ``body`` with the table mappings it uses."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(TABLES[name])

    need(body)
    mappings = ",\n".join(f"{name} AS ({TABLES[name]})" for name in TABLES if name in needed)
    if not mappings:
        return body
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {mappings},\n{body.removeprefix('WITH ')}"
    return f"WITH {mappings}\n{body}"


def ratio(numerator: str, denominator: str, scale: int, factor: str = "") -> str:
    quotient = f"({numerator})::DOUBLE / nullif(({denominator})::DOUBLE, 0)"
    if factor:
        quotient = f"({quotient}) * {factor}"
    return f"round(({quotient})::DECIMAL(28,8), {scale})::DOUBLE"


def mean(column: str, scale: int = 6) -> str:
    return ratio(f"sum({column})", f"count({column})", scale)


def dbl(value: str) -> str:
    return f"({value})::DOUBLE"


def big(value: str) -> str:
    return f"({value})::BIGINT"


def ago(interval: str) -> str:
    return f"{AS_OF} - INTERVAL {interval}"


def months_to_as_of(ts: str) -> str:
    """Months up to ``AS_OF``, which is a month end."""
    whole = f"(12 * (2001 - year({ts})) + 7 - month({ts}))"
    seconds = f"((31 - day({ts})) * 86400 + 43200 - (epoch({ts}) - epoch({ts}::DATE::TIMESTAMP)))"
    return f"CASE WHEN {ts}::DATE = last_day({ts}) THEN {whole}::DOUBLE ELSE {whole} + {seconds} / 2678400.0::DOUBLE END"


LAST_12_MONTHS = "TIMESTAMP '2000-07-31 12:00:00'"
LAST_6_MONTHS = "TIMESTAMP '2001-01-31 12:00:00'"
LAST_24_MONTHS = "TIMESTAMP '1999-07-31 12:00:00'"

_SALES = {
    "sales_daily_summary": f"""
        SELECT order_date::DATE::VARCHAR AS order_day, count(DISTINCT order_id) AS total_orders,
               count(DISTINCT customer_id) AS unique_customers, {dbl("sum(total_amount)")} AS revenue,
               {mean("total_amount")} AS avg_order_value, {big("sum(quantity)")} AS total_items_sold
        FROM shop_orders JOIN shop_items USING (order_id)
        WHERE order_date >= {ago("30 DAY")} GROUP BY 1""",
    "sales_monthly_trend": f"""
        SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS total_orders, {dbl("sum(total_amount)")} AS revenue,
               {mean("total_amount")} AS avg_order_value, count(DISTINCT customer_id) AS unique_customers,
               {ratio("sum(total_amount)", "count(DISTINCT customer_id)", 6)} AS revenue_per_customer
        FROM shop_orders WHERE order_date >= {LAST_12_MONTHS} GROUP BY 1""",
    "sales_by_category": f"""
        SELECT category, count(DISTINCT order_id) AS orders, {big("sum(quantity)")} AS units_sold,
               {dbl("sum(subtotal)")} AS revenue, {mean("unit_price")} AS avg_price,
               {dbl("sum(subtotal - quantity * cost)")} AS profit
        FROM shop_items JOIN shop_orders USING (order_id) JOIN shop_products USING (product_id)
        WHERE order_date >= {ago("30 DAY")} GROUP BY category""",
    "sales_top_products": f"""
        SELECT product_id, any_value(product_name) AS product_name, any_value(category) AS category,
               count(DISTINCT order_id) AS order_count, {big("sum(quantity)")} AS total_quantity_sold,
               {dbl("sum(subtotal)")} AS total_revenue, {mean("unit_price")} AS avg_selling_price,
               {dbl("sum(subtotal - quantity * cost)")} AS profit,
               {ratio("sum(subtotal - quantity * cost)", "sum(subtotal)", 2, "100")} AS profit_margin_pct
        FROM shop_items JOIN shop_orders USING (order_id) JOIN shop_products USING (product_id)
        WHERE order_date >= {ago("90 DAY")} AND status <> 'CANCELLED'
        GROUP BY product_id ORDER BY total_quantity_sold DESC, product_id LIMIT 20""",
    "sales_by_payment_method": f"""
        SELECT payment_method, count(*) AS transaction_count, {dbl("sum(total_amount)")} AS total_revenue,
               {mean("total_amount")} AS avg_transaction_value,
               count(*) FILTER (p.status = 'COMPLETED') AS successful_transactions,
               count(*) FILTER (p.status = 'FAILED') AS failed_transactions,
               {ratio("count(*) FILTER (p.status = 'COMPLETED')", "count(*)", 2, "100")} AS success_rate
        FROM shop_orders o LEFT JOIN shop_payments p USING (order_id)
        WHERE order_date >= {ago("30 DAY")} GROUP BY payment_method""",
    "sales_by_hour": f"""
        SELECT hour(order_date) AS hour_of_day, count(*) AS order_count, {dbl("sum(total_amount)")} AS revenue,
               {mean("total_amount")} AS avg_order_value
        FROM shop_orders WHERE order_date >= {ago("7 DAY")} GROUP BY 1""",
}

_SEGMENT = """CASE WHEN n >= 10 AND spent >= 1000 THEN 'VIP' WHEN n >= 5 AND spent >= 500 THEN 'Loyal'
                   WHEN n >= 2 THEN 'Regular' ELSE 'New' END"""

_CUSTOMERS = {
    "customer_segmentation": f"""
        WITH stats AS (SELECT customer_id, count(order_id) AS n, coalesce(sum(total_amount), 0) AS spent
                       FROM shop_customers LEFT JOIN shop_orders USING (customer_id) GROUP BY customer_id)
        SELECT {_SEGMENT} AS customer_segment, count(*) AS customer_count, {mean("spent")} AS avg_lifetime_value,
               {mean("n")} AS avg_order_count, {dbl("sum(spent)")} AS segment_revenue
        FROM stats GROUP BY 1""",
    "customer_lifetime_value": f"""
        SELECT customer_id, any_value(first_name || ' ' || last_name) AS customer_name,
               any_value(c.customer_type) AS customer_type, any_value(loyalty_points) AS loyalty_points,
               count(*) AS total_orders, {dbl("sum(total_amount)")} AS lifetime_value,
               {mean("total_amount")} AS avg_order_value, max(order_date) AS last_order_date,
               round(any_value({months_to_as_of("c.created_at")})::DECIMAL(28,8), 1)::DOUBLE AS customer_tenure_months,
               {ratio("sum(total_amount)", f"any_value({months_to_as_of('c.created_at')})", 2)} AS monthly_value
        FROM shop_customers c JOIN shop_orders o USING (customer_id)
        WHERE status IN {SETTLED} GROUP BY customer_id
        ORDER BY lifetime_value DESC NULLS LAST, customer_id LIMIT 100""",
    "customer_retention": f"""
        WITH active AS (SELECT DISTINCT date_trunc('month', order_date) AS m, customer_id
                        FROM shop_orders WHERE order_date >= {LAST_12_MONTHS})
        SELECT strftime(a.m, '%Y-%m') AS month, count(DISTINCT a.customer_id) AS customers_this_month,
               count(DISTINCT b.customer_id) AS customers_next_month,
               {ratio("count(DISTINCT b.customer_id)", "count(DISTINCT a.customer_id)", 2, "100")} AS retention_rate
        FROM active a LEFT JOIN active b ON a.customer_id = b.customer_id AND b.m = a.m + INTERVAL 1 MONTH
        GROUP BY 1""",
    "customer_high_value": f"""
        SELECT customer_id, any_value(email) AS email, any_value(c.customer_type) AS customer_type,
               count(*) AS order_count, {dbl("sum(total_amount)")} AS total_spent,
               {mean("total_amount")} AS avg_order_value, max(order_date) AS last_order_date,
               count(DISTINCT date_trunc('month', order_date)) AS active_months,
               {big("sum(quantity)")} AS total_items_purchased
        FROM shop_customers c JOIN shop_orders USING (customer_id) JOIN shop_items USING (order_id)
        WHERE status IN {SETTLED} GROUP BY customer_id
        ORDER BY total_spent DESC NULLS FIRST, customer_id LIMIT 50""",
    "customer_purchase_frequency": f"""
        WITH stats AS (SELECT customer_id, count(order_id) AS n, sum(total_amount) AS spent
                       FROM shop_customers LEFT JOIN shop_orders USING (customer_id) GROUP BY customer_id)
        SELECT CASE WHEN n >= 20 THEN '20+ orders' WHEN n >= 10 THEN '10-19 orders' WHEN n >= 5 THEN '5-9 orders'
                    WHEN n >= 2 THEN '2-4 orders' ELSE '1 order' END AS purchase_frequency_bucket,
               count(*) AS customer_count, {mean("n")} AS avg_orders, {mean("spent")} AS avg_revenue
        FROM stats GROUP BY 1""",
}

_PRODUCTS = {
    "product_performance": f"""
        SELECT product_id, any_value(product_name) AS product_name, any_value(category) AS category,
               any_value(price)::DOUBLE AS current_price, {big("coalesce(sum(quantity), 0)")} AS total_units_sold,
               {dbl("coalesce(sum(subtotal), 0)")} AS total_revenue,
               {dbl("coalesce(sum(quantity * cost), 0)")} AS total_cost,
               {dbl("coalesce(sum(subtotal) - sum(quantity * cost), 0)")} AS total_profit,
               coalesce({ratio("sum(subtotal) - sum(quantity * cost)", "sum(subtotal)", 2, "100")}, 0) AS profit_margin_pct,
               {big("coalesce(sum(quantity_available), 0)")} AS current_inventory,
               {big("coalesce(sum(quantity_reserved), 0)")} AS reserved_inventory,
               count(DISTINCT order_id) AS order_count
        FROM shop_products LEFT JOIN shop_items USING (product_id) LEFT JOIN shop_stock USING (product_id)
        WHERE is_active = 1 GROUP BY product_id""",
    "inventory_turnover": f"""
        WITH joined AS (
          SELECT product_id, any_value(product_name) AS product_name, any_value(category) AS category,
                 sum(quantity_available + quantity_reserved) AS held, sum(quantity) AS units
          FROM shop_products JOIN shop_stock USING (product_id) LEFT JOIN shop_items USING (product_id)
          WHERE is_active = 1 GROUP BY product_id),
        rated AS (SELECT *, coalesce(units::DOUBLE / nullif(held::DOUBLE, 0), 0) AS rate FROM joined)
        SELECT product_id, product_name, category, {big("held")} AS avg_inventory,
               {big("coalesce(units, 0)")} AS units_sold_90days,
               round(rate::DECIMAL(28,8), 2)::DOUBLE AS turnover_rate,
               round((90.0::DOUBLE / nullif(rate, 0))::DECIMAL(28,8), 1)::DOUBLE AS days_to_turnover
        FROM rated""",
    "slow_moving_products": f"""
        SELECT product_id, any_value(product_name) AS product_name, any_value(category) AS category,
               any_value(price)::DOUBLE AS price, {big("sum(quantity_available)")} AS inventory_on_hand,
               {big("coalesce(sum(quantity), 0)")} AS units_sold_60days,
               {dbl("sum(quantity_available) * any_value(cost)")} AS inventory_value,
               {ratio("60", "coalesce(sum(quantity), 0)", 1)} AS days_per_sale
        FROM shop_products JOIN shop_stock USING (product_id) LEFT JOIN shop_items USING (product_id)
        WHERE is_active = 1 AND quantity_available > 100
        GROUP BY product_id HAVING coalesce(sum(quantity), 0) < 10""",
    "profit_margin_by_category": f"""
        SELECT category, count(DISTINCT product_id) AS product_count, count(DISTINCT order_id) AS order_count,
               {big("sum(quantity)")} AS total_units_sold, {dbl("sum(subtotal)")} AS total_revenue,
               {dbl("sum(quantity * cost)")} AS total_cost, {dbl("sum(subtotal) - sum(quantity * cost)")} AS total_profit,
               {ratio("sum(subtotal) - sum(quantity * cost)", "sum(subtotal)", 2, "100")} AS profit_margin_pct,
               {mean("price", 2)} AS avg_price,
               {ratio("sum(subtotal) - sum(quantity * cost)", "count(DISTINCT product_id)", 2)} AS profit_per_product
        FROM shop_items JOIN shop_orders USING (order_id) JOIN shop_products USING (product_id)
        WHERE order_date >= {ago("90 DAY")} AND status IN {SETTLED} GROUP BY category""",
    "product_affinity": f"""
        WITH sold AS (SELECT order_id, product_id, product_name, subtotal
                      FROM shop_items JOIN shop_orders USING (order_id) JOIN shop_products USING (product_id)
                      WHERE order_date >= {ago("60 DAY")})
        SELECT a.product_name AS product_1, b.product_name AS product_2,
               count(DISTINCT a.order_id) AS times_bought_together, {mean("a.subtotal + b.subtotal", 2)} AS avg_combined_value
        FROM sold a JOIN sold b ON a.order_id = b.order_id AND a.product_id < b.product_id
        GROUP BY 1, 2 HAVING count(DISTINCT a.order_id) >= 3
        ORDER BY times_bought_together DESC, product_1, product_2 LIMIT 50""",
    "product_revenue_growth": f"""
        WITH monthly AS (SELECT product_id, any_value(product_name) AS product_name,
                                date_trunc('month', order_date)::DATE AS m, sum(subtotal) AS revenue
                         FROM shop_items JOIN shop_orders USING (order_id) JOIN shop_products USING (product_id)
                         WHERE order_date >= {LAST_6_MONTHS} GROUP BY product_id, m)
        SELECT now.product_name, strftime(now.m, '%Y-%m') AS current_month, now.revenue::DOUBLE AS current_revenue,
               before.revenue::DOUBLE AS previous_revenue,
               {ratio("now.revenue - coalesce(before.revenue, 0)", "nullif(before.revenue, 1)", 2, "100")} AS growth_pct
        FROM monthly now LEFT JOIN monthly before
          ON now.product_id = before.product_id AND before.m = now.m - INTERVAL 1 MONTH
        WHERE now.revenue > 100
        ORDER BY growth_pct DESC NULLS LAST, now.product_id, current_month LIMIT 30""",
}


def _period(value: str, inside: str, scale: int) -> str:
    """A figure for today, yesterday and the month to date."""
    parts = []
    for name, test in (
        ("today_count", f"{inside}::DATE = DATE '2001-07-31'"),
        ("yesterday_count", f"{inside}::DATE = DATE '2001-07-30'"),
        ("month_to_date", f"{inside} >= TIMESTAMP '2001-07-01'"),
    ):
        figure = value.replace("?", f"FILTER (WHERE {test})")
        parts.append(f"round(({figure})::DECIMAL(28,8), {scale})::DOUBLE AS {name}")
    return ", ".join(parts)


_REPORTS = {
    "executive_dashboard": f"""
        SELECT 'Orders' AS metric, {_period("count(*) ?", "order_date", 0)} FROM shop_orders
        UNION ALL SELECT 'Revenue', {_period("sum(total_amount) ?", "order_date", 0)} FROM shop_orders
        UNION ALL SELECT 'New Customers', {_period("count(*) ?", "created_at", 0)} FROM shop_customers
        UNION ALL SELECT 'Avg Order Value', {_period("avg(total_amount) ?", "order_date", 2)} FROM shop_orders""",
    "sales_report": f"""
        SELECT strftime(o.order_date, '%Y-%m-%d') AS order_date, status, count(DISTINCT order_id) AS order_count,
               count(DISTINCT customer_id) AS unique_customers, {dbl("sum(total_amount)")} AS gross_revenue,
               {dbl("sum(tax_amount)")} AS tax_collected, {dbl("sum(shipping_cost)")} AS shipping_revenue,
               {dbl("sum(total_amount - tax_amount - coalesce(shipping_cost, 0))")} AS net_revenue,
               {mean("total_amount", 2)} AS avg_order_value, {big("coalesce(sum(quantity), 0)")} AS total_items_sold,
               count(DISTINCT product_id) AS unique_products_sold
        FROM shop_orders o LEFT JOIN shop_items USING (order_id)
        WHERE o.order_date >= {ago("30 DAY")} GROUP BY 1, 2""",
    "inventory_report": f"""
        WITH recent AS (SELECT product_id, sum(quantity) AS units FROM shop_items JOIN shop_orders USING (order_id)
                        WHERE order_date >= {ago("30 DAY")} GROUP BY product_id)
        SELECT category, subcategory, count(DISTINCT product_id) AS product_count,
               {big("sum(quantity_available)")} AS total_available, {big("sum(quantity_reserved)")} AS total_reserved,
               {big("sum(quantity_available + quantity_reserved)")} AS total_inventory,
               {dbl("sum((quantity_available + quantity_reserved) * cost)")} AS inventory_value_cost,
               {dbl("sum((quantity_available + quantity_reserved) * price)")} AS inventory_value_retail,
               {mean("quantity_available", 0)} AS avg_available_per_product,
               count(*) FILTER (quantity_available < reorder_level) AS products_below_reorder,
               count(*) FILTER (quantity_available = 0) AS out_of_stock_count,
               {big("coalesce(sum(units), 0)")} AS units_sold_30days
        FROM shop_products JOIN shop_stock USING (product_id) LEFT JOIN recent USING (product_id)
        WHERE is_active = 1 GROUP BY category, subcategory""",
    "customer_report": f"""
        WITH stats AS (SELECT customer_id, count(*) AS n, sum(total_amount) AS spent,
                              round((sum(total_amount)::DOUBLE / nullif(count(total_amount), 0))::DECIMAL(28,8), 8) AS typical,
                              max(order_date) AS latest
                       FROM shop_orders WHERE status IN {SETTLED} GROUP BY customer_id)
        SELECT customer_type, count(DISTINCT customer_id) AS customer_count, {mean("loyalty_points", 0)} AS avg_loyalty_points,
               {big("coalesce(sum(n), 0)")} AS total_orders, {dbl("coalesce(sum(spent), 0)")} AS total_revenue,
               coalesce({mean("n", 2)}, 0) AS avg_orders_per_customer, coalesce({mean("spent", 2)}, 0) AS avg_revenue_per_customer,
               coalesce({mean("typical", 2)}, 0) AS avg_order_value,
               count(*) FILTER (latest >= {ago("30 DAY")}) AS active_last_30_days,
               count(*) FILTER (latest >= {ago("90 DAY")}) AS active_last_90_days,
               count(*) FILTER (latest < {ago("90 DAY")} OR latest IS NULL) AS inactive
        FROM shop_customers LEFT JOIN stats USING (customer_id) GROUP BY customer_type""",
    "transaction_report": f"""
        WITH per AS (SELECT payment_gateway, transaction_type, status, count(*) AS n, sum(amount) AS total, count(amount) AS priced,
                            min(amount) AS low, max(amount) AS high
                     FROM shop_payments WHERE processed_at >= {ago("30 DAY")} GROUP BY ALL)
        SELECT payment_gateway, transaction_type, status, n AS transaction_count, total::DOUBLE AS total_amount,
               {ratio("total", "priced", 6)} AS avg_amount, low::DOUBLE AS min_amount, high::DOUBLE AS max_amount,
               {ratio("n", "sum(n) OVER (PARTITION BY payment_gateway)", 2, "100")} AS pct_of_gateway_total
        FROM per""",
}

_DETAIL_ORDER = """customer_id, order_date DESC NULLS FIRST, subtotal DESC NULLS FIRST, order_id, order_item_id,
                   inventory_id NULLS LAST, transaction_id NULLS LAST"""

_WAREHOUSE = {
    "full_table_scan": """
        SELECT order_id, customer_id, o.order_date, status, total_amount::DOUBLE AS total_amount, first_name, last_name, email,
               (SELECT count(*) FROM shop_items i WHERE i.order_id = o.order_id) AS item_count
        FROM shop_orders o JOIN shop_customers USING (customer_id)
        ORDER BY o.order_date DESC, order_id LIMIT 1000""",
    "complex_join": f"""
        SELECT customer_id, any_value(first_name || ' ' || last_name) AS customer_name,
               any_value(customer_type) AS customer_type, count(DISTINCT order_id) AS order_count,
               count(DISTINCT i.product_id) AS unique_products, {dbl("sum(quantity)")} AS total_items,
               {dbl("sum(subtotal)")} AS total_spent, count(DISTINCT transaction_id) AS transaction_count,
               count(*) FILTER (t.status = 'COMPLETED') AS successful_transactions,
               count(DISTINCT category) AS categories_purchased, {mean("quantity_available")} AS avg_inventory_level
        FROM shop_customers JOIN shop_orders o USING (customer_id) LEFT JOIN shop_items i USING (order_id)
          LEFT JOIN shop_payments t USING (order_id) LEFT JOIN shop_products p ON p.product_id = i.product_id
          LEFT JOIN shop_stock s ON s.product_id = p.product_id
        WHERE o.order_date >= {ago("90 DAY")} GROUP BY customer_id
        ORDER BY total_spent DESC NULLS FIRST, customer_id LIMIT 100""",
    "customer_data": f"""
        WITH joined AS (
          SELECT c.customer_id, first_name || ' ' || last_name AS customer_name, email, phone, city, state, zip_code, country,
                 customer_type, loyalty_points, o.order_id, order_date, total_amount, o.status AS order_status, payment_method,
                 shipping_cost, tax_amount, tracking_number, order_item_id, quantity, unit_price, discount, subtotal,
                 p.product_id, product_name, description, category, subcategory, manufacturer, sku, price AS current_price,
                 cost, weight, dimensions, is_active, inventory_id, quantity_available, quantity_reserved, reorder_level,
                 warehouse_location, transaction_id, payment_gateway, transaction_type, amount AS transaction_amount,
                 t.status AS transaction_status, processed_at, c.created_at AS joined_at
          FROM shop_customers c JOIN shop_orders o ON o.customer_id = c.customer_id
            JOIN shop_items i ON i.order_id = o.order_id JOIN shop_products p ON p.product_id = i.product_id
            LEFT JOIN shop_stock s ON s.product_id = p.product_id LEFT JOIN shop_payments t ON t.order_id = o.order_id
          WHERE order_date >= {LAST_24_MONTHS}),
        ranked AS (
          SELECT *, count(*) OVER c AS customer_total_orders, sum(total_amount) OVER c AS customer_lifetime_value,
                 {ratio("sum(total_amount) OVER c", "count(total_amount) OVER c", 6)} AS customer_avg_order,
                 max(order_date) OVER c AS customer_last_order_date, count(*) OVER k AS category_order_count,
                 sum(subtotal) OVER k AS category_revenue,
                 {ratio("sum(unit_price) OVER k", "count(unit_price) OVER k", 6)} AS category_avg_price,
                 count(*) OVER st AS state_order_count, sum(total_amount) OVER st AS state_total_revenue,
                 count(*) OVER mf AS manufacturer_order_count, sum(quantity) OVER mf AS manufacturer_units_sold,
                 rank() OVER (PARTITION BY customer_id ORDER BY order_date DESC) AS customer_order_rank,
                 rank() OVER (PARTITION BY category ORDER BY subtotal DESC NULLS FIRST) AS category_revenue_rank,
                 dense_rank() OVER (ORDER BY total_amount DESC NULLS FIRST) AS overall_order_value_rank,
                 row_number() OVER (PARTITION BY state ORDER BY order_date DESC, order_id, order_item_id,
                   inventory_id NULLS LAST, transaction_id NULLS LAST) AS state_order_sequence
          FROM joined
          WINDOW c AS (PARTITION BY customer_id), k AS (PARTITION BY category), st AS (PARTITION BY state),
                 mf AS (PARTITION BY manufacturer))
        SELECT * EXCLUDE (joined_at) REPLACE (
                 total_amount::DOUBLE AS total_amount, shipping_cost::DOUBLE AS shipping_cost, tax_amount::DOUBLE AS tax_amount,
                 unit_price::DOUBLE AS unit_price, discount::DOUBLE AS discount, subtotal::DOUBLE AS subtotal,
                 current_price::DOUBLE AS current_price, cost::DOUBLE AS cost, weight::DOUBLE AS weight,
                 is_active::BIGINT AS is_active, transaction_id::DOUBLE AS transaction_id, transaction_amount::DOUBLE AS transaction_amount,
                 customer_lifetime_value::DOUBLE AS customer_lifetime_value, category_revenue::DOUBLE AS category_revenue,
                 state_total_revenue::DOUBLE AS state_total_revenue, manufacturer_units_sold::BIGINT AS manufacturer_units_sold),
               round(({months_to_as_of("order_date")})::DECIMAL(28,8), 2)::DOUBLE AS months_since_order,
               round(({months_to_as_of("joined_at")})::DECIMAL(28,8), 2)::DOUBLE AS customer_age_months,
               CASE WHEN total_amount > 1000 THEN 'High Value' WHEN total_amount > 500 THEN 'Medium Value'
                    ELSE 'Low Value' END AS order_value_category,
               CASE WHEN quantity_available < reorder_level THEN 'Critical'
                    WHEN quantity_available < 2 * reorder_level THEN 'Low'
                    WHEN quantity_available < 5 * reorder_level THEN 'Medium' ELSE 'High' END AS inventory_status,
               (subtotal - quantity * cost)::DOUBLE AS item_profit,
               {ratio("subtotal - quantity * cost", "subtotal", 2, "100")} AS item_profit_margin,
               (quantity_available * cost)::DOUBLE AS inventory_value_at_cost,
               (quantity_available * current_price)::DOUBLE AS inventory_value_at_retail,
               year(order_date) AS order_year, month(order_date) AS order_month, day(order_date) AS order_day,
               rpad(dayname(order_date), 9, ' ') AS order_day_name, strftime(order_date, '%H:%M:%S') AS order_time,
               order_date::DATE::VARCHAR AS order_date_only
        FROM ranked ORDER BY {_DETAIL_ORDER} LIMIT 500""",
}

_TREND = """SELECT coalesce(sum(total), 0) AS revenue, sum(total) AS known_revenue, count(total) AS known_days,
                   coalesce(sum(n), 0) AS n
            FROM (SELECT order_date::DATE AS d, sum(total_amount) AS total, count(*) AS n FROM shop_orders
                  WHERE order_date >= TIMESTAMP '2001-07-01' AND status IN ('COMPLETED', 'SHIPPED') GROUP BY d)"""

_PARTNERS = """SELECT a.product_id, count(DISTINCT b.product_id) AS partners
               FROM (SELECT DISTINCT order_id, product_id FROM shop_items) a
               LEFT JOIN (SELECT DISTINCT order_id, product_id FROM shop_items) b
                 ON a.order_id = b.order_id AND a.product_id <> b.product_id
               GROUP BY a.product_id"""

_PROCEDURES = {
    "sales_trend": f"""
        SELECT revenue::DOUBLE AS total_revenue, coalesce({ratio("known_revenue", "known_days", 6)}, 0) AS avg_daily_revenue,
               n::BIGINT AS order_count
        FROM ({_TREND})""",
    "customer_cohort": """
        SELECT (SELECT count(DISTINCT customer_id) FROM shop_orders WHERE order_date >= TIMESTAMP '2001-01-31')
                 AS active_customers,
               (SELECT count(*) FROM shop_customers c
                WHERE EXISTS (FROM shop_orders o WHERE o.customer_id = c.customer_id)
                  AND NOT EXISTS (FROM shop_orders o WHERE o.customer_id = c.customer_id
                                  AND o.order_date >= TIMESTAMP '2001-01-31')) AS churned_customers,
               (SELECT count(*) FROM shop_customers WHERE created_at >= TIMESTAMP '2001-06-30') AS new_customers""",
    "product_recommendation": f"SELECT product_id, partners AS recommendations FROM ({_PARTNERS})",
    "product_recommendation_one": f"""
        SELECT product_id, partners AS recommendations FROM ({_PARTNERS}) WHERE product_id = 77""",
    "inventory_forecast": f"""
        WITH sales AS (SELECT product_id, sum(quantity)::DOUBLE / greatest(1.0::DOUBLE,
                                (epoch_us({AS_OF}) - epoch_us(min(order_date)))::DOUBLE / 86400000000.0::DOUBLE) AS daily
                       FROM shop_items JOIN shop_orders USING (order_id)
                       WHERE order_date >= {ago("30 DAY")} GROUP BY product_id)
        SELECT count(*) AS total_items_checked,
               count(*) FILTER (quantity_available < coalesce(daily, 0) * 14) AS items_at_risk
        FROM shop_stock LEFT JOIN sales USING (product_id)""",
    "revenue_reconciliation": """
        WITH totals AS (
          SELECT (SELECT coalesce(sum(total_amount), 0) FROM shop_orders
                  WHERE order_date >= TIMESTAMP '2001-07-24' AND status IN ('COMPLETED', 'SHIPPED')) AS ordered,
                 (SELECT coalesce(sum(amount), 0) FROM shop_payments
                  WHERE processed_at >= TIMESTAMP '2001-07-24' AND status = 'COMPLETED') AS paid)
        SELECT ordered::DOUBLE AS order_total, paid::DOUBLE AS transaction_total, (ordered - paid)::DOUBLE AS discrepancy
        FROM totals""",
}

_LOOKUPS = {
    "order_count": "SELECT count(*) AS order_count FROM shop_orders",
    "order_max_id": "SELECT coalesce(max(order_id), 0) AS max_order_id FROM shop_orders",
    "customer_count": "SELECT count(*) AS customer_count FROM shop_customers",
    "customer_email_lookup": """
        SELECT DISTINCT o.customer_id, email FROM shop_orders o LEFT JOIN shop_customers USING (customer_id)""",
    "product_details": """
        SELECT product_id, product_name || ' (' || category || ') - $' || price::VARCHAR || ' [' || sku || ']' AS details
        FROM shop_products""",
    "product_search_by_category": """
        SELECT product_id, product_name, price::DOUBLE AS price FROM shop_products
        WHERE category = 'ECONOMY' AND is_active = 1 ORDER BY shop_products.price DESC, product_id LIMIT 20""",
    "active_product_count": "SELECT count(*) AS product_count FROM shop_products WHERE is_active = 1",
    "active_session_count": "SELECT count(*) AS session_count FROM shop_sessions WHERE is_active = 1",
    "session_count_by_customer": """
        SELECT customer_id, count(*) AS session_count FROM shop_sessions WHERE is_active = 1 GROUP BY customer_id""",
    "customer_transaction_total": """
        SELECT customer_id, sum(amount)::DOUBLE AS total FROM shop_payments p JOIN shop_orders USING (order_id)
        WHERE p.status = 'COMPLETED' GROUP BY customer_id""",
    "failed_transaction_count": "SELECT count(*) AS failed_count FROM shop_payments WHERE status = 'FAILED'",
    "inventory_availability": """
        SELECT product_id, sum(quantity_available - quantity_reserved)::BIGINT AS available
        FROM shop_stock GROUP BY product_id""",
    "table_row_counts": """
        SELECT 'customers' AS table_name, count(*) AS row_count FROM shop_customers
        UNION ALL SELECT 'products', count(*) FROM shop_products
        UNION ALL SELECT 'orders', count(*) FROM shop_orders
        UNION ALL SELECT 'order_items', count(*) FROM shop_items""",
}

_SUMMARY = "total_orders, total_revenue, total_customers, avg_order_value"


def _mean_money(column: str) -> str:
    return f"round((sum({column})::DOUBLE / nullif(count({column}), 0))::DECIMAL(28,8), 2)"


_MERGED_SUMMARY = f"""
    WITH fresh AS (
      SELECT order_date::DATE AS summary_date, count(*) AS total_orders, sum(total_amount) AS total_revenue,
             count(DISTINCT customer_id) AS total_customers, {_mean_money("total_amount")} AS avg_order_value
      FROM shop_orders WHERE order_date >= TIMESTAMP '2001-07-24' AND status IN {SETTLED} GROUP BY 1),
    next AS (
      SELECT summary_date, {_SUMMARY}, {AS_OF} AS created_at FROM fresh
      UNION ALL SELECT summary_date, {_SUMMARY}, created_at FROM old_summary
      WHERE summary_date NOT IN (SELECT summary_date FROM fresh))
    SELECT {columns("sales_summary", ("summary_id",))} FROM next"""

_PURGES = {
    "purge_old_orders": f"status IN ('COMPLETED', 'DELIVERED') AND order_date < {ago('30 DAY')}",
    "delete_cancelled_orders": "status IN ('CANCELLED', 'PAYMENT_FAILED')",
    "purge_orders_by_age": f"order_date < {ago('30 DAY')}",
}


def _purge(name: str, doomed: str) -> dict[str, str]:
    gone = f"(SELECT order_id FROM shop_orders WHERE {doomed})"
    return {
        name: f"""
            SELECT (SELECT count(*) FROM {gone}) AS orders_deleted,
                   (SELECT count(*) FROM shop_items WHERE order_id IN {gone}) AS items_deleted,
                   (SELECT count(*) FROM shop_payments WHERE order_id IN {gone}) AS transactions_deleted""",
        f"{name}_orders": f"SELECT {columns('orders')} FROM shop_orders WHERE NOT ({doomed})",
        f"{name}_items": f"SELECT {columns('order_items')} FROM shop_items WHERE order_id NOT IN {gone}",
        f"{name}_transactions": f"SELECT {columns('transactions')} FROM shop_payments WHERE order_id NOT IN {gone}",
    }


def _stock(changes: str, hit: str, **values: str) -> str:
    """Stock version after setting ``values`` in the rows that satisfy ``hit``."""
    values = {"updated_at": AS_OF, **values}
    replaced = {c: f"CASE WHEN {hit} THEN {v} ELSE shop_stock.{c} END" for c, v in values.items()}
    return f"SELECT {columns('inventory', **replaced)} FROM shop_stock {changes}"


def _restock(changes: str, hit: str, amount: str) -> str:
    return _stock(changes, hit, quantity_available=f"quantity_available + {amount}", last_restock_date=AS_OF)


_WANT_STOCK = "LEFT JOIN want_stock w USING (product_id)"
_ORDERED = "LEFT JOIN ordered_units u USING (product_id)"
_LOW = "quantity_available < reorder_level"

_POINTS = """SELECT customer_id, trunc(coalesce(sum(total_amount), 0) * 10)::BIGINT + count(order_id) * 50 AS earned
             FROM shop_customers LEFT JOIN (FROM shop_orders WHERE status IN ('COMPLETED', 'DELIVERED')) o USING (customer_id)
             GROUP BY customer_id"""


def _created(service: bool) -> dict[str, str]:
    name = "create_orders_service" if service else "create_orders"
    join = "JOIN" if service else "LEFT JOIN"
    lines = f"""SELECT w.*, coalesce(price, 29.99) AS unit_price, (coalesce(price, 29.99) * w.quantity)::DECIMAL(12,2) AS subtotal
                FROM want_lines w {join} shop_products USING (product_id)"""
    heads = f"""SELECT DISTINCT order_id, customer_id, payment_method, total_amount
                FROM want_lines LEFT JOIN (SELECT order_id, sum(subtotal) AS total_amount FROM ({lines}) GROUP BY order_id)
                  USING (order_id)"""
    nothing = "NULL::VARCHAR"
    orders = columns(
        "orders", order_date=AS_OF, status="'PENDING'", tax_amount="round(total_amount * 0.08, 2)",
        shipping_cost="NULL", shipping_address=nothing, tracking_number=nothing, created_at=AS_OF, updated_at=AS_OF,
    )
    audit = columns(
        "audit_log", ("audit_id",), table_name="'ORDERS'", operation="'CREATE'" if service else "'INSERT'",
        record_id="order_id", old_value=nothing, new_value=nothing,
        changed_by="'SYSTEM'" if service else "'STORED_PROC'", changed_at=AS_OF,
    )
    return {
        name: f"SELECT {orders} FROM ({heads})",
        f"{name}_items": f"SELECT {columns('order_items', ('order_item_id',), discount='0')} FROM ({lines})",
        f"{name}_audit": f"SELECT {audit} FROM ({heads})",
    }


_NEW_PAYMENT = ("transaction_id", "gateway_transaction_id")
_PENDING = "p.status = 'PENDING' AND w.order_id IS NOT NULL"

_UPKEEP = {
    "merge_sales_summary": _MERGED_SUMMARY,
    "merge_customer_analytics": f"""
        WITH stats AS (SELECT customer_id, count(order_id) AS n, sum(total_amount) AS spent,
                              {_mean_money("total_amount")} AS typical, max(order_date) AS latest
                       FROM shop_customers
                       LEFT JOIN (FROM shop_orders WHERE status IN {SETTLED}) o USING (customer_id) GROUP BY customer_id)
        SELECT customer_id, n AS total_orders, coalesce(spent, 0)::DOUBLE AS total_spent,
               coalesce(typical, 0)::DOUBLE AS avg_order_value, latest AS last_order_date, {_SEGMENT} AS customer_segment,
               {AS_OF} AS calculated_at
        FROM stats
        UNION ALL SELECT {columns("customer_analytics", ("analytics_id",))} FROM old_analytics
        WHERE customer_id NOT IN (SELECT customer_id FROM stats)""",
    "merge_product_performance": f"""
        WITH fresh AS (
          SELECT product_id, DATE '2001-07-01' AS period_start, DATE '2001-07-31' AS period_end,
                 coalesce(sum(quantity), 0) AS units_sold, coalesce(sum(subtotal), 0) AS revenue,
                 coalesce(sum(subtotal) - sum(quantity * cost), 0) AS profit, 0 AS return_count, {AS_OF} AS calculated_at
          FROM shop_products LEFT JOIN shop_items USING (product_id) WHERE is_active = 1 GROUP BY product_id),
        next AS (
          FROM fresh UNION ALL
          SELECT product_id, period_start, period_end, units_sold, revenue, profit, return_count, calculated_at
          FROM old_performance o
          WHERE NOT EXISTS (FROM fresh f WHERE f.product_id = o.product_id AND f.period_start = o.period_start))
        SELECT {columns("product_performance", ("performance_id",))} FROM next""",
    "upsert_sales_trend": f"""
        WITH trend AS (SELECT revenue, n, coalesce(round((revenue::DOUBLE / nullif(n, 0))::DECIMAL(28,8), 2), 0) AS typical
                       FROM ({_TREND})),
        next AS (
          SELECT DATE '2001-07-31' AS summary_date, n AS total_orders, revenue AS total_revenue,
                 coalesce(s.total_customers, 0) AS total_customers, typical AS avg_order_value,
                 coalesce(s.created_at, {AS_OF}) AS created_at
          FROM trend LEFT JOIN old_summary s ON s.summary_date = DATE '2001-07-31'
          UNION ALL SELECT summary_date, {_SUMMARY}, created_at FROM old_summary WHERE summary_date <> DATE '2001-07-31')
        SELECT {columns("sales_summary", ("summary_id",))} FROM next""",
    "upsert_recommendation": f"""
        WITH fresh AS ({_PARTNERS})
        SELECT product_id, partners AS recommendation_score, {AS_OF} AS last_analyzed FROM fresh
        UNION ALL SELECT product_id, recommendation_score, last_analyzed FROM old_recommendation
        WHERE product_id NOT IN (SELECT product_id FROM fresh)""",
    "replace_daily_sales_summary": f"""
        WITH next AS (
          SELECT DATE '2001-07-26' AS summary_date, count(*) AS total_orders, coalesce(sum(total_amount), 0) AS total_revenue,
                 count(DISTINCT customer_id) AS total_customers,
                 coalesce(round((coalesce(sum(total_amount), 0)::DOUBLE / nullif(count(*), 0))::DECIMAL(28,8), 2), 0)
                   AS avg_order_value,
                 {AS_OF} AS created_at
          FROM shop_orders WHERE order_date::DATE = DATE '2001-07-26' AND status NOT IN ('CANCELLED', 'PAYMENT_FAILED')
          UNION ALL SELECT summary_date, {_SUMMARY}, created_at FROM old_summary WHERE summary_date <> DATE '2001-07-26')
        SELECT {columns("sales_summary", ("summary_id",))} FROM next""",
    "purge_audit_log": f"SELECT {columns('audit_log')} FROM shop_audit WHERE NOT changed_at < {ago('30 DAY')}",
    "purge_audit_log_count": f"SELECT count(*) AS logs_deleted FROM shop_audit WHERE changed_at < {ago('30 DAY')}",
    "restock_low_inventory": _restock("", _LOW, "500"),
    "restock_low_inventory_count": f"SELECT count(*) AS items_restocked FROM shop_stock WHERE {_LOW}",
    "auto_restock": _restock(
        """LEFT JOIN (SELECT product_id, sum(quantity_available - quantity_reserved) AS free
                      FROM shop_stock GROUP BY product_id) f USING (product_id)""",
        "free < 100",
        "300",
    ),
    "restock_products": _restock(_WANT_STOCK, "w.quantity IS NOT NULL", "w.quantity"),
    "relocate_inventory": _stock("", "product_id % 11 = 0", warehouse_location="'WH-' || ((product_id + 2) % 5)"),
    "reserve_inventory": _stock(_ORDERED, "units IS NOT NULL", quantity_reserved="quantity_reserved + units"),
    "release_inventory": _stock(
        _ORDERED, "units IS NOT NULL", quantity_reserved="greatest(0, quantity_reserved - units)"
    ),
    "adjust_inventory": _stock(
        _WANT_STOCK, "adjustment IS NOT NULL", quantity_available="greatest(0, quantity_available + adjustment)"
    ),
    "bulk_update_inventory": _stock(
        _WANT_STOCK, "adjustment IS NOT NULL", quantity_available="quantity_available + adjustment"
    ),
    "calculate_loyalty": f"""
        SELECT {columns("customers", loyalty_points="earned", updated_at=AS_OF,
                        customer_type='''CASE WHEN earned >= 50000 THEN 'PLATINUM' WHEN earned >= 20000 THEN 'GOLD'
                                              WHEN earned >= 5000 THEN 'SILVER' ELSE 'BRONZE' END''')}
        FROM shop_customers JOIN ({_POINTS}) e USING (customer_id)""",
    "add_loyalty_points": f"""
        SELECT {columns("customers", loyalty_points="loyalty_points + coalesce(points, 0)",
                        updated_at=f"CASE WHEN points IS NULL THEN updated_at ELSE {AS_OF} END")}
        FROM shop_customers LEFT JOIN want_points USING (customer_id)""",
    "upgrade_customers": f"""
        SELECT {columns("customers",
                        customer_type="CASE WHEN customer_id % 11 = 0 THEN 'PREMIUM' ELSE customer_type END",
                        updated_at=f'''CASE WHEN customer_id % 11 = 0 AND customer_type = 'REGULAR' THEN {AS_OF}
                                            ELSE updated_at END''')}
        FROM shop_customers""",
    "order_totals": f"""
        SELECT {columns("orders",
                        total_amount="CASE WHEN w.order_id IS NULL THEN total_amount ELSE s.total END",
                        tax_amount="CASE WHEN w.order_id IS NULL THEN tax_amount ELSE round(s.total * 0.08, 2) END",
                        updated_at=f"CASE WHEN w.order_id IS NULL THEN updated_at ELSE {AS_OF} END",
                        order_id="o.order_id")}
        FROM shop_orders o LEFT JOIN want_orders w ON w.order_id = o.order_id
          LEFT JOIN (SELECT order_id, sum(subtotal) AS total FROM shop_items GROUP BY order_id) s ON s.order_id = o.order_id""",
    "update_order_status": f"""
        SELECT {columns("orders", status="CASE WHEN order_id % 7 = 0 THEN 'SHIPPED' ELSE status END",
                        updated_at=f"CASE WHEN order_id % 7 = 0 THEN {AS_OF} ELSE updated_at END")}
        FROM shop_orders""",
    "create_transactions": f"""
        SELECT {columns("transactions", _NEW_PAYMENT, order_id="w.order_id", transaction_type="'PAYMENT'",
                        amount="total_amount", currency="'USD'", status="'PENDING'", processed_at=AS_OF,
                        payment_gateway="['Stripe', 'PayPal', 'Square', 'Authorize.Net', 'Braintree'][abs(w.order_id) % 5 + 1]",
                        error_message="NULL::VARCHAR")}
        FROM (FROM want_orders UNION ALL SELECT -order_id - 1 FROM want_orders) w
          LEFT JOIN shop_orders o ON o.order_id = w.order_id""",
    "process_payments": f"""
        SELECT {columns("transactions", order_id="p.order_id",
                        status=f'''CASE WHEN {_PENDING} THEN CASE WHEN w.order_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END
                                        ELSE p.status END''',
                        processed_at=f"CASE WHEN {_PENDING} THEN {AS_OF} ELSE processed_at END",
                        error_message=f'''CASE WHEN {_PENDING} AND w.order_id % 3 = 0
                                               THEN 'Payment declined - insufficient funds' ELSE error_message END''')}
        FROM shop_payments p LEFT JOIN want_orders w ON w.order_id = p.order_id""",
    "process_payments_orders": f"""
        SELECT {columns("orders",
                        status='''CASE WHEN order_id % 7 <> 0 THEN status WHEN order_id % 3 = 0 THEN 'PAYMENT_FAILED'
                                       ELSE 'COMPLETED' END''',
                        updated_at=f"CASE WHEN order_id % 7 = 0 THEN {AS_OF} ELSE updated_at END")}
        FROM shop_orders""",
    "refund_transactions": f"""
        SELECT {columns("transactions", _NEW_PAYMENT, transaction_type="'REFUND'", amount="-amount", status="'COMPLETED'",
                        processed_at=AS_OF, error_message="NULL::VARCHAR")}
        FROM shop_payments WHERE transaction_id % 7 = 0""",
    "create_sessions": f"""
        SELECT {columns("session_data", ("session_id",), customer_id="user_id", login_time="ts", last_activity="ts",
                        ip_address="NULL::VARCHAR", user_agent="NULL::VARCHAR", session_data="NULL::VARCHAR", is_active="1")}
        FROM events WHERE event_type = 'signup'""",
    "touch_sessions": f"""
        SELECT {columns("session_data", last_activity="coalesce(touched, last_activity)")}
        FROM shop_sessions LEFT JOIN (
          SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, max(ts) + INTERVAL 5 MINUTE AS touched
          FROM events WHERE event_type = 'click' GROUP BY 1) USING (session_id)""",
    "expire_sessions": f"""
        SELECT {columns("session_data", is_active='''CASE WHEN session_id IN
                        (SELECT user_id || '-' || strftime(ts, '%Y%m%d') FROM events WHERE event_type = 'error')
                        THEN 0 ELSE is_active END''')}
        FROM shop_sessions""",
    "expire_idle_sessions": f"""
        SELECT {columns("session_data",
                        is_active="CASE WHEN last_activity < TIMESTAMP '2024-01-30 11:00:00' THEN 0 ELSE is_active END")}
        FROM shop_sessions""",
    "expire_idle_sessions_count": """
        SELECT count(*) AS sessions_expired FROM shop_sessions
        WHERE is_active = 1 AND last_activity < TIMESTAMP '2024-01-30 11:00:00'""",
    "delete_expired_sessions": f"""
        SELECT {columns("session_data")} FROM shop_sessions
        WHERE is_active <> 0 AND last_activity >= TIMESTAMP '2024-01-30 10:00:00'""",
    "delete_expired_sessions_count": """
        SELECT count(*) AS sessions_deleted FROM shop_sessions
        WHERE is_active = 0 OR last_activity < TIMESTAMP '2024-01-30 10:00:00'""",
    "reprice_products": f"""
        SELECT {columns("products", price='''CASE WHEN product_id % 11 = 0
                        THEN round(price * (10000 + (product_id * 37) % 1000 - 500)::DECIMAL(12,0) * 0.0001, 2) ELSE price END''')}
        FROM shop_products""",
    "deactivate_products": f"""
        SELECT {columns("products", is_active="CASE WHEN product_id % 11 = 0 THEN 0 ELSE is_active END")}
        FROM shop_products""",
    "append_audit_log": f"""
        SELECT {columns("audit_log", ("audit_id",))} FROM shop_audit
        UNION ALL SELECT 'CUSTOMERS', 'ACCESS', customer_id, NULL, NULL, 'SYSTEM', {AS_OF}
        FROM shop_customers WHERE customer_id % 11 = 0""",
}
for _name, _doomed in _PURGES.items():
    _UPKEEP.update(_purge(_name, _doomed))
_UPKEEP.update({**_created(False), **_created(True)})

_PRICED = """SELECT w.order_id, w.product_id, w.quantity, (price * w.quantity)::DECIMAL(12,2) AS subtotal
             FROM want_lines w JOIN shop_products USING (product_id)"""
_UPKEEP["place_orders_transactions"] = f"""
    SELECT {columns("transactions", _NEW_PAYMENT, transaction_type="'PAYMENT'", amount="total", currency="'USD'", status="'PENDING'",
                    processed_at=AS_OF, error_message="NULL::VARCHAR",
                    payment_gateway="['Stripe', 'PayPal', 'Square', 'Authorize.Net', 'Braintree'][order_id % 5 + 1]")}
    FROM (SELECT DISTINCT order_id FROM want_lines)
      LEFT JOIN (SELECT order_id, sum(subtotal) AS total FROM ({_PRICED}) GROUP BY order_id) USING (order_id)"""
_UPKEEP["place_orders_inventory"] = _stock(
    f"LEFT JOIN (SELECT product_id, sum(quantity) AS units FROM ({_PRICED}) GROUP BY product_id) u USING (product_id)",
    "units IS NOT NULL",
    quantity_reserved="quantity_reserved + units",
)

_SOURCES = {
    "sink_parquet": _UPKEEP["restock_low_inventory"],
    "erase_old_orders": _UPKEEP["purge_old_orders_orders"],
    "erase_cancelled_orders": _UPKEEP["delete_cancelled_orders_items"],
    "erase_orders_by_age": _UPKEEP["purge_orders_by_age_transactions"],
    "src_parquet": f"SELECT {columns('order_items')} FROM shop_items",
    "stream_sales_summary": _MERGED_SUMMARY,
    "stream_session_activity": """
        WITH marked AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh
                        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM marked)
        SELECT user_id AS customer_id, min(ts) AS login_time, max(ts) AS last_activity, count(*) AS events,
               CASE WHEN max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) THEN 0 ELSE 1 END::BIGINT AS is_active
        FROM numbered GROUP BY user_id, n""",
}

ORACLES: dict[str, str] = {
    **_SALES, **_CUSTOMERS, **_PRODUCTS, **_REPORTS, **_WAREHOUSE, **_PROCEDURES, **_LOOKUPS, **_UPKEEP, **_SOURCES,
}
