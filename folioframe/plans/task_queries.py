"""Tasks, boards and dashboard figures: orders are contracts, regions are scopes."""

from pyspark.sql import functions as F

from folioframe.operators import tasks as tk
from folioframe.plans import bindings as b
from folioframe.plans.registry import register

_PLACES = """
pl AS (SELECT c_custkey, c_name, c_acctbal, r_name AS scope FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ct AS (SELECT o_orderkey, o_orderstatus AS category, o_totalprice AS amount, o_orderpriority AS risk, o_orderdate, scope, c_name FROM orders JOIN pl ON o_custkey = c_custkey)
"""


def _places(spark, sf):
    nation, region = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("scope"))
    return b.table(spark, sf, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))


def _contracts(spark, sf):
    places = _places(spark, sf).select("c_custkey", "c_name", "scope")
    return b.table(spark, sf, "orders").join(places, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_orderstatus").alias("category"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("risk"), "o_orderdate", "scope", "c_name",
    )


@register(
    "dashboard_kpis",
    "WITH " + _PLACES.strip()
    + """, sc AS (SELECT DISTINCT scope FROM ct UNION ALL SELECT 'all'),
      k AS (SELECT sc.scope, count(*) AS contracts, count(*) FILTER (WHERE category = 'O') AS n_o, count(*) FILTER (WHERE category = 'P') AS n_p, count(*) FILTER (WHERE category = 'F') AS n_f,
              round(sum(amount), 2) AS amount, count(*) FILTER (WHERE category = 'O' AND o_orderdate < TIMESTAMP '1996-01-01') AS overdue_items,
              count(*) FILTER (WHERE category <> 'F' AND risk <> '3-MEDIUM') AS risks FROM sc JOIN ct ON sc.scope = 'all' OR sc.scope = ct.scope GROUP BY 1),
      d AS (SELECT sc.scope, round(sum(CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE 0 END), 2) AS debt FROM sc JOIN pl ON sc.scope = 'all' OR sc.scope = pl.scope GROUP BY 1)
      SELECT scope, contracts, n_o, n_p, n_f, amount, overdue_items, risks, debt, least(CAST(floor(debt / greatest(amount, 1) * 100 + 0.5) AS BIGINT), 99) AS debt_pct FROM k JOIN d USING (scope)""",
)
def dashboard_kpis(spark, sf):
    contracts = _contracts(spark, sf)
    late = contracts.where((F.col("category") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")))
    level = F.when(F.col("risk") == "3-MEDIUM", "Средний").otherwise(F.col("risk"))
    risks = contracts.where("category <> 'F'").select("scope", level.alias("level"))
    debtors = _places(spark, sf).where("c_acctbal < 0").select("scope", (-F.col("c_acctbal")).alias("overdue"))
    return tk.dashboard_kpis(contracts, late, risks, debtors, ["O", "P", "F"])


@register("high_risks", "SELECT count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_risks FROM orders")
def high_risks(spark, sf):
    return tk.high_risks(b.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("level")), ["1-URGENT", "2-HIGH"])


_SERIES = """
fs AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS actual,
         round(sum(o_totalprice), 2) AS expected, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2) AS expenses FROM orders GROUP BY 1)
"""


def _series(spark, sf):
    total = lambda cond: F.round(F.sum(F.when(cond, F.col("o_totalprice")).otherwise(0.0)), 2)
    return b.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(
        total(F.col("o_orderstatus") == "F").alias("actual"), total(F.lit(True)).alias("expected"), total(F.col("o_orderstatus") == "P").alias("expenses")
    )


@register(
    "finance_scaled",
    "WITH " + _SERIES.strip()
    + """, m AS (SELECT greatest(max(actual), max(expected), max(expenses), 1.0) AS top FROM fs)
      SELECT ym, round(42.0::DOUBLE + actual / top * 170, 4) AS actual_height, round(42.0::DOUBLE + expected / top * 170, 4) AS expected_height, round(42.0::DOUBLE + expenses / top * 170, 4) AS expenses_height FROM fs, m""",
)
def finance_scaled(spark, sf):
    return tk.finance_bars(_series(spark, sf), ["actual", "expected", "expenses"])


@register(
    "expenses_in_range",
    "WITH " + _SERIES.strip()
    + " SELECT ym, expenses AS amount, greatest(max(expenses) OVER (), 1.0) AS max_amount FROM fs WHERE ym BETWEEN '1996-03' AND '1998-10'",
)
def expenses_in_range(spark, sf):
    return tk.expenses_between(_series(spark, sf).select("ym", F.col("expenses").alias("amount")), "1996-03", "1998-10")



@register(
    "kanban_columns",
    "WITH " + _PLACES.strip()
    + """ SELECT CASE category WHEN 'O' THEN 'Новая' ELSE 'Выполнена' END AS status, count(*) AS cards, min(o_orderkey) AS first_card FROM ct
         WHERE category IN ('O', 'F') AND scope = 'EUROPE' GROUP BY 1""",
)
def kanban_columns(spark, sf):
    from folioframe import fixed_values as fx

    status = F.when(F.col("category") == "O", "Новая").when(F.col("category") == "F", "Выполнена").otherwise("Архив")
    cards = _contracts(spark, sf).withColumn("status", status)
    shown = tk.board_columns(cards, fx.BOARD_COLUMNS, scope="EUROPE")
    return shown.groupBy("status").agg(F.count("*").alias("cards"), F.min("o_orderkey").alias("first_card"))


@register(
    "attention_filter",
    "WITH " + _PLACES.strip() + " SELECT o_orderkey, 'attention' AS view FROM ct WHERE risk <> '5-LOW' UNION ALL SELECT o_orderkey, 'P' FROM ct WHERE category = 'P'",
)
def attention_filter(spark, sf):
    contracts = _contracts(spark, sf)
    named = lambda df, v: df.select("o_orderkey", F.lit(v).alias("view"))
    return named(tk.attention(contracts, low="5-LOW"), "attention").unionByName(named(tk.attention(contracts, "P"), "P"))


_SHEET = """
sh AS (SELECT o_orderkey, 'sheet_' || (o_custkey % 3) AS sheet, o_custkey % 3 AS sn, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Order ' || o_orderkey END AS task,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE 'owner ' || o_custkey END AS owner, strftime(o_orderdate, '%Y-%m-%d') AS due,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '5-LOW' THEN 'Low' ELSE 'Normal' END AS priority, CASE o_orderstatus WHEN 'O' THEN 'In Progress' WHEN 'F' THEN 'Done' ELSE 'Planning' END AS status
       FROM orders)
"""


def _cells(spark, sf):
    """Orders laid out as three exported sheets with a title row above the header."""
    o = b.table(spark, sf, "orders")
    sheet = F.concat(F.lit("sheet_"), F.col("o_custkey") % 3)
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    task = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("Order "), "o_orderkey"))
    owner = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " ").otherwise(F.concat(F.lit(" owner "), "o_custkey"))
    prio = F.when(F.col("o_orderpriority") == "1-URGENT", "High").when(F.col("o_orderpriority") == "5-LOW", "Low").otherwise("Normal")
    state = F.when(F.col("o_orderstatus") == "O", "In Progress").when(F.col("o_orderstatus") == "F", "Done").otherwise("Planning")
    body = o.select(sheet.alias("sheet"), (F.col("o_orderkey") + 10).alias("ordinal"), F.array(date, task, owner, prio, state).alias("values"))
    sheets = o.select(sheet.alias("sheet")).distinct()
    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    head = sheets.select("sheet", F.lit(5).cast("bigint").alias("ordinal"), strings("Due Date", "Task", "Owner", "Priority", "Status").alias("values"))
    title = sheets.select("sheet", F.lit(1).cast("bigint").alias("ordinal"), strings("Plan", "", "", "", "").alias("values"))
    return body.unionByName(head).unionByName(title)


@register(
    "tasks_from_sheet",
    "WITH " + _SHEET.strip() + " SELECT sheet, o_orderkey + 10 AS ordinal, task, owner, due, status, priority, '' AS notes FROM sh WHERE task <> '' AND owner <> ''",
)
def tasks_from_sheet(spark, sf):
    return tk.tasks_from_sheet(_cells(spark, sf))


@register(
    "task_normalise",
    "WITH " + _SHEET.strip()
    + """ SELECT 'sheet:s' || sn || ':order-' || o_orderkey AS reference, '[S' || sn || '] ' || task || ' · до ' || substr(due, 9, 2) || '.' || substr(due, 6, 2) || '.' || substr(due, 1, 4) AS title, owner,
           due AS due_iso, CAST(date_diff('day', DATE '1970-01-01', CAST(due AS DATE)) AS BIGINT) * 86400 + 43200 AS date_due,
           CASE status WHEN 'In Progress' THEN 'В работе' WHEN 'Done' THEN 'Выполнена' ELSE 'Новая' END AS ui_status, CASE priority WHEN 'High' THEN 'high' WHEN 'Low' THEN 'low' ELSE 'medium' END AS ui_priority, task AS ui_title
         FROM sh WHERE task <> '' AND owner <> ''""",
)
def task_normalise(spark, sf):
    tasks = tk.tasks_from_sheet(_cells(spark, sf))
    n = F.substring("sheet", 7, 1)
    return tk.normalize_tasks(tasks, F.concat(F.lit("s"), n), F.concat(F.lit("S"), n), "sheet")


@register(
    "panel_bind",
    "WITH " + _SHEET.strip()
    + """, f AS (SELECT sheet, task, row_number() OVER (PARTITION BY sheet ORDER BY o_orderkey) AS n FROM sh WHERE task <> '' AND owner <> '')
      SELECT g.group_id, CASE WHEN g.group_id IN ('sheet_0', 'sheet_1') THEN g.group_id || '.xlsx' END AS file_name, i.items FROM (SELECT 'sheet_' || r_regionkey AS group_id FROM region) g
      LEFT JOIN (SELECT sheet, string_agg(task, '|' ORDER BY n) AS items FROM f WHERE n <= 8 GROUP BY 1) i ON i.sheet = g.group_id""",
)
def panel_bind(spark, sf):
    groups = b.table(spark, sf, "region").select(F.concat(F.lit("sheet_"), "r_regionkey").alias("group_id"))
    files = groups.where("group_id in ('sheet_0', 'sheet_1')").withColumn("file_name", F.concat("group_id", F.lit(".xlsx")))
    tasks = tk.tasks_from_sheet(_cells(spark, sf)).withColumnRenamed("sheet", "group_id")
    out = tk.bind_panels(groups, files, tasks)
    return out.select("group_id", "file_name", F.when(F.col("items").isNotNull(), F.array_join("items", "|")).alias("items"))


@register(
    "latest_file",
    """SELECT o_custkey AS group_id, file FROM (SELECT o_custkey, 'f' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS file, row_number() OVER (PARTITION BY o_custkey
         ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, o_orderdate DESC, lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS n FROM orders) WHERE n = 1""",
)
def latest_file(spark, sf):
    rows = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("group_id"), F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("file"),
        F.when(F.col("o_orderstatus") == "F", "/x").alias("absolute_path"), F.col("o_orderdate").alias("date"),
    )
    return tk.latest_file(rows, "group_id").select("group_id", "file")


@register(
    "contract_docs",
    """SELECT o_orderkey, CASE WHEN l.doc_id IS NOT NULL THEN 'contracts/' || l.doc_id || '.txt' END AS relative_path, CASE WHEN l.doc_id IS NOT NULL THEN l.doc_id || '.txt' END AS file_name
       FROM orders LEFT JOIN labels l ON l.doc_id = o_orderkey""",
)
def contract_docs(spark, sf):
    contracts = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("name"))
    files = b.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("contracts/"), "doc_id", F.lit(".txt")).alias("relative_path")
    )
    return tk.attach_documents(contracts, files).select("o_orderkey", "relative_path", "file_name")
