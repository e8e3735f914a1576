"""Task sheets, boards and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe import fixed_values as fx
from folioframe.functions import text as tx


def tasks_from_sheet(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Rows below the header row of each sheet, as named columns.

    ``cells``: sheet, ordinal, values (array of strings).  The header is the first
    row with both "due date" and "owner".
    """
    names = F.transform("values", lambda v: F.lower(tx.strip(F.coalesce(v, F.lit("")))))
    rows = cells.withColumn("_names", names)
    is_header = F.array_contains("_names", "due date") & F.array_contains("_names", "owner")
    head = rows.where(is_header).groupBy(sheet).agg(
        F.min("ordinal").alias("_head"), F.min_by("_names", "ordinal").alias("_cols")
    )
    below = rows.join(head, sheet).where(F.col("ordinal") > F.col("_head"))

    def cell(*headers: str) -> Column:
        found = []
        for h in headers:
            at = F.array_position("_cols", h).cast("int")
            value = F.when(at > 0, F.get(F.col("values"), at - 1))
            found.append(F.nullif(tx.strip(F.coalesce(value, F.lit(""))), F.lit("")))
        return F.coalesce(*found, F.lit(""))

    return (
        below.select(
            sheet,
            "ordinal",
            cell("project / task", "task").alias("task"),
            cell("owner").alias("owner"),
            cell("due date").alias("due"),
            F.coalesce(F.nullif(cell("status"), F.lit("")), F.lit("Planning")).alias("status"),
            F.coalesce(F.nullif(cell("priority"), F.lit("")), F.lit("Normal")).alias("priority"),
            cell("notes").alias("notes"),
        )
        .where((F.col("task") != "") & ~F.lower("task").startswith("task name") & (F.col("owner") != ""))
    )


def task_status(c: Column) -> Column:
    known = tx.lookup(fx.TASK_STATUS, F.lower(tx.strip(F.coalesce(c, F.lit("")))))
    return F.coalesce(known, F.nullif(c, F.lit("")), F.lit(fx.TASK_STATUS_DEFAULT))


def task_priority(c: Column) -> Column:
    p = F.lower(tx.strip(F.coalesce(c, F.lit(""))))
    return F.when(p.isin("high", "low"), p).otherwise("medium")


def due_epoch(day: Column) -> Column:
    """Noon UTC of the due day (0 without one)."""
    d = F.try_to_date(day, "yyyy-MM-dd")
    return F.coalesce(F.datediff(d, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + 43200, F.lit(0))


def normalize_tasks(tasks: DataFrame, site: Column, site_label: Column, prefix: str) -> DataFrame:
    """Reference, card title, mapped status and priority, due time."""
    iso = F.substring("due", 1, 10)
    d = F.try_to_date(iso, "yyyy-MM-dd")
    human = F.coalesce(F.date_format(d, "dd.MM.yyyy"), iso)
    sticky = F.coalesce(F.nullif("notes", F.lit("")), "task")
    title = F.concat(F.lit("["), site_label, F.lit("] "), sticky)
    return tasks.select(
        F.concat_ws(":", F.lit(prefix), site, tx.slug(F.col("task"))).alias("reference"),
        F.when(human != "", F.concat(title, F.lit(" · до "), human)).otherwise(title).alias("title"),
        "owner",
        iso.alias("due_iso"),
        due_epoch(iso).alias("date_due"),
        task_status(F.col("status")).alias("ui_status"),
        task_priority(F.col("priority")).alias("ui_priority"),
        sticky.alias("ui_title"),
    )


def bind_panels(groups: DataFrame, files: DataFrame, tasks: DataFrame, preview: int = 8) -> DataFrame:
    """Each panel with its file and the first rows of it (``preview`` at most)."""
    w = Window.partitionBy("group_id").orderBy("ordinal")
    first = tasks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= preview)
    items = first.groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "task"))), lambda s: s["task"]).alias("items")
    )
    return groups.join(files.select("group_id", "file_name"), "group_id", "left").join(items, "group_id", "left")


def latest_file(files: DataFrame, group: str) -> DataFrame:
    """Newest file of each group; one with a path comes before a newer one without."""
    has_path = F.coalesce("absolute_path", F.lit("")) != ""
    w = Window.partitionBy(group).orderBy(has_path.desc(), F.col("date").desc(), "file")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def attach_documents(contracts: DataFrame, files: DataFrame) -> DataFrame:
    """Contract rows with their file (null when there is none)."""
    return contracts.join(files.select("name", "relative_path"), "name", "left").withColumn(
        "file_name", tx.base_name(F.col("relative_path"))
    )


def dashboard_kpis(
    contracts: DataFrame, overdue: DataFrame, risks: DataFrame, debtors: DataFrame, categories: list[str]
) -> DataFrame:
    """Figures per scope and for "all".

    Each fact table is aggregated by (rollup of) scope on its own; only the few scope
    rows are joined.
    """

    def rolled(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.rollup("scope").agg(*aggs).withColumn("scope", F.coalesce("scope", F.lit("all")))

    money = rolled(
        contracts,
        F.count("*").alias("contracts"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in categories],
        F.round(F.sum("amount"), 2).alias("amount"),
    )
    late = rolled(overdue, F.count("*").alias("overdue_items"))
    bad = rolled(risks, F.count_if(F.col("level") != fx.MEDIUM_RISK).alias("risks"))
    debt = rolled(debtors, F.round(F.sum("overdue"), 2).alias("debt"))
    out = money.join(late, "scope", "left").join(bad, "scope", "left").join(debt, "scope", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("overdue_items", "risks")}
    out = out.withColumns({**zero, "debt": F.coalesce("debt", F.lit(0.0))})
    share = F.floor(F.col("debt") / F.greatest("amount", F.lit(1.0)) * 100 + 0.5)
    return out.withColumn("debt_pct", F.least(share, F.lit(99)).cast("bigint"))


def high_risks(risks: DataFrame, levels: list[str]) -> DataFrame:
    return risks.agg(F.count_if(F.col("level").isin(levels)).alias("high_risks"))


def finance_bars(series: DataFrame, columns: list[str]) -> DataFrame:
    """Bar heights 42 + v / max * 170, with the maximum (at least 1) over all columns."""
    top = series.agg(F.greatest(*[F.max(c) for c in columns], F.lit(1.0)).alias("_top"))
    return series.join(top).select(
        "ym", *[F.round(F.lit(42.0) + F.col(c) / F.col("_top") * 170, 4).alias(f"{c}_height") for c in columns]
    )


def expenses_between(expenses: DataFrame, start: str, end: str) -> DataFrame:
    """Expenses of the months from ``start`` to ``end`` with their maximum (at least 1)."""
    rows = expenses.where(F.col("ym").between(start, end))
    top = rows.agg(F.greatest(F.max("amount"), F.lit(1.0)).alias("max_amount"))
    return rows.join(top)


def board_columns(tasks: DataFrame, columns: list[str], scope: str = "all", group: str = "all") -> DataFrame:
    """Cards with the board column they are shown in; other statuses are not shown."""
    rows = tasks.where(F.col("status").isin(columns))
    if scope != "all":
        rows = rows.where(F.col("scope") == scope)
    if group != "all":
        rows = rows.where(F.col("group_id") == group)
    return rows


def board_counts(tasks: DataFrame, columns: list[str], scope: str = "all", group: str = "all") -> DataFrame:
    return board_columns(tasks, columns, scope, group).groupBy("status").agg(F.count("*").alias("cards"))


def attention(contracts: DataFrame, category: str | None = None, low: str = fx.LOW_RISK) -> DataFrame:
    """Contracts whose risk is not low, or those of one category."""
    return contracts.where(F.col("risk") != low) if category is None else contracts.where(F.col("category") == category)
