"""The given tables in the roles the operators need.

Security columns, folders and paths are derived from document attributes with
arithmetic that SQL repeats exactly; people and grants are a short literal relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.operators import chunking as ch
from folioframe.operators import postings as po
from folioframe.operators import security as se
from folioframe.session import reuse, spread

LATIN = "[a-zA-ZÀ-ÿ]"
AS_OF = "2025-09-10"

USERS = [
    # employee, company, project, role, department, clearance, contractor
    ("emp_lead", "co_main", "prj_a", "Direktor", None, "confidential", None),
    ("emp_head", "co_main", "prj_a", "Chefmarkscheider", "dept_1", "confidential", None),
    ("emp_staff", "co_main", "prj_a", "Сотрудник подразделения", "dept_0", "restricted", None),
    ("emp_ctr", "co_main", "prj_a", "Подрядчик (external)", "dept_2", "internal", "ctr_b"),
    ("emp_none", "co_main", "prj_a", "Chefmarkscheider", None, "confidential", None),
    ("emp_other", "co_main", "prj_a", "Архивариус", "dept_1", "public", None),
]
USER_DDL = (
    "employee_id string, company_id string, project_id string, project_role string, "
    "department_id string, clearance string, contractor_id string"
)
GRANTS = [
    ("g1", "grant", "emp_staff", "folder_0", ["read", "write"], "2025-01-01", None, "active"),
    ("g2", "grant", "emp_staff", "folder_9", ["read"], "2025-01-01", "2025-06-30", "active"),
    ("g3", "deny", "emp_staff", "folder_3", ["read"], "2025-01-01", None, "active"),
    ("g4", "grant", "emp_ctr", "folder_8", ["read"], "2025-02-01", None, "active"),
    ("g5", "grant", "emp_other", "folder_4", ["read"], "2026-01-01", None, "active"),
    ("g6", "grant", "emp_staff", "folder_12", ["write"], "2025-03-01", None, "active"),
    ("g7", "deny", "emp_head", "folder_7", ["read"], "2025-03-01", None, "revoked"),
    ("g8", "grant", "emp_ctr", "folder_5", ["read"], "2025-03-01", None, "active"),
]
GRANT_DDL = (
    "grant_id string, grant_type string, employee_id string, folder_id string, actions array<string>, "
    "valid_from string, valid_to string, status string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(USERS, USER_DDL)
    return df.withColumn("dept_tree", F.lit(None).cast("array<string>"))


def grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRANTS, GRANT_DDL)


def _n():
    return F.substring("source", 4, 9).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with security columns, path and corpus."""
    labels = F.array(*[F.lit(x) for x in ("public", "internal", "restricted", "confidential")])
    kinds = F.array(*[F.lit(x) for x in (".txt", ".pdf", ".docx", ".dwg", ".vsdx", ".bak")])
    n = _n()
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("doc_id"),
        F.col("doc_id").alias("doc_no"),
        "text",
        "lang",
        "source",
        "n_chars",
        F.lit("co_main").alias("company_id"),
        F.when(n == 18, "prj_b").otherwise("prj_a").alias("project_id"),
        F.when(n == 5, "ctr_a").when(n == 8, "ctr_b").alias("contractor_id"),
        F.concat(F.lit("dept_"), n % 3).alias("department_id"),
        F.when(n != 2, F.concat(F.lit("folder_"), n)).alias("folder_id"),
        F.get(labels, (F.col("doc_id") % 4).cast("int")).alias("classification"),
        F.when(n < 10, "north").otherwise("south").alias("corpus_id"),
        F.concat(
            F.lit("archive/"), "source", F.lit("/"), "lang", F.lit("/File_"), F.col("doc_id"),
            F.get(kinds, (F.col("doc_id") % 6).cast("int")),
        ).alias("source_relative_path"),
    )


SECURITY_COLS = ["company_id", "project_id", "contractor_id", "department_id", "folder_id", "classification"]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir).drop("n_chars"), "doc_id")
    return ch.build_chunks(docs).withColumn("label_id", se.label_id())


_indexes: dict[tuple[str, str], po.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> po.Index:
    """The search index of the chunks, built once by a session for each folder of tables.

    It is built again if its files have gone, as where a shared folder is emptied.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not _present(_indexes[key].totals):
        _indexes[key] = po.build_index(chunks(spark, sf_dir))
    return _indexes[key]


def _present(written: DataFrame) -> bool:
    spark = written.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in written.inputFiles()]
    return bool(paths) and all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n()
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        F.concat(F.lit("folder_"), n).alias("folder_id"),
        F.when(n % 2 == 0, "sharepoint").otherwise("local").alias("storage_backend"),
        F.concat(F.lit("archive/"), "source").alias("physical_path"),
        F.lit("co_main").alias("company_id"),
        F.lit("prj_a").alias("project_id"),
        F.concat(F.lit("dept_"), n % 3).alias("department_id"),
        F.when(n % 4 == 0, "grant_only").when(n % 4 == 1, "department_restricted").when(n == 6, "project_open")
        .otherwise("department_open").alias("access_tier"),
        F.when(n % 5 == 0, "restricted").otherwise("internal").alias("default_classification"),
        F.when(n == 19, "inactive").otherwise("active").alias("status"),
    )


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = se.labels_of(documents(spark, sf_dir)).drop("n_chunks")
    return se.label_access(labels, users(spark), folders(spark, sf_dir), grants(spark), AS_OF)


def requests(spark: SparkSession, sf_dir: str, with_user: bool = True) -> tuple[DataFrame, DataFrame]:
    """(requests, scopes): every benchmark passage asked by every user that sees anything."""
    by_user, by_label = se.visibility_scopes(access(spark, sf_dir))
    bench = table(spark, sf_dir, "benchmark")
    people = F.array(*[F.lit(u[0]) for u in USERS])
    asked = bench.select("item_id", F.col("text").alias("query"), F.explode(people).alias("employee_id"))
    trace = F.concat_ws(":", F.col("item_id"), F.col("employee_id"))
    asked = asked.join(by_user, "employee_id").select(trace.alias("trace_id"), "query", "scope_id")
    return reuse(asked), reuse(by_label)


def open_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every benchmark passage asked once, with one scope that sees all labels.

    Both sides compute the scope from their rows: a literal would be folded away, and the
    joins on it would become products.
    """
    same = lambda c: (F.length(F.col(c).cast("string")) * 0).cast("bigint").alias("scope_id")
    scopes = se.labels_of(documents(spark, sf_dir)).select(same("label_id"), "label_id")
    bench = table(spark, sf_dir, "benchmark")
    asked = bench.select(F.col("item_id").cast("string").alias("trace_id"), F.col("text").alias("query"), same("item_id"))
    return asked, reuse(scopes)


SHORT = (1, 2, 4, 8)


def _short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of every benchmark passage as requests of their own: frequent words, few of them."""
    words = F.split(tx.strip(F.col("text")), r"\s+")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.array_join(F.slice(words, 1, n), " ").alias("query")) for n in SHORT]))
    rows = table(spark, sf_dir, "benchmark").select("item_id", each.alias("s"))
    return rows.select((F.col("item_id") * 10 + F.col("s.n")).alias("item_id"), "s.query")


def short_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, scopes): short requests asked by every user; one that may see nothing has a null scope."""
    by_user, by_label = se.visibility_scopes(access(spark, sf_dir))
    people = F.array(*[F.lit(u[0]) for u in USERS])
    asked = _short_texts(spark, sf_dir).select("*", F.explode(people).alias("employee_id")).join(by_user, "employee_id", "left")
    trace = F.concat_ws(":", F.col("item_id"), F.col("employee_id"))
    return reuse(asked.select(trace.alias("trace_id"), "query", "scope_id")), reuse(by_label)


def open_short_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Short requests asked once, with the scope that sees all labels."""
    _, scopes = open_requests(spark, sf_dir)
    zero = (F.col("item_id") * 0).alias("scope_id")
    return reuse(_short_texts(spark, sf_dir).select(F.col("item_id").cast("string").alias("trace_id"), "query", zero)), scopes


# --- the same derivations for DuckDB -------------------------------------------------------

SQL_DOCS = r"""
docs AS (
  SELECT 'doc_' || d.doc_id AS doc_id, d.doc_id AS doc_no, text, lang, source, n_chars,
         'co_main' AS company_id,
         CASE WHEN n = 18 THEN 'prj_b' ELSE 'prj_a' END AS project_id,
         CASE WHEN n = 5 THEN 'ctr_a' WHEN n = 8 THEN 'ctr_b' END AS contractor_id,
         'dept_' || (n % 3) AS department_id,
         CASE WHEN n <> 2 THEN 'folder_' || n END AS folder_id,
         ['public','internal','restricted','confidential'][CAST(d.doc_id % 4 AS INT) + 1] AS classification,
         CASE WHEN n < 10 THEN 'north' ELSE 'south' END AS corpus_id,
         'archive/' || source || '/' || lang || '/File_' || d.doc_id
           || ['.txt','.pdf','.docx','.dwg','.vsdx','.bak'][CAST(d.doc_id % 6 AS INT) + 1] AS source_relative_path
  FROM (SELECT *, CAST(substr(source, 4) AS INT) AS n FROM documents) d)
"""
SQL_CHUNKS = SQL_DOCS + r""",
bodies AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM docs),
chunks AS (
  SELECT b.*, 'chunk_' || doc_id || '_' || CASE WHEN i + 1 < 10 THEN '0' ELSE '' END || (i + 1) AS chunk_id,
         CAST(i + 1 AS INT) AS page, CAST(i * 896 AS INT) AS start_offset,
         CAST(least(length(body), i * 896 + 1024) AS INT) AS end_offset,
         substr(body, CAST(i * 896 + 1 AS BIGINT), 1024) AS content
  FROM bodies b, unnest(range(0, CASE WHEN length(body) <= 1024 THEN 1
       ELSE CAST(ceil((length(body) - 1024) / 896.0) AS BIGINT) + 1 END)) t(i)
  WHERE body <> '')
"""
SQL_SHORT = r"""
short AS (SELECT item_id * 10 + n AS item_id, array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:n], ' ') AS text
          FROM benchmark, (VALUES (1), (2), (4), (8)) t(n))
"""
SQL_FOLDERS = r"""
folders AS (
  SELECT 'folder_' || n AS folder_id, CASE WHEN n % 2 = 0 THEN 'sharepoint' ELSE 'local' END AS storage_backend,
         'archive/' || source AS physical_path, 'co_main' AS company_id, 'prj_a' AS project_id,
         'dept_' || (n % 3) AS department_id,
         CASE WHEN n % 4 = 0 THEN 'grant_only' WHEN n % 4 = 1 THEN 'department_restricted'
              WHEN n = 6 THEN 'project_open' ELSE 'department_open' END AS access_tier,
         CASE WHEN n % 5 = 0 THEN 'restricted' ELSE 'internal' END AS default_classification,
         CASE WHEN n = 19 THEN 'inactive' ELSE 'active' END AS status
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM documents))
"""


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ",".join(_lit(x) for x in v) + "]"
    return "'" + str(v) + "'"


def _values(name: str, cols: str, rows: list[tuple]) -> str:
    body = ",".join("(" + ",".join(_lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


SQL_USERS = _values("users", "employee_id,company_id,project_id,project_role,department_id,clearance,contractor_id", USERS)
SQL_GRANTS = _values("grants", "grant_id,grant_type,employee_id,folder_id,actions,valid_from,valid_to,status", GRANTS)
_RANK = "CASE {} WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'restricted' THEN 2 WHEN 'confidential' THEN 3 ELSE {} END"
SQL_FLAGS = f"""
flags AS (
  SELECT employee_id, folder_id,
         bool_or(grant_type = 'deny' AND list_contains(actions, 'read')) AS deny_read,
         bool_or(grant_type = 'deny' AND list_contains(actions, 'write')) AS deny_write,
         bool_or(grant_type = 'grant' AND list_contains(actions, 'read')) AS grant_read,
         bool_or(grant_type = 'grant' AND list_contains(actions, 'write')) AS grant_write
  FROM grants WHERE status = 'active' AND CAST(valid_from AS DATE) <= DATE '{AS_OF}'
    AND (valid_to IS NULL OR CAST(valid_to AS DATE) >= DATE '{AS_OF}')
  GROUP BY 1, 2)
"""


def sql_rank(col: str, unknown: int) -> str:
    return _RANK.format(col, unknown)


def sql_folder_action(action: str, u: str = "u", f: str = "f", g: str = "g") -> str:
    leader = f"{u}.project_role IN ('Direktor','Projektleiter','Projektleiter (Design)','group_admin')"
    head = f"{u}.project_role IN ('Chefmarkscheider','Начальник подразделения','Начальник участка')"
    own = f"{u}.department_id IS NOT DISTINCT FROM {f}.department_id"
    active = f"coalesce({f}.status = 'active', false)"
    if action == "delete":
        return (
            f"CASE WHEN {leader} THEN true WHEN {head} AND {active} AND {own} THEN true "
            f"WHEN {u}.project_role = 'Сотрудник подразделения' THEN false ELSE {head} END"
        )
    denied = f"coalesce({g}.deny_read, false)" + (f" OR coalesce({g}.deny_write, false)" if action == "write" else "")
    return (
        f"CASE WHEN NOT {active} THEN false WHEN {denied} THEN false WHEN {leader} THEN true "
        f"WHEN {head} AND {own} THEN true WHEN NOT ({own}) THEN false "
        f"WHEN {f}.access_tier = 'department_open' THEN true "
        f"WHEN {f}.access_tier IN ('department_restricted','grant_only') THEN coalesce({g}.grant_{action}, false) ELSE false END"
    )


SQL_SCOPE = (
    "CASE {r} WHEN 'ГИП' THEN 'S_dept_tree' WHEN 'Главный инженер проекта' THEN 'S_dept_tree' "
    "WHEN 'Hauptingenieur' THEN 'S_dept_tree' WHEN 'Chefmarkscheider' THEN 'S_dept' "
    "WHEN 'Сотрудник подразделения' THEN 'S_dept' WHEN 'Начальник участка' THEN 'S_dept' "
    "WHEN 'Подрядчик (external)' THEN 'S_dept' ELSE 'S_project' END"
)


def sql_visible(rows: str = "chunks", key: str = "chunk_id") -> str:
    """CTE ``visible``(employee_id, key) for rows with security columns."""
    scope = SQL_SCOPE.format(r="u.project_role")
    return f"""
visible AS (
  SELECT u.employee_id, c.{key}
  FROM {rows} c JOIN users u ON c.company_id = u.company_id AND c.project_id = u.project_id
  LEFT JOIN folders f ON c.folder_id = f.folder_id
  LEFT JOIN flags g ON g.employee_id = u.employee_id AND g.folder_id = c.folder_id
  WHERE {sql_rank('c.classification', 99)} <= {sql_rank('u.clearance', -1)}
    AND (u.contractor_id IS NULL OR c.contractor_id IS NULL OR c.contractor_id = u.contractor_id)
    AND CASE {scope} WHEN 'S_project' THEN true
        ELSE u.department_id IS NOT NULL AND c.department_id = u.department_id END
    AND (c.folder_id IS NULL OR {sql_folder_action('read')}))
"""


SQL_SECURE = ", ".join([SQL_CHUNKS, SQL_FOLDERS, SQL_USERS, SQL_GRANTS, SQL_FLAGS])
