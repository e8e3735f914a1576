"""Row, folder and tool security on documents; people and grants are a short relation."""

from pyspark.sql import functions as F

from folioframe import fixed_values as fx

from folioframe.operators import security as se
from folioframe.plans import bindings as b
from folioframe.plans.registry import register
from folioframe.plans.text_queries import _pick, _sql_pick


def _with(*parts):
    return "WITH " + ", ".join(p.strip() for p in parts)


_LEVELS = ("public", "internal", "restricted", "confidential", "secret")
_USER_LEVELS = ("internal", "confidential", "guest", "public")


@register(
    "clearance_allows",
    f"""SELECT doc_id, {b.sql_rank(_sql_pick('doc_id', *_LEVELS), 99)} <= {b.sql_rank(_sql_pick('n_chars', *_USER_LEVELS), -1)} AS allowed,
           {b.sql_rank(_sql_pick('doc_id', *_LEVELS), 99)} >= {b.sql_rank(_sql_pick('n_chars', *_USER_LEVELS), 0)} AS meets_minimum FROM documents""",
)
def clearance_allows(spark, sf):
    doc, user = _pick("doc_id", *_LEVELS), _pick("n_chars", *_USER_LEVELS)
    return b.table(spark, sf, "documents").select(
        "doc_id", se.clearance_allows(doc, user).alias("allowed"), se.meets_minimum(doc, user).alias("meets_minimum")
    )


@register(
    "active_as_of",
    """SELECT o_orderkey, o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30'
         AND (o_orderpriority = '1-URGENT' OR CAST(o_orderdate AS DATE) + 400 >= DATE '1997-06-30') AS active FROM orders""",
)
def active_as_of(spark, sf):
    start = F.to_date("o_orderdate")
    rows = b.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", "active").otherwise("revoked").alias("status"),
        start.alias("valid_from"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.date_add(start, 400)).alias("valid_to"),
    )
    return rows.select("o_orderkey", se.active_as_of(F.lit("1997-06-30").cast("date")).alias("active"))


_ROLES = ("Direktor", "ГИП", "Chefmarkscheider", "Начальник участка", "group_admin", "Гость", "Подрядчик (external)")


@register(
    "department_scope",
    f"""WITH r AS (SELECT doc_id, {_sql_pick('doc_id', *_ROLES)} AS role, CASE WHEN doc_id % 4 <> 0 THEN 'dept_' || (doc_id % 3) END AS ud,
           CASE WHEN n_chars % 5 <> 0 THEN 'dept_' || (n_chars % 3) END AS cd FROM documents),
        s AS (SELECT *, {b.SQL_SCOPE.format(r='role')} AS scope FROM r)
        SELECT doc_id, scope, CASE WHEN scope = 'S_project' THEN true WHEN ud IS NULL OR cd IS NULL THEN false
          WHEN scope = 'S_dept' THEN cd = ud ELSE cd = ud OR (cd = 'dept_2' AND doc_id % 2 = 0) END AS allowed FROM s""",
)
def department_scope(spark, sf):
    scope = se.department_scope(_pick("doc_id", *_ROLES))
    user = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("dept_"), F.col("doc_id") % 3))
    chunk = F.when(F.col("n_chars") % 5 != 0, F.concat(F.lit("dept_"), F.col("n_chars") % 3))
    tree = F.when(F.col("doc_id") % 2 == 0, F.array(user, F.lit("dept_2")))
    return b.table(spark, sf, "documents").select(
        "doc_id", scope.alias("scope"), se.department_allowed(scope, user, tree, chunk).alias("allowed")
    )


@register(
    "rls_filter",
    _with(b.SQL_SECURE, b.sql_visible()) + " SELECT employee_id, chunk_id FROM visible",
)
def rls_filter(spark, sf):
    return se.rls_filter(b.chunks(spark, sf), b.access(spark, sf)).select("employee_id", "chunk_id")


@register(
    "rls_filter_extra",
    _with(b.SQL_SECURE, b.sql_visible())
    + " SELECT employee_id, chunk_id FROM visible JOIN chunks USING (chunk_id) WHERE lang = 'en' AND department_id = 'dept_1'",
)
def rls_filter_extra(spark, sf):
    mine = b.chunks(spark, sf).where((F.col("lang") == "en") & (F.col("department_id") == "dept_1"))
    return se.rls_filter(mine, b.access(spark, sf)).select("employee_id", "chunk_id")


@register(
    "visibility_by_user",
    _with(b.SQL_SECURE, b.sql_visible())
    + " SELECT employee_id, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM visible JOIN chunks USING (chunk_id) GROUP BY 1",
)
def visibility_by_user(spark, sf):
    rows = se.rls_filter(b.chunks(spark, sf), b.access(spark, sf))
    return rows.groupBy("employee_id").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


@register(
    "folder_acl",
    _with(b.SQL_FOLDERS, b.SQL_USERS, b.SQL_GRANTS, b.SQL_FLAGS)
    + f""" SELECT u.employee_id, f.folder_id, {b.sql_folder_action('read')} AS can_read, {b.sql_folder_action('write')} AS can_write,
            {b.sql_folder_action('delete')} AS can_delete
         FROM users u JOIN folders f ON true LEFT JOIN flags g ON g.employee_id = u.employee_id AND g.folder_id = f.folder_id""",
)
def folder_acl(spark, sf):
    folders = b.folders(spark, sf)
    people = F.array(*[F.lit(u[0]) for u in b.USERS])
    pairs = folders.select("folder_id", F.explode(people).alias("employee_id"))
    return se.folder_acl(b.users(spark), pairs, folders, b.grants(spark), b.AS_OF)


@register(
    "grants_join",
    _with(b.SQL_FOLDERS, b.SQL_GRANTS, b.SQL_FLAGS)
    + """ SELECT f.folder_id, employee_id, deny_read, deny_write, grant_read, grant_write FROM folders f JOIN flags USING (folder_id)""",
)
def grants_join(spark, sf):
    return b.folders(spark, sf).select("folder_id").join(se.grant_flags(b.grants(spark), b.AS_OF), "folder_id")


_GATE_DOCS = """
rq AS (SELECT d.doc_id AS request_id, u.employee_id, d.classification, d.doc_no, d.project_id AS doc_project,
         CASE WHEN fo.status = 'active' THEN fo.folder_id END AS folder_id, u.company_id, u.project_id, u.project_role, u.department_id, u.clearance
       FROM docs d JOIN users u ON u.employee_id = ['emp_lead','emp_head','emp_staff','emp_ctr','emp_none','emp_other'][CAST(d.doc_no % 6 AS INT) + 1]
       LEFT JOIN folders fo ON starts_with(d.source_relative_path, fo.physical_path || '/'))
"""


def _gate_requests(spark, sf):
    docs = b.documents(spark, sf)
    resolved = se.resolve_folders(docs, b.folders(spark, sf), "doc_id", "source_relative_path")
    return docs.join(resolved, "doc_id").select(
        F.col("doc_id").alias("request_id"),
        _pick("doc_no", *[u[0] for u in b.USERS]).alias("employee_id"),
        "classification",
        F.col("resolved_folder_id").alias("folder_id"),
    )


@register(
    "ingest_gate",
    _with(b.SQL_DOCS, b.SQL_FOLDERS, b.SQL_USERS, b.SQL_GRANTS, b.SQL_FLAGS, _GATE_DOCS)
    + f""" SELECT request_id, u.employee_id, u.folder_id, code IS NULL AS allowed, code AS error_code FROM (
           SELECT u.*, CASE WHEN {b.sql_rank('u.classification', 99)} > {b.sql_rank('u.clearance', -1)} THEN 'INGEST_CLEARANCE_DENIED'
             WHEN u.folder_id IS NULL OR coalesce(f.status <> 'active', true) THEN 'INGEST_FOLDER_DENIED'
             WHEN f.company_id <> u.company_id OR f.project_id <> u.project_id THEN 'INGEST_FOLDER_DENIED'
             WHEN {b.sql_rank('f.default_classification', 99)} > {b.sql_rank('u.clearance', -1)} THEN 'INGEST_CLEARANCE_DENIED'
             WHEN {b.sql_rank('u.classification', 99)} < {b.sql_rank('f.default_classification', 0)} THEN 'INGEST_FOLDER_DENIED'
             WHEN NOT ({b.sql_folder_action('write')}) THEN 'INGEST_FOLDER_DENIED' END AS code
           FROM rq u LEFT JOIN folders f USING (folder_id) LEFT JOIN flags g ON g.employee_id = u.employee_id AND g.folder_id = u.folder_id) u""",
)
def ingest_gate(spark, sf):
    return se.ingest_gate(_gate_requests(spark, sf), b.users(spark), b.folders(spark, sf), b.grants(spark), b.AS_OF)


@register(
    "delete_gate",
    _with(b.SQL_DOCS, b.SQL_FOLDERS, b.SQL_USERS, b.SQL_GRANTS, b.SQL_FLAGS, _GATE_DOCS)
    + f""" SELECT request_id, u.employee_id, u.folder_id, code IS NULL AS allowed, code AS error_code FROM (
           SELECT u.*, CASE WHEN u.folder_id IS NULL THEN 'INGEST_FOLDER_DENIED' WHEN NOT ({b.sql_folder_action('delete')}) THEN 'INGEST_DELETE_DENIED' END AS code
           FROM rq u LEFT JOIN folders f USING (folder_id) LEFT JOIN flags g ON g.employee_id = u.employee_id AND g.folder_id = u.folder_id) u""",
)
def delete_gate(spark, sf):
    return se.delete_gate(_gate_requests(spark, sf), b.users(spark), b.folders(spark, sf), b.grants(spark), b.AS_OF)


@register(
    "folder_longest_prefix",
    _with(b.SQL_DOCS)
    + """, fl AS (SELECT DISTINCT 'archive/' || source AS prefix, 'root_' || source AS fid, true AS act FROM docs
             UNION ALL SELECT DISTINCT 'archive/' || source || '/' || lang, 'leaf_' || source || lang, lang <> 'de' FROM docs)
       SELECT doc_id, arg_max(fid, length(prefix)) AS folder_id FROM docs JOIN fl ON act AND starts_with(source_relative_path, prefix || '/') GROUP BY 1""",
)
def folder_longest_prefix(spark, sf):
    docs = b.documents(spark, sf)
    roots = docs.select(
        F.concat(F.lit("archive/"), "source", F.lit("/")).alias("physical_path"), F.concat(F.lit("root_"), "source").alias("folder_id"),
        F.lit("active").alias("status"),
    ).distinct()
    leaves = docs.select(
        F.concat(F.lit("archive\\"), "source", F.lit("\\"), "lang").alias("physical_path"),
        F.concat(F.lit("leaf_"), "source", "lang").alias("folder_id"),
        F.when(F.col("lang") == "de", "inactive").otherwise("active").alias("status"),
    ).distinct()
    found = se.resolve_folders(docs, roots.unionByName(leaves), "doc_id", "source_relative_path")
    return found.withColumnRenamed("resolved_folder_id", "folder_id")


@register(
    "policy_context",
    """WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS employee_id, 'co_' || (c_custkey % 4) AS own_co,
                   CASE WHEN c_mktsegment = 'MACHINERY' THEN 'inactive' ELSE 'active' END AS status,
                   CASE c_nationkey % 5 WHEN 4 THEN 'top' ELSE ['public','internal','restricted','confidential'][CAST(c_nationkey % 5 AS INT) + 1] END AS clearance FROM customer),
        a AS (SELECT CAST(o_custkey AS VARCHAR) AS employee_id, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'co_' || (o_orderkey % 4) END AS co,
                'prj_' || (o_orderkey % 3) AS project_id, CASE WHEN o_orderkey % 7 = 0 THEN 'group_admin' ELSE 'Direktor' END AS project_role
              FROM orders WHERE o_orderpriority <> '5-LOW' AND CAST(o_orderdate AS DATE) <= DATE '1998-01-01' AND o_orderstatus <> 'P'),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY o_orderkey) AS n FROM a) WHERE n = 1),
        j AS (SELECT e.*, coalesce(f.co, e.own_co) AS company, f.project_id, f.project_role,
                CASE WHEN e.status <> 'active' THEN 'inactive_employee' WHEN f.project_role IS NULL THEN 'no_project_role' WHEN e.clearance = 'top' THEN 'bad_clearance' END AS error
              FROM e LEFT JOIN f USING (employee_id))
       SELECT employee_id, CASE WHEN error IS NULL THEN company END AS company_id, CASE WHEN error IS NULL THEN project_id END AS project_id,
         CASE WHEN error IS NULL THEN project_role END AS project_role, CASE WHEN error IS NULL THEN clearance END AS clearance,
         CASE WHEN error IS NULL AND project_role = 'group_admin' AND company <> 'co_0' THEN 'group_' || substr(company, 4) END AS company_group_id, error FROM j""",
)
def policy_context(spark, sf):
    """Customers as employees, their orders as assignments."""
    levels = F.array(*[F.lit(x) for x in ("public", "internal", "restricted", "confidential", "top")])
    none = F.lit(None).cast("string")
    employees = b.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("employee_id"),
        F.concat(F.lit("co_"), F.col("c_custkey") % 4).alias("company_id"),
        none.alias("contractor_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "inactive").otherwise("active").alias("status"),
        F.get(levels, F.col("c_nationkey") % 5).alias("clearance"),
    )
    assignments = b.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("employee_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.when(F.col("o_orderpriority") == "5-LOW", "department").otherwise("project_role").alias("assignment_type"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("co_"), F.col("o_orderkey") % 4)).alias("company_id"),
        F.concat(F.lit("prj_"), F.col("o_orderkey") % 3).alias("project_id"),
        F.when(F.col("o_orderkey") % 7 == 0, "group_admin").otherwise("Direktor").alias("project_role"),
        none.alias("department_id"),
        F.to_date("o_orderdate").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.when(F.col("o_orderstatus") == "P", "revoked").otherwise("active").alias("status"),
    )
    companies = employees.select("company_id").distinct().select(
        "company_id",
        F.when(F.col("company_id") != "co_0", F.concat(F.lit("group_"), F.substring("company_id", 4, 9))).alias("company_group_id"),
    )
    rows = se.policy_contexts(employees, assignments, companies, "1998-01-01", "production")
    return rows.select("employee_id", "company_id", "project_id", "project_role", "clearance", "company_group_id", "error")


_GATES = [
    ("click", ["development", "production"], ["leadership", "site_ops"], ["finance_hr"]),
    ("view", ["production"], [], ["contractor"]),
    ("error", ["development"], ["leadership"], []),
    ("purchase", ["staging", "production"], ["engineering_leads", "finance_hr"], ["it"]),
]
_GROUPS = {"leadership": ["Direktor", "Projektleiter"], "site_ops": ["Начальник участка"], "it": ["ИТ"]}
_CALL_ROLES = ("Direktor", "Chefmarkscheider", "Подрядчик (external)", "Бухгалтерия", "ИТ", "Гость")
_CALL_GROUPS = ("leadership", "site_ops", "contractor", "finance_hr", "it", "-")


@register(
    "tool_gate",
    "WITH "
    + b._values("gates", "tool_id,envs,allow,deny", _GATES).replace("[]", "[]::VARCHAR[]")
    + f""", c AS (SELECT event_id, event_type AS tool_id, {_sql_pick('user_id', *fx.VALID_ENVS)} AS env, {_sql_pick('event_id', *_CALL_GROUPS)} AS grp FROM events)
       SELECT event_id, r IS NULL AS allowed, r AS deny_reason FROM (SELECT event_id, CASE WHEN envs IS NULL THEN 'tool_disabled'
         WHEN NOT list_contains(envs, env) THEN 'env_not_allowed' WHEN list_contains(deny, grp) THEN 'insufficient_role'
         WHEN len(allow) > 0 AND NOT list_contains(allow, grp) THEN 'insufficient_role' END AS r FROM c LEFT JOIN gates USING (tool_id))""",
)
def tool_gate(spark, sf):
    gates = spark.createDataFrame(
        _GATES, "tool_id string, env_allowlist array<string>, allow_role_groups array<string>, deny_role_groups array<string>"
    )
    calls = b.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("tool_id"), _pick("user_id", *fx.VALID_ENVS).alias("env"),
        _pick("event_id", *_CALL_ROLES).alias("project_role"),
    )
    return se.tool_gate(calls, gates, _GROUPS).select("event_id", "allowed", "deny_reason")


_KINDS = ("deny", "grant", "revoke")


@register(
    "grant_validity",
    _with(b.SQL_DOCS, b.SQL_FOLDERS)
    + f""", r AS (SELECT doc_id, {_sql_pick('doc_no', 'Chefmarkscheider', 'Начальник участка', 'Chefmarkscheider', 'Direktor')} AS role,
              'dept_' || (n_chars % 3) AS dept, {_sql_pick('doc_no', *_KINDS)} AS kind, 'folder_' || substr(source, 4) AS folder_id, doc_no % 5 = 0 AS del FROM docs)
       SELECT doc_id, CASE WHEN role = 'Direktor' THEN 'not_department_head' WHEN dept <> f.department_id THEN 'other_department'
         WHEN kind = 'deny' AND access_tier <> 'department_open' THEN 'deny_needs_open_folder'
         WHEN kind = 'grant' AND access_tier NOT IN ('department_restricted', 'grant_only') THEN 'grant_needs_closed_folder'
         WHEN kind = 'grant' AND del THEN 'delete_not_grantable' END AS error_code FROM r JOIN folders f USING (folder_id)""",
)
def grant_validity(spark, sf):
    rows = b.documents(spark, sf).select(
        "doc_id",
        _pick("doc_no", "Chefmarkscheider", "Начальник участка", "Chefmarkscheider", "Direktor").alias("granter_role"),
        F.concat(F.lit("dept_"), F.col("n_chars") % 3).alias("granter_department"),
        _pick("doc_no", *_KINDS).alias("kind"),
        F.concat(F.lit("folder_"), F.substring("source", 4, 9)).alias("folder_id"),
        F.when(F.col("doc_no") % 5 == 0, F.array(F.lit("read"), F.lit("delete"))).otherwise(F.array(F.lit("read"))).alias("actions"),
    )
    return se.grant_requests_check(rows, b.folders(spark, sf)).select("doc_id", "error_code")


@register(
    "egress_route",
    f"""WITH r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'cloudy' WHEN lang = 'de' THEN 'closed' ELSE 'mixed' END AS corpus_id,
            {_sql_pick('doc_id', 'openai', 'ollama', 'stub', 'anthropic')} AS provider, doc_id % 6 = 0 AS explicit FROM documents),
        t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
       SELECT doc_id, corpus_id, CASE WHEN cloud AND (corpus_id = 'closed' OR tox) THEN 'stub' ELSE provider END AS provider,
         CASE WHEN cloud AND corpus_id = 'closed' THEN 'cloud_blocked_by_corpus' WHEN cloud AND tox THEN 'cloud_blocked_by_path'
              WHEN corpus_id = 'cloudy' AND NOT cloud AND explicit THEN 'cloud_recommended' WHEN corpus_id = 'cloudy' AND NOT cloud THEN 'cloud_unavailable' END AS note
       FROM (SELECT r.*, provider IN ('openai', 'anthropic') AS cloud, t.doc_id IS NOT NULL AS tox FROM r LEFT JOIN t USING (doc_id))""",
)
def egress_route(spark, sf):
    """Toxic documents stand for paths of the closed corpus in the context."""
    policies = spark.createDataFrame(
        [("cloudy", False, True), ("closed", True, False), ("mixed", False, False)], "corpus_id string, local_only boolean, cloud_only boolean"
    )
    corpus = F.when(F.col("lang") == "en", "cloudy").when(F.col("lang") == "de", "closed").otherwise("mixed")
    asks = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"), corpus.alias("corpus_id"),
        _pick("doc_id", "openai", "ollama", "stub", "anthropic").alias("provider"), (F.col("doc_id") % 6 == 0).alias("explicit"),
    )
    touched = b.table(spark, sf, "labels").select(
        F.col("doc_id").alias("request_id"), F.when(F.col("toxic") == 1, "closed").otherwise("mixed").alias("corpus_id")
    )
    return se.egress_route(asks, policies, touched).withColumnRenamed("request_id", "doc_id")


@register(
    "consent_gate",
    f"""SELECT event_id, c IS NULL AS allowed, c AS error_code FROM (SELECT event_id, CASE WHEN user_id % 4 = 3 THEN 'role_denied'
          WHEN event_type = 'purchase' AND value < 20 THEN 'consent_required' END AS c FROM events)""",
)
def consent_gate(spark, sf):
    rows = b.table(spark, sf, "events").select(
        "event_id", _pick("user_id", "Кадры", "hr", "security", "Direktor").alias("actor_role"),
        F.when(F.col("event_type") == "purchase", "save").otherwise("load").alias("action"), (F.col("value") >= 20).alias("consent_signed"),
    )
    return se.consent_gate(rows).select("event_id", "allowed", "error_code")


@register(
    "law_check_policy",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'always' WHEN o_orderpriority = '1-URGENT' THEN 'on_user_request' ELSE 'never' END AS law_check FROM orders""",
)
def law_check_policy(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "contract").otherwise("letter")
    return b.table(spark, sf, "orders").select(
        "o_orderkey", se.law_check(kind, F.col("o_orderpriority") == "1-URGENT").alias("law_check")
    )


@register(
    "grant_supersede",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) > 1
          THEN 'revoked' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'expired' END AS status FROM orders""",
)
def grant_supersede(spark, sf):
    rows = b.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_custkey").alias("employee_id"), F.col("o_orderpriority").alias("folder_id"),
        F.lit("grant").alias("grant_type"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("expired").alias("status"),
    )
    return se.supersede_grants(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "status")


@register(
    "department_folders",
    _with(b.SQL_FOLDERS)
    + " SELECT department_id, count(*) AS folders, string_agg(folder_id, ' ' ORDER BY folder_id) AS ids FROM folders WHERE status = 'active' GROUP BY 1",
)
def department_folders(spark, sf):
    live = b.folders(spark, sf).where(F.col("status") == "active")
    ids = F.array_join(F.array_sort(F.collect_list("folder_id")), " ")
    return live.groupBy("department_id").agg(F.count("*").alias("folders"), ids.alias("ids"))


@register(
    "temp_or_oversize",
    _with(b.SQL_DOCS)
    + " SELECT doc_id, CASE WHEN doc_no % 9 = 0 THEN 'skip_temp' WHEN n_chars > 5000 THEN 'too_large' END AS reason FROM docs",
)
def temp_or_oversize(spark, sf):
    from folioframe.functions import text as tx
    from folioframe.sources import archive as ar

    name = F.concat(F.when(F.col("doc_no") % 9 == 0, "~$").otherwise(""), tx.base_name(F.col("source_relative_path")))
    return b.documents(spark, sf).select("doc_id", ar.temp_or_oversize(name, F.col("n_chars"), 5000).alias("reason"))


