"""Row, folder and tool security as joins and predicates.

What a user may read depends only on a chunk's *label*: company, project,
contractor, department, folder and classification.  Labels are few, so access is
decided once per (user, label) on small tables and reaches the chunks through an
equi-join on ``label_id``; it never pairs users with chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe import fixed_values as fx
from folioframe.functions import text as tx

LABEL_COLS = ["company_id", "project_id", "contractor_id", "department_id", "folder_id", "classification"]


def clearance_rank(label: Column, unknown: int) -> Column:
    pairs = [F.lit(x) for kv in fx.CLEARANCE_RANK.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[label], F.lit(unknown))


def clearance_allows(classification: Column, clearance: Column) -> Column:
    return clearance_rank(classification, fx.UNKNOWN_LABEL_RANK) <= clearance_rank(
        clearance, fx.UNKNOWN_USER_RANK
    )


def meets_minimum(classification: Column, minimum: Column) -> Column:
    return clearance_rank(classification, fx.UNKNOWN_LABEL_RANK) >= clearance_rank(minimum, 0)


def active_as_of(as_of: Column) -> Column:
    """status, valid_from and valid_to of the current row at a date."""
    return (
        (F.col("status") == "active")
        & (F.col("valid_from").cast("date") <= as_of)
        & (F.col("valid_to").isNull() | (F.col("valid_to").cast("date") >= as_of))
    )


def department_scope(role: Column, default_scope: str = fx.DEFAULT_SCOPE) -> Column:
    return F.coalesce(tx.lookup(fx.ROLE_SCOPE, role), F.lit(default_scope))


def department_allowed(scope: Column, user_dept: Column, dept_tree: Column, chunk_dept: Column) -> Column:
    tree = F.coalesce(dept_tree, F.array(user_dept))
    has_user = F.coalesce(user_dept, F.lit("")) != ""
    return (
        F.when(scope == "S_project", True)
        .when(~has_user | chunk_dept.isNull(), False)
        .when(scope == "S_dept", chunk_dept == user_dept)
        .when(scope == "S_dept_tree", F.array_contains(tree, chunk_dept))
        .otherwise(False)
    )


def label_id() -> Column:
    """Stable id of a row's security label: a cryptographic hash, as it decides who may read.

    JSON keeps the fields apart and a missing one apart from an empty one.
    """
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in LABEL_COLS])), 256)


def labels_of(chunks: DataFrame) -> DataFrame:
    """Distinct labels (partial aggregation leaves one row per label and task)."""
    return chunks.groupBy(label_id().alias("label_id"), *LABEL_COLS).count().withColumnRenamed("count", "n_chunks")


def grant_flags(grants: DataFrame, as_of: str) -> DataFrame:
    """Active grants and denies per (employee, folder) as booleans."""
    live = grants.where(active_as_of(F.lit(as_of).cast("date")))

    def any_entry(kind: str, action: str) -> Column:
        return F.bool_or((F.col("grant_type") == kind) & F.array_contains("actions", action)).alias(f"{kind}_{action}")

    return live.groupBy("employee_id", "folder_id").agg(
        any_entry("deny", "read"), any_entry("deny", "write"), any_entry("grant", "read"), any_entry("grant", "write")
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def folder_action(action: str) -> Column:
    """read / write / delete decision.

    Needs user columns project_role and department_id, folder columns f_department,
    f_tier and f_active, and the flags of :func:`grant_flags`.
    """
    role, dept = F.coalesce("project_role", F.lit("")), F.col("department_id")
    head = role.isin(fx.DEPT_HEAD_ROLES)
    own = F.col("f_department").eqNullSafe(dept)
    leader = role.isin(fx.LEADERSHIP_ROLES)
    if action == "delete":
        return (
            F.when(leader, True)
            .when(head & F.coalesce("f_active", F.lit(False)) & own, True)
            .when(role == fx.STAFF_ROLE, False)
            .otherwise(head)
        )
    denied = _flag("deny_read")
    if action == "write":
        denied = denied | _flag("deny_write")
    tier = F.coalesce("f_tier", F.lit("department_open"))
    return (
        F.when(~F.coalesce("f_active", F.lit(False)), False)
        .when(denied, False)
        .when(leader, True)
        .when(head & own, True)
        .when(~own, False)
        .when(tier == "department_open", True)
        .when(tier.isin("department_restricted", "grant_only"), _flag(f"grant_{action}"))
        .otherwise(False)
    )


def folder_columns(folders: DataFrame) -> DataFrame:
    return folders.select(
        "folder_id",
        F.col("department_id").alias("f_department"),
        F.col("access_tier").alias("f_tier"),
        (F.coalesce("status", F.lit("active")) == "active").alias("f_active"),
        F.col("company_id").alias("f_company"),
        F.col("project_id").alias("f_project"),
        F.col("default_classification").alias("f_class"),
    )


def folder_acl(users: DataFrame, pairs: DataFrame, folders: DataFrame, grants: DataFrame, as_of: str) -> DataFrame:
    """can_read / can_write / can_delete for asked (employee_id, folder_id) pairs."""
    return (
        pairs.join(users, "employee_id")
        .join(folder_columns(folders), "folder_id", "left")
        .join(grant_flags(grants, as_of), ["employee_id", "folder_id"], "left")
        .select(
            "employee_id",
            "folder_id",
            folder_action("read").alias("can_read"),
            folder_action("write").alias("can_write"),
            folder_action("delete").alias("can_delete"),
        )
    )


def label_access(
    labels: DataFrame,
    users: DataFrame,
    folders: DataFrame | None = None,
    grants: DataFrame | None = None,
    as_of: str | None = None,
    default_scope: str = fx.DEFAULT_SCOPE,
) -> DataFrame:
    """(employee_id, label_id) pairs a user may read.

    Company and project are equi-join keys; both inputs are the small side of the
    corpus (people, and distinct labels).
    """
    u = users.select(
        "employee_id",
        "company_id",
        "project_id",
        "project_role",
        "department_id",
        "clearance",
        F.col("contractor_id").alias("u_contractor"),
        "dept_tree",
    )
    lab = labels.withColumnRenamed("department_id", "l_department")
    pairs = u.join(lab, ["company_id", "project_id"])
    contractor_ok = (
        (F.coalesce("u_contractor", F.lit("")) == "")
        | F.col("contractor_id").isNull()
        | (F.col("contractor_id") == F.col("u_contractor"))
    )
    scope = department_scope(F.col("project_role"), default_scope)
    allowed = pairs.where(
        clearance_allows(
            F.coalesce("classification", F.lit("internal")), F.coalesce("clearance", F.lit("internal"))
        )
        & contractor_ok
        & department_allowed(scope, F.col("department_id"), F.col("dept_tree"), F.col("l_department"))
    )
    if folders is not None:
        allowed = (
            allowed.join(folder_columns(folders), "folder_id", "left")
            .join(grant_flags(grants, as_of), ["employee_id", "folder_id"], "left")
            .where(F.col("folder_id").isNull() | folder_action("read"))
        )
    return allowed.select("employee_id", "label_id")


def visibility_scopes(access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with the same visible labels share one scope.

    Returns (employee_id, scope_id) and (scope_id, label_id).
    """
    # eight sums over independent hashes name a set of labels without holding it in a row
    pairs = access.select("employee_id", "label_id").distinct()
    parts = [F.xxhash64(F.lit(k), "label_id") for k in range(4)]
    sums = [F.bit_xor(p) for p in parts] + [F.sum(p.cast("decimal(20,0)")) for p in parts]
    name = F.sha2(F.concat_ws(":", F.count("*"), *[x.cast("string") for x in sums]), 256)
    by_user = pairs.groupBy("employee_id").agg(name.alias("scope_id"))
    holders = by_user.groupBy("scope_id").agg(F.min("employee_id").alias("employee_id"))
    by_label = holders.join(pairs, "employee_id").select("scope_id", "label_id")
    return by_user, by_label


def rls_filter(chunks: DataFrame, access: DataFrame) -> DataFrame:
    """Chunks with the users that may read them (one row per pair)."""
    return chunks.withColumn("label_id", label_id()).join(access, "label_id")


def policy_contexts(
    employees: DataFrame,
    assignments: DataFrame,
    companies: DataFrame,
    as_of: str,
    env: str,
    project_id: str | None = None,
) -> DataFrame:
    """One policy row per employee: first active project role, or an error code.

    ``assignments`` carries ``ordinal``, its position in the input.
    """
    roles = assignments.where(active_as_of(F.lit(as_of).cast("date")) & (F.col("assignment_type") == "project_role"))
    if project_id:
        roles = roles.where(F.col("project_id") == project_id)
    first = (
        roles.withColumn("_n", F.row_number().over(Window.partitionBy("employee_id").orderBy("ordinal")))
        .where("_n = 1")
        .select(
            "employee_id",
            F.col("company_id").alias("a_company"),
            "project_id",
            "project_role",
            "department_id",
        )
    )
    groups = companies.select(F.col("company_id").alias("a_id"), F.col("company_group_id").alias("a_group"))
    clearance = F.coalesce("clearance", F.lit("internal"))
    joined = (
        employees.join(first, "employee_id", "left")
        .withColumn("ctx_company", F.coalesce("a_company", "company_id"))
        .join(groups, F.col("ctx_company") == F.col("a_id"), "left")
    )
    error = (
        F.when(F.lit(env not in fx.VALID_ENVS), "bad_env")
        .when(F.coalesce("status", F.lit("")) != "active", "inactive_employee")
        .when(F.col("project_role").isNull(), "no_project_role")
        .when(~clearance.isin(list(fx.CLEARANCE_RANK)), "bad_clearance")
    )
    ok = error.isNull()
    return joined.select(
        "employee_id",
        F.when(ok, F.col("ctx_company")).alias("company_id"),
        F.when(ok, F.col("project_id")).alias("project_id"),
        F.when(ok, F.col("project_role")).alias("project_role"),
        F.when(ok, F.col("department_id")).alias("department_id"),
        F.when(ok, F.col("contractor_id")).alias("contractor_id"),
        F.when(ok, clearance).alias("clearance"),
        F.when(ok & (F.col("project_role") == "group_admin"), F.col("a_group")).alias("company_group_id"),
        F.lit(env).alias("env"),
        error.alias("error"),
    )


def path_ancestors(path: Column) -> Column:
    """Every leading part of a path that ends at a separator, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))


def resolve_folders(files: DataFrame, folders: DataFrame, key: str, path_col: str) -> DataFrame:
    """Longest active folder that holds each path (null when there is none).

    Paths are exploded into their ancestors and matched with an equi-join; the
    longest match is picked by an aggregate with map-side combine.
    """
    active = folders.where(F.coalesce("status", F.lit("active")) == "active").select(
        tx.normalize_path(F.col("physical_path")).alias("_prefix"), F.col("folder_id").alias("_fid")
    )
    asked = files.select(key, F.explode(path_ancestors(tx.normalize_path(F.col(path_col)))).alias("_prefix"))
    best = asked.join(active, "_prefix", "left").groupBy(key).agg(
        F.max(
            F.when(F.col("_fid").isNotNull(), F.struct(F.length("_prefix").alias("n"), F.col("_fid").alias("id")))
        )["id"].alias("resolved_folder_id")
    )
    return best


def ingest_gate(requests: DataFrame, users: DataFrame, folders: DataFrame, grants: DataFrame, as_of: str) -> DataFrame:
    """Error code of each upload (null when allowed).

    ``requests``: request_id, employee_id, classification, folder_id (resolved or null).
    """
    joined = (
        requests.join(users, "employee_id")
        .join(folder_columns(folders), "folder_id", "left")
        .join(grant_flags(grants, as_of), ["employee_id", "folder_id"], "left")
    )
    user_level = F.coalesce("clearance", F.lit("internal"))
    minimum = F.coalesce("f_class", F.lit("internal"))
    folder = "INGEST_FOLDER_DENIED"
    code = (
        F.when(~clearance_allows(F.col("classification"), user_level), "INGEST_CLEARANCE_DENIED")
        .when(F.col("folder_id").isNull() | ~F.coalesce("f_active", F.lit(False)), folder)
        .when(~F.col("f_company").eqNullSafe(F.col("company_id")), folder)
        .when(~F.col("f_project").eqNullSafe(F.col("project_id")), folder)
        .when(~clearance_allows(minimum, user_level), "INGEST_CLEARANCE_DENIED")
        .when(~meets_minimum(F.col("classification"), minimum), folder)
        .when(~folder_action("write"), folder)
    )
    return joined.select("request_id", "employee_id", "folder_id", code.isNull().alias("allowed"), code.alias("error_code"))


def delete_gate(requests: DataFrame, users: DataFrame, folders: DataFrame, grants: DataFrame, as_of: str) -> DataFrame:
    joined = (
        requests.join(users, "employee_id")
        .join(folder_columns(folders), "folder_id", "left")
        .join(grant_flags(grants, as_of), ["employee_id", "folder_id"], "left")
    )
    code = F.when(F.col("folder_id").isNull(), "INGEST_FOLDER_DENIED").when(
        ~folder_action("delete"), "INGEST_DELETE_DENIED"
    )
    return joined.select("request_id", "employee_id", "folder_id", code.isNull().alias("allowed"), code.alias("error_code"))


def role_groups(role: Column, groups: dict[str, list[str]]) -> Column:
    """Tool groups of a role: its alias and every group that lists it."""
    listed = [F.when(role.isin(roles), F.lit(name)) for name, roles in groups.items()]
    return F.array_distinct(F.array_compact(F.array(tx.lookup(fx.ROLE_GROUP_ALIASES, role), *listed)))


def tool_gate(calls: DataFrame, gates: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Deny reason per call (null when allowed).  ``calls``: tool_id, env, project_role."""
    mine = role_groups(F.coalesce("project_role", F.lit("")), groups)
    reason = (
        F.when(F.col("env_allowlist").isNull(), "tool_disabled")
        .when(~F.array_contains("env_allowlist", F.coalesce("env", F.lit("production"))), "env_not_allowed")
        .when(F.arrays_overlap(F.coalesce("deny_role_groups", F.array()), mine), "insufficient_role")
        .when(
            (F.size(F.coalesce("allow_role_groups", F.array())) > 0)
            & ~F.coalesce(F.arrays_overlap("allow_role_groups", mine), F.lit(False)),
            "insufficient_role",
        )
    )
    return calls.join(gates, "tool_id", "left").select(
        *calls.columns, reason.isNull().alias("allowed"), reason.alias("deny_reason")
    )


def grant_requests_check(requests: DataFrame, folders: DataFrame) -> DataFrame:
    """Error code of each grant, deny or revoke request (null when valid).

    ``requests``: granter_role, granter_department, kind, folder_id, actions.
    """
    f = folder_columns(folders)
    tier = F.coalesce("f_tier", F.lit("department_open"))
    code = (
        F.when(F.col("f_active").isNull(), "unknown_folder")
        .when(~F.col("granter_role").isin(fx.DEPT_HEAD_ROLES), "not_department_head")
        .when(~F.col("granter_department").eqNullSafe(F.col("f_department")), "other_department")
        .when((F.col("kind") == "deny") & (tier != "department_open"), "deny_needs_open_folder")
        .when(
            (F.col("kind") == "grant") & ~tier.isin("department_restricted", "grant_only"),
            "grant_needs_closed_folder",
        )
        .when((F.col("kind") == "grant") & F.array_contains("actions", "delete"), "delete_not_grantable")
    )
    return requests.join(f, "folder_id", "left").select(*requests.columns, code.alias("error_code"))


def supersede_grants(grants: DataFrame, order: list[str]) -> DataFrame:
    """A newer grant of the same employee, folder and type revokes earlier active ones."""
    key = ["employee_id", "folder_id", "grant_type"]
    newest = grants.groupBy(*key).agg(F.max(F.struct(*order)).alias("_newest"))
    older = F.struct(*order) < F.col("_newest")
    status = F.when(older & (F.col("status") == "active"), "revoked").otherwise(F.col("status"))
    return grants.join(newest, key).withColumn("status", status).drop("_newest")


def egress_route(
    requests: DataFrame, policies: DataFrame, touched: DataFrame, local_fallback: str = "stub"
) -> DataFrame:
    """Effective provider per request.

    ``policies``: corpus_id, local_only, cloud_only.  ``touched``: request_id,
    corpus_id of every path in the context.  A cloud provider is replaced when the
    request's corpus, or any touched one, is local-only.
    """
    cloud = F.col("provider").isin("openai", "anthropic")
    local = F.col("provider").isin("stub", "ollama")
    hot = touched.join(policies, "corpus_id").groupBy("request_id").agg(F.bool_or("local_only").alias("any_local"))
    j = requests.join(policies, "corpus_id", "left").join(hot, "request_id", "left")
    by_corpus = cloud & _flag("local_only")
    by_path = cloud & _flag("any_local")
    provider = F.when(by_corpus | by_path, F.lit(local_fallback)).otherwise(F.col("provider"))
    note = (
        F.when(by_corpus, "cloud_blocked_by_corpus")
        .when(by_path, "cloud_blocked_by_path")
        .when(_flag("cloud_only") & local & _flag("explicit"), "cloud_recommended")
        .when(_flag("cloud_only") & local, "cloud_unavailable")
    )
    return j.select("request_id", "corpus_id", provider.alias("provider"), note.alias("note"))


def consent_gate(actions: DataFrame) -> DataFrame:
    """HR-card access: allowed roles only; writes also need a signed consent."""
    code = F.when(~F.col("actor_role").isin(fx.HR_ROLES), "role_denied").when(
        (F.col("action") == "save") & ~F.coalesce("consent_signed", F.lit(False)), "consent_required"
    )
    return actions.withColumns({"allowed": code.isNull(), "error_code": code})


def law_check(document_type: Column, requested: Column) -> Column:
    return F.when(document_type == "contract", "always").when(requested, "on_user_request").otherwise("never")
