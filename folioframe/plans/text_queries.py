"""Text functions over documents, pages and conversations.

Cyrillic trigger words are put in front of the given texts, so that every branch of
a rule is taken by some rows.
"""

from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.operators import corrections as co
from folioframe.plans import bindings as b
from folioframe.plans.registry import register
from folioframe.plans.retrieval_queries import _STRIP, sql_quality

T2 = "[а-яёa-z0-9]{2,}"


def _pick(col, *values):
    """One of the values by the remainder of an integer column."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(col) % len(values)).cast("int"))


def _sql_pick(col, *values):
    body = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{body}][CAST({col} % {len(values)} AS INT) + 1]"


@register(
    "tokens",
    f"""SELECT doc_id, CAST(len(t2) AS BIGINT) AS n2, CAST(len(t3) AS BIGINT) AS n3, md5(array_to_string(t2, ' ')) AS t2_md5, md5(array_to_string(t3, ' ')) AS t3_md5
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '{T2}') AS t2, regexp_extract_all(lower(text), '[а-яёa-z0-9]{{3,}}') AS t3 FROM documents)""",
)
def tokens(spark, sf):
    t2, t3 = tx.tokens(F.col("text")), tx.tokens(F.col("text"), 3)
    return b.table(spark, sf, "documents").select(
        "doc_id",
        F.size(t2).cast("bigint").alias("n2"),
        F.size(t3).cast("bigint").alias("n3"),
        F.md5(F.array_join(t2, " ")).alias("t2_md5"),
        F.md5(F.array_join(t3, " ")).alias("t3_md5"),
    )


@register(
    "lemma_tokens",
    f"""SELECT doc_id, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(replace(lower('Ёлка всё ещё ' || text), 'ё', 'е'), '{T2}'))), ' ')) AS lemma_md5
        FROM documents""",
)
def lemma_tokens(spark, sf):
    lem = tx.lemmas(F.concat(F.lit("Ёлка всё ещё "), "text"))
    return b.table(spark, sf, "documents").select(
        "doc_id", F.md5(F.array_join(F.array_sort(F.array_distinct(lem)), " ")).alias("lemma_md5")
    )


@register(
    "lemma_dictionary",
    f"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{T2}'))) AS form FROM documents),
        d AS (SELECT DISTINCT form, substr(form, 1, 4) AS lemma FROM (SELECT unnest(regexp_extract_all(lower(text), '{T2}')) AS form FROM benchmark) WHERE length(form) > 4)
        SELECT coalesce(lemma, form) AS lemma, count(DISTINCT doc_id) AS docs FROM t LEFT JOIN d USING (form) GROUP BY 1""",
)
def lemma_dictionary(spark, sf):
    """A morphology table is one equi-join on the distinct forms."""
    forms = b.table(spark, sf, "documents").select(
        "doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("form")
    )
    table = b.table(spark, sf, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("form")).distinct()
    table = table.where(F.length("form") > 4).withColumn("lemma", F.substring("form", 1, 4))
    named = forms.join(table, "form", "left").withColumn("lemma", F.coalesce("lemma", "form"))
    return named.groupBy("lemma").agg(F.countDistinct("doc_id").alias("docs"))


@register(
    "stem_prefix_match",
    f"""WITH w AS (SELECT turn, conv_id, lower(text) AS low, regexp_extract_all(lower(text), '{T2}') AS ws FROM conversations),
        p AS (SELECT conv_id, turn, low, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM w)
        SELECT conv_id, turn, len(list_filter(prev, lambda x: CASE WHEN length(x) < 4 THEN contains(low, x) ELSE contains(low, substr(x, 1, 4)) END)) AS stems
        FROM p WHERE prev IS NOT NULL""",
)
def stem_prefix_match(spark, sf):
    from pyspark.sql import Window

    turns = b.table(spark, sf, "conversations").withColumn(
        "prev", F.lag(tx.tokens(F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    )
    stems = tx.let(F.lower("text"), lambda low: F.size(F.filter("prev", lambda w: tx.stem_in_text(w, low))))
    return turns.where("prev is not null").select("conv_id", "turn", stems.cast("bigint").alias("stems"))


@register(
    "literal_prefilter",
    f"""WITH p AS (SELECT conv_id, turn, lower(text) AS low, lower({_STRIP.format("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")}) AS q FROM conversations)
        SELECT conv_id, turn, low <> '' AND ((length(q) >= 4 AND contains(low, q)) OR len(regexp_extract_all(q, '{T2}')) = 0
               OR len(list_filter(regexp_extract_all(q, '{T2}'), lambda x: contains(low, x))) = len(regexp_extract_all(q, '{T2}'))) AS passes
        FROM p WHERE q IS NOT NULL""",
)
def literal_prefilter(spark, sf):
    from pyspark.sql import Window

    turns = b.table(spark, sf, "conversations").withColumn(
        "prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    )
    return turns.where("prev is not null").select(
        "conv_id", "turn", tx.literal_prefilter(F.col("prev"), F.col("text")).alias("passes")
    )


_QUERY_HEADS = ("ростех  надзор ", "Опо ", "пожарной безопасности ", "ограждение 1 ", "Проминвест ", "люки №7 ", "")


@register(
    "normalize_query",
    f"""WITH q AS (SELECT conv_id, turn, trim(regexp_replace({_sql_pick('conv_id', *_QUERY_HEADS)} || text, '\\s+', ' ', 'g')) AS q FROM conversations),
        r AS (SELECT conv_id, turn, q, CASE conv_id % 7
              WHEN 0 THEN regexp_replace(q, '(?i)ростех надзор', 'ростехнадзор', 'g')
              WHEN 1 THEN regexp_replace(q, '(?i)опо ', 'опасный производственный объект ', 'g')
              WHEN 2 THEN regexp_replace(q, '(?i)пожарной безопасности', 'пожарная безопасность', 'g')
              WHEN 3 THEN q || ' Ограждение Ог-1' WHEN 4 THEN q || ' nponisusecr nponinvest' WHEN 5 THEN q || ' Л-7' ELSE q END AS n FROM q)
        SELECT conv_id, turn, trim(n) AS normalized FROM r""",
)
def normalize_query(spark, sf):
    q = F.concat(_pick("conv_id", *_QUERY_HEADS), F.col("text"))
    return b.table(spark, sf, "conversations").select("conv_id", "turn", tx.normalize_query(q).alias("normalized"))


_INTENT_HEADS = (
    "Открой ", "Открой и опиши ", "Проанализируй ", "Кратко ", "Что такое ", "Open ", "самое  главное: ", "reopened ",
)
_INTENTS = ("open", "summarize", "analyze", "summarize", "qa", "open", "analyze", "qa")


@register(
    "query_intent",
    f"SELECT item_id, {_sql_pick('item_id', *_INTENTS)} AS intent, item_id % 8 IN (1, 3) AS is_summary FROM benchmark",
)
def query_intent(spark, sf):
    q = F.concat(_pick("item_id", *_INTENT_HEADS), F.col("text"))
    return b.table(spark, sf, "benchmark").select(
        "item_id", tx.query_intent(q).alias("intent"), tx.is_summary_query(q).alias("is_summary")
    )


@register(
    "filename_like",
    """SELECT page_id, length(q) >= 4 AND (regexp_matches(q, '(?i)(\\.(docx?|pdf|xls(x)?|msg)([^a-z0-9_]|$)|[_/\\\\])')
         OR (len(list_filter(ts, lambda x: regexp_matches(x, '[0-9]'))) >= 2 AND len(ts) <= 10)) AS filename_like
       FROM (SELECT page_id, q, regexp_extract_all(lower(q), '[а-яёa-z0-9]{3,}') AS ts
             FROM (SELECT page_id, replace(regexp_extract(url, '//([^?#]*)', 1), '/', ' ') || CASE WHEN page_id % 3 = 0 THEN ' act 12345' ELSE '' END AS q FROM pages))""",
)
def filename_like(spark, sf):
    q = F.concat(
        F.replace(F.regexp_extract("url", "//([^?#]*)", 1), F.lit("/"), F.lit(" ")),
        F.when(F.col("page_id") % 3 == 0, " act 12345").otherwise(""),
    )
    return b.table(spark, sf, "pages").select("page_id", tx.looks_like_filename(q).alias("filename_like"))


@register(
    "doc_number_in_name",
    """WITH n AS (SELECT page_id, url, regexp_extract(url, '/([0-9]+)', 1) AS num FROM pages),
        s AS (SELECT *, CAST(page_id AS VARCHAR) AS other FROM n)
       SELECT page_id, regexp_matches(url, '(№|#|^|[^a-zA-Z0-9_])' || num || '([^a-zA-Z0-9]|$)') AS own,
         regexp_matches(url, '(№|#|^|[^a-zA-Z0-9_])' || other || '([^a-zA-Z0-9]|$)') AS by_id,
         CAST(CASE WHEN regexp_matches(url, '(№|#|^|[^a-zA-Z0-9_])' || num || '([^a-zA-Z0-9]|$)') THEN 100 ELSE 0 END
           - 40 * len(list_filter(regexp_extract_all(url, '[0-9]{2,}'), lambda x: x <> num)) AS INT) AS score FROM s""",
)
def doc_number_in_name(spark, sf):
    num = F.regexp_extract("url", "/([0-9]+)", 1)
    return b.table(spark, sf, "pages").select(
        "page_id",
        tx.has_doc_number(F.col("url"), num).alias("own"),
        tx.has_doc_number(F.col("url"), F.col("page_id").cast("string")).alias("by_id"),
        tx.doc_number_score(F.col("url"), F.array(num)).alias("score"),
    )


@register(
    "follow_up",
    """WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Ок, ' ELSE '' END || trim(split_part(text, '.', 1)) AS s FROM conversations),
        z AS (SELECT conv_id, turn, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM q)
       SELECT conv_id, turn, s <> '' AND ((length(s) < 80 AND regexp_matches(s, '(?i)(^.{0,40}(пункт|подробн|ещё|еще|уточн|тот же|этот|тот документ|выше|ранее|продолж|разверни|а что|а как|почему|зачем|когда|где именно)|^(да|нет|ок|хорошо|спасибо|понятно)([^a-zA-Zа-яА-ЯёЁ0-9_]|$))'))
         OR (length(s) < 35 AND NOT regexp_matches(s, '[0-9]') AND len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) <= 8)) AS follow_up FROM z""",
)
def follow_up(spark, sf):
    head = F.when(F.col("turn") % 3 == 0, "Ок, ").otherwise("")
    q = F.concat(head, F.trim(F.split_part("text", F.lit("."), F.lit(1))))
    return b.table(spark, sf, "conversations").select("conv_id", "turn", tx.is_follow_up(q).alias("follow_up"))


_PATH_HEADS = ("Письмо_", "plan.DXF/", "Замечания/", "ТТН_", "Акт_", "letter_", "plain/", "Чертеж_")
_PATH_TYPES = ("письмо", "чертёж", "замечания", "ТТН", "акт", "письмо", "прочее", "чертёж")


@register(
    "doc_type_from_path",
    f"""SELECT page_id, CASE WHEN regexp_matches(lower(url), 'letter|correspondence') THEN 'письмо' WHEN regexp_matches(lower(url), 'dwg|\\.dxf') AND page_id % 8 NOT IN (0, 5) THEN 'чертёж'
            ELSE {_sql_pick('page_id', *_PATH_TYPES)} END AS doc_type FROM pages""",
)
def doc_type_from_path(spark, sf):
    path = F.concat(_pick("page_id", *_PATH_HEADS), F.col("url"))
    return b.table(spark, sf, "pages").select("page_id", tx.doc_type_from_path(path).alias("doc_type"))


@register(
    "parse_analysis",
    f"""WITH s AS (SELECT item_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM benchmark)
        SELECT item_id, p[1] AS gist, CASE WHEN len(p) < 2 THEN 'ТИП: акт.' ELSE array_to_string(p[2:9], '|') END AS points, 'акт' AS doc_type FROM s""",
)
def parse_analysis(spark, sf):
    parts = F.filter(F.transform(F.split("text", r"\."), tx.squeeze), lambda x: x != "")
    rest = F.array_join(F.transform(F.slice(parts, 2, 100), lambda x: F.concat(F.lit("- "), x)), "\n")
    answer = F.concat(F.lit("Суть: "), parts[0], F.lit("\nГлавное:\n"), rest, F.lit("\nТИП: акт."))
    parsed = b.table(spark, sf, "benchmark").select("item_id", tx.parse_analysis(answer).alias("a"))
    return parsed.select("item_id", "a.gist", F.array_join("a.key_points", "|").alias("points"), "a.doc_type")


@register(
    "qa_pairs",
    f"""WITH t AS (SELECT conv_id, turn, role, {_STRIP.format('text')} AS s FROM conversations),
        p AS (SELECT conv_id, turn, s AS question, lead(s) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM t)
        SELECT conv_id, turn, question, answer FROM p WHERE answer IS NOT NULL AND question <> '' AND answer <> ''""",
)
def qa_pairs(spark, sf):
    """Pairs written in the tagged form and, for odd conversations, as JSON; then parsed back."""
    from pyspark.sql import Window

    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = b.table(spark, sf, "conversations").withColumn("answer", answer).where("answer is not null")
    tagged = F.concat(F.lit("[Q]: "), "text", F.lit("\n[A]: "), "answer")
    as_json = F.concat(
        F.lit("```json\n"),
        F.to_json(F.array(F.struct(F.col("text").alias("question"), F.col("answer").alias("answer")))),
        F.lit("\n```"),
    )
    raw = rows.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 1, as_json).otherwise(tagged).alias("raw"))
    return raw.select("conv_id", "turn", F.explode(tx.qa_pairs(F.col("raw"))).alias("p")).select(
        "conv_id", "turn", "p.question", "p.answer"
    )


_CORR_HEADS = ("Неправильно: ", "нет, ", "Должно быть ", "", "Ошибка — ")


@register(
    "user_correction",
    f"""WITH s AS (SELECT conv_id, turn, {_STRIP.format('text')} AS t FROM conversations WHERE role = 'user'),
        c AS (SELECT conv_id, turn, conv_id % 5 AS k, t, regexp_replace(t, '^[ ."'']+|[ ."'']+$', '', 'g') AS body FROM s)
        SELECT conv_id, turn, CASE WHEN k <> 3 THEN body WHEN length(t) > 12 AND NOT ends_with(t, '?') THEN t END AS correction,
               CASE k WHEN 0 THEN CASE WHEN length('Неправильно: ' || t) >= 12 THEN substr(t, 1, 2000) END
                 ELSE CASE WHEN length({_sql_pick('k', *_CORR_HEADS)} || t) >= 12 THEN substr({_sql_pick('k', *_CORR_HEADS)} || t, 1, 2000) END END AS training
        FROM c""",
)
def user_correction(spark, sf):
    reply = F.concat(_pick("conv_id", *_CORR_HEADS), tx.strip(F.col("text")))
    rows = b.table(spark, sf, "conversations").where("role = 'user'")
    return rows.select(
        "conv_id", "turn", tx.user_correction(reply).alias("correction"), tx.training_correction(reply).alias("training")
    )


@register(
    "no_answer",
    "SELECT conv_id, turn, conv_id % 3 = 0 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' AS no_answer FROM conversations",
)
def no_answer(spark, sf):
    text = F.concat(F.when(F.col("conv_id") % 3 == 0, "Нет данных. ").otherwise(""), F.col("text"))
    return b.table(spark, sf, "conversations").select("conv_id", "turn", tx.is_no_answer(text).alias("no_answer"))


@register(
    "todo_lines",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
        m AS (SELECT conv_id, turn, i, CASE WHEN i % 2 = 1 THEN 'Надо: ' WHEN i % 3 = 0 THEN 'TODO ' ELSE '' END || trim(line) AS s, trim(line) AS body, i % 2 = 1 OR i % 3 = 0 AS yes FROM l)
       SELECT conv_id, turn, count(*) AS items, md5(string_agg(body, '|' ORDER BY i)) AS items_md5 FROM m WHERE yes AND body <> '' GROUP BY 1, 2""",
)
def todo_lines(spark, sf):
    lines = F.split("text", "\n")
    head = lambda i: F.when(i % 2 == 0, "Надо: ").when(i % 3 == 2, "TODO ").otherwise("")
    script = F.array_join(F.transform(lines, lambda x, i: F.concat(head(i), F.trim(x))), "\n")
    rows = b.table(spark, sf, "conversations").select("conv_id", "turn", tx.todo_items(script).alias("items"))
    rows = rows.withColumn("items", F.filter("items", lambda x: x != "")).where(F.size("items") > 0)
    return rows.select(
        "conv_id", "turn", F.size("items").cast("bigint").alias("items"), F.md5(F.array_join("items", "|")).alias("items_md5")
    )


_SPEECH_HEADS = ("Гурнал работ ", "ром инвест ", "акту о свидетельствовании ", "ДТН, армировка ", "найди птн ", "")
_SPEECH_OUT = ("журнал работ ", "Проминвест ", "акт освидетельствования ", "ТТН, армировка ", "найди ТТН ", "")


@register(
    "speech_fixes",
    f"SELECT conv_id, turn, trim(regexp_replace({_sql_pick('conv_id', *_SPEECH_OUT)} || text, '\\s+', ' ', 'g')) AS fixed FROM conversations",
)
def speech_fixes(spark, sf):
    text = F.concat(_pick("conv_id", *_SPEECH_HEADS), F.col("text"))
    return b.table(spark, sf, "conversations").select("conv_id", "turn", tx.fix_speech(co.fold_unicode(text)).alias("fixed"))


@register("mojibake_repair", "SELECT item_id, 'Журнал входного контроля ' || text AS fixed FROM benchmark")
def mojibake_repair(spark, sf):
    """Text spoilt as in the archive (UTF-8 read as latin-1), then repaired."""
    # latin-1 text in the corpus is left out of the spoilt part, which holds the marker letters
    good = F.concat(F.lit("Журнал входного контроля "), F.col("text"))
    spoilt = F.decode(F.encode(good, "UTF-8"), "ISO-8859-1")
    return b.table(spark, sf, "benchmark").select("item_id", co.repair_mojibake(spoilt).alias("fixed"))


@register("path_normalize", "SELECT page_id, regexp_replace(replace(replace(url, '/', '\\'), '\\', '/'), '/+$', '') AS path FROM pages")
def path_normalize(spark, sf):
    raw = F.replace("url", F.lit("/"), F.lit("\\"))
    return b.table(spark, sf, "pages").select("page_id", tx.normalize_path(raw).alias("path"))


_CORPORA = {"src_a": "north", "SRC B": "south", "north": "north", "south": "south"}


@register(
    "corpus_id",
    f"SELECT doc_id, {_sql_pick('doc_id', 'north', 'south', 'north', 'main', 'main')} AS corpus_id FROM documents",
)
def corpus_id(spark, sf):
    aliases = {k.lower(): v for k, v in _CORPORA.items()}
    raw = _pick("doc_id", " SRC_A ", "src b", "North", "", "other")
    return b.table(spark, sf, "documents").select("doc_id", tx.corpus_id(raw, aliases, "main").alias("corpus_id"))


@register(
    "redact",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bbearer\s+[a-z0-9._~+/=-]{8,}', '[REDACTED_TOKEN]', 'g'),
           '\b(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9_-]{16,}', '[REDACTED_API_KEY]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g'),
           '\b[0-9]{4} [0-9]{6}\b', '[REDACTED_PASSPORT]', 'g'), '\+?[0-9][0-9 ()-]{8,}[0-9]', '[REDACTED_PHONE]', 'g')) AS redacted_md5
        FROM (SELECT doc_id, 'Bearer abcdef123456 4510 123456 u' || doc_id || '@example.org ' || text AS t FROM documents)""",
)
def redact(spark, sf):
    text = F.concat(F.lit("Bearer abcdef123456 4510 123456 u"), "doc_id", F.lit("@example.org "), "text")
    return b.table(spark, sf, "documents").select("doc_id", F.md5(tx.redact(text)).alias("redacted_md5"))


@register(
    "iso_dates",
    """SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 + 43200 AS due_epoch,
         CASE WHEN o_orderstatus = 'F' THEN NULL ELSE strftime(o_orderdate, '%d.%m.%Y') END AS shown FROM orders""",
)
def iso_dates(spark, sf):
    from folioframe.operators import tasks as tk

    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return b.table(spark, sf, "orders").select(
        "o_orderkey",
        tk.due_epoch(iso).alias("due_epoch"),
        F.when(F.col("o_orderstatus") != "F", F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "dd.MM.yyyy")).alias("shown"),
    )


@register(
    "array_functions",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(t))[1:8], ' ') AS first_eight, list_contains(t, 'the') AS has_the,
           len(list_filter(list_distinct(t), lambda x: x IN ('the', 'der', 'le', 'el'))) > 0 AS any_article
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '{T2}') AS t FROM documents)""",
)
def array_functions(spark, sf):
    t = tx.tokens(F.col("text"))
    articles = F.array(*[F.lit(x) for x in ("the", "der", "le", "el")])
    return b.table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(F.slice(F.array_sort(F.array_distinct(t)), 1, 8), " ").alias("first_eight"),
        F.array_contains(t, "the").alias("has_the"),
        F.arrays_overlap(t, articles).alias("any_article"),
    )


@register(
    "json_and_maps",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing,
         event_type || '/' || json_extract_string(props, '$.k') AS tag FROM events""",
)
def json_and_maps(spark, sf):
    props = F.from_json("props", "map<string,string>")
    merged = F.map_concat(props, F.create_map(F.lit("type"), F.col("event_type")))
    return b.table(spark, sf, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.coalesce(props["missing"], F.lit("none")).alias("missing"),
        F.concat_ws("/", merged["type"], merged["k"]).alias("tag"),
    )


@register(
    "keyword_score",
    f"""WITH k AS (SELECT d.doc_id, lower(d.text) AS low, list_distinct(regexp_extract_all(lower(d.text), '{T2}')) AS ts,
            list_distinct(regexp_extract_all(lower(b.text), '{T2}')) AS ks FROM documents d JOIN benchmark b ON d.doc_id = b.item_id)
        SELECT doc_id, round(len(list_filter(ks, lambda k: contains(low, k) OR len(list_filter(ts, lambda t: contains(t, k) OR contains(k, t))) > 0))::DOUBLE / len(ks), 6) AS score FROM k""",
)
def keyword_score(spark, sf):
    docs, bench = b.table(spark, sf, "documents"), b.table(spark, sf, "benchmark").withColumnRenamed("text", "q")
    pairs = docs.join(bench, F.col("doc_id") == F.col("item_id"))
    keys = F.array_distinct(tx.tokens(F.col("q")))
    return pairs.select("doc_id", F.round(tx.keyword_score(F.col("text"), keys), 6).alias("score"))


@register(
    "text_quality",
    f"""SELECT d.doc_id, quality AS label, round({sql_quality('t')}, 6) AS text_quality
        FROM (SELECT doc_id, {_STRIP.format('text')} AS t FROM documents) d LEFT JOIN labels USING (doc_id)""",
)
def text_quality(spark, sf):
    docs, labels = b.table(spark, sf, "documents"), b.table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("quality").alias("label"), F.round(tx.text_quality(F.col("text"), b.LATIN), 6).alias("text_quality")
    )


@register(
    "slug",
    r"""SELECT page_id, CASE WHEN s = '' THEN 'task' ELSE s END AS slug FROM (
          SELECT page_id, substr(replace(regexp_replace(trim(regexp_replace(lower(url), '\s+', ' ', 'g')), '[^a-z0-9_\- ]+', '', 'g'), ' ', '-'), 1, 80) AS s FROM pages)""",
)
def slug(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))
