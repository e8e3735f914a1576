import math
import random

from pyspark.sql import functions as F

from folioframe.operators import chunking as ch
from folioframe.operators import ingest as ig
from folioframe.operators import retrieval as rt
from folioframe.operators import runs as rn
from folioframe.operators import security as se
from folioframe.operators import vectors as vs


def windows(text, size, overlap):
    body, out, start = text.strip(), [], 0
    while body:
        end = min(len(body), start + size)
        out.append((start, end, body[start:end]))
        if end == len(body):
            return out
        start += max(1, size - overlap)
    return out


def test_windows_against_loop(spark):
    rng = random.Random(1)
    texts = ["", "  ", "x"] + ["".join(rng.choice("ab в\n") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = ch.chunk_windows(df, size=50, overlap=12).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["idx"])):
        got.setdefault(r["id"], []).append((r["start_offset"], r["end_offset"], r["content"]))
    want = {i: windows(t, 50, 12) for i, t in enumerate(texts) if t.strip()}
    assert got == want


def test_dedup_against_loop(spark):
    rng = random.Random(2)
    rows = [
        (i, f"k{rng.randint(0, 6)}", rng.choice(["a", "b"]), f"d{i}", rng.random() < 0.2, rng.choice([None, f"i{rng.randint(0, 9)}"]))
        for i in range(200)
    ]
    df = spark.createDataFrame(
        rows, "arrival bigint, dedup_key string, classification string, doc_id string, force_reprocess boolean, idempotency_key string"
    )
    got = {
        r["arrival"]: (r["ingest_status"], r["dedup_action"], r["doc_id"], r["matched_doc_id"])
        for r in ig.dedup_decisions(df, block_rows=7).collect()
    }
    store, seen, want = {}, {}, {}
    for arrival, key, cls, doc, force, idem in rows:
        if idem and idem in seen:
            status, d, m = seen[idem]
            want[arrival] = (status, "skipped_processing", d, m)
            continue
        known = store.get(key)
        if known and not force:
            action = "skipped_processing" if known[0] == cls else "linked_existing"
            result = ("duplicate", action, None, known[1])
        else:
            store[key] = (cls, doc)
            result = ("accepted", "reprocessed" if known else "none", doc, None)
        want[arrival] = result
        if idem:
            seen[idem] = (result[0], result[2], result[3])
    assert got == want


def test_streaks_against_loop(spark):
    rng = random.Random(3)
    rows = [
        (rng.randint(0, 2), i, rng.random() < 0.4, rng.choice(["E1", "E2"]), rng.choice([None, "t1", "t2"])) for i in range(300)
    ]
    df = spark.createDataFrame(rows, "run int, step bigint, success boolean, error_code string, tool_name string")
    got = {
        r["step"]: (r["failures"], r["same_error"], r["same_tool"])
        for r in rn.failure_streaks(df, "run", ["step"], block=F.floor(F.col("step") / 11)).collect()
    }
    state, want = {}, {}
    for run, step, ok, error, tool in rows:
        f, e, t, le, lt = state.get(run, (0, 0, 0, None, None))
        if ok:
            f = e = t = 0
            want[step] = (0, 0, 0)
        else:
            f, e, le = f + 1, (e + 1 if error == le else 1), error
            if tool:
                t, lt = (t + 1 if tool == lt else 1), tool
            want[step] = (f, e, t)
        state[run] = (f, e, t, le, lt)
    assert got == want


def _corpus(spark, texts):
    rows = [(f"c{i}", f"d{i}", 1, t, "internal") for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, label_id bigint, content string, classification string")
    return chunks, spark.createDataFrame([(0, 1)], "scope_id bigint, label_id bigint")


def test_bm25_against_direct(spark):
    texts = ["акт приема передачи", "акт акт осмотра", "журнал сварки", "журнал акт", "план"]
    chunks, scopes = _corpus(spark, texts)
    asks = spark.createDataFrame([("q", "акт осмотра", 0)], "trace_id string, query string, scope_id bigint")
    got = {r["chunk_id"]: r["score"] for r in rt.bm25(asks, chunks, scopes).collect()}
    docs = [t.split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    vocab = {w for d in docs for w in d}
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w in vocab for n in [sum(w in d for d in docs)]}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    want = {}
    for i, d in enumerate(docs):
        s = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in ["акт", "осмотра"])
        if s > 0:
            want[f"c{i}"] = round(s, 6)
    assert got == want


def test_search_finds_parts_of_words_and_tokenless_phrases(spark):
    chunks, scopes = _corpus(spark, ["подземная выработка", "работы в цехе", "цена: ≥≤ рублей", "выработка цеха"])
    asks = spark.createDataFrame(
        [("a", "работк цех", 0), ("b", "≥≤", 0), ("c", "выработка неизвестное", 0)], "trace_id string, query string, scope_id bigint"
    )
    got = {(r["trace_id"], r["chunk_id"]) for r in rt.keyword_matches(asks, chunks, scopes).collect()}
    # an unknown token is optional; a phrase without tokens is found by its characters
    assert got == {("a", "c3"), ("b", "c2"), ("c", "c0"), ("c", "c3")}


def test_rrf(spark):
    lists = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 1)], "trace_id string, chunk_id string, rank int")
    rows = rt.rrf(lists, ["trace_id"]).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [("b", round(1 / 61 + 1 / 62, 9)), ("a", round(1 / 61, 9))]


def test_vector_topk_blocks(spark, monkeypatch):
    rng = random.Random(4)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.0] * 8)]
    df = spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(str(i), v) for i, v in vecs[:20]], "query_id string, vector array<double>")
    whole = sorted(map(tuple, vs.vector_topk(queries, df, 5).select("query_id", "vec_id", "rank").collect()))
    monkeypatch.setattr(vs, "BLOCK_ROWS", 6)
    assert sorted(map(tuple, vs.vector_topk(queries, df, 5).select("query_id", "vec_id", "rank").collect())) == whole
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for qid, q in vecs[:3]:
        scores = {i: round(sum(a * b for a, b in zip(q, v)) / (norm(q) * norm(v)), 5) if norm(v) else 0.0 for i, v in vecs}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        assert [w[1] for w in sorted((w for w in whole if w[0] == str(qid)), key=lambda w: w[2])] == best


FOLDER = "folder_id string, company_id string, project_id string, department_id string, access_tier string, default_classification string, status string, physical_path string"
GRANT = "grant_type string, employee_id string, folder_id string, actions array<string>, valid_from string, valid_to string, status string"
USER = "employee_id string, company_id string, project_id string, project_role string, department_id string, clearance string, contractor_id string"


def test_folder_acl_table(spark):
    folders = spark.createDataFrame(
        [
            ("open", "c", "p", "d1", "department_open", "internal", "active", "/s/open"),
            ("closed", "c", "p", "d1", "grant_only", "internal", "active", "/s/closed"),
            ("off", "c", "p", "d1", "department_open", "internal", "inactive", "/s/off"),
            ("proj", "c", "p", "d1", "project_open", "internal", "active", "/s/proj"),
        ],
        FOLDER,
    )
    users = spark.createDataFrame(
        [
            ("boss", "c", "p", "Direktor", None, "confidential", None),
            ("head", "c", "p", "Chefmarkscheider", "d1", "confidential", None),
            ("worker", "c", "p", "Сотрудник подразделения", "d1", "internal", None),
            ("guest", "c", "p", "Сотрудник подразделения", "d2", "internal", None),
            ("denied", "c", "p", "Direktor", "d1", "internal", None),
        ],
        USER,
    )
    grants = spark.createDataFrame(
        [
            ("grant", "worker", "closed", ["read"], "2025-01-01", None, "active"),
            ("deny", "denied", "open", ["read"], "2025-01-01", "2025-12-31", "active"),
        ],
        GRANT,
    )
    pairs = users.select("employee_id", F.explode(F.array(*map(F.lit, ["open", "closed", "off", "proj"]))).alias("folder_id"))
    got = {(r["employee_id"], r["folder_id"]): (r["can_read"], r["can_write"], r["can_delete"]) for r in se.folder_acl(users, pairs, folders, grants, "2025-09-10").collect()}
    assert got[("boss", "closed")] == (True, True, True)
    assert got[("boss", "off")] == (False, False, True)
    assert got[("head", "proj")] == (True, True, True)
    assert got[("worker", "open")] == (True, True, False)
    assert got[("worker", "closed")] == (True, False, False)
    assert got[("worker", "proj")] == (False, False, False)
    assert got[("guest", "open")] == (False, False, False)
    assert got[("denied", "open")] == (False, False, True)
    later = {(r["employee_id"], r["folder_id"]): r["can_read"] for r in se.folder_acl(users, pairs, folders, grants, "2026-02-01").collect()}
    assert later[("denied", "open")]


def test_longest_prefix(spark):
    folders = spark.createDataFrame(
        [("a", "c", "p", "d", "department_open", "internal", "active", "/x/"), ("b", "c", "p", "d", "department_open", "internal", "active", "\\x\\y")],
        FOLDER,
    )
    files = spark.createDataFrame([(1, "/x/y/z.txt"), (2, "/x/yy/z.txt"), (3, "/other"), (4, "/x/y")], "id int, path string")
    got = {r["id"]: r["resolved_folder_id"] for r in se.resolve_folders(files, folders, "id", "path").collect()}
    assert got == {1: "b", 2: "a", 3: None, 4: "b"}


def test_path_search_with_hot_tokens(spark):
    rng = random.Random(5)
    paths = [f"arc/{rng.choice(['Act', 'plan'])} {i} {rng.choice(['one', 'two', 'six'])}.pdf" for i in range(200)]
    asks = [("a", "Act 17 two"), ("b", "plan"), ("c", "act plan arc"), ("d", "zzz"), ("e", "two 1"), ("f", "Act 5"), ("g", "pdf arc zzz")]
    manifest = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    requests = spark.createDataFrame(asks, "trace_id string, query string")
    from folioframe.functions import scoring as sc

    pairs = requests.crossJoin(manifest).withColumn("score", F.round(sc.path_score(F.col("query"), F.col("relative_path")), 3))
    want = rt.rank_by_score(pairs.where("score > 0"), ["trace_id"], 10, tie="relative_path")
    key = lambda df: sorted((r["trace_id"], r["rank"], r["relative_path"], r["score"]) for r in df.collect())
    assert key(rt.path_search(requests, manifest, 10, hot_rows=30)) == key(want)
    assert key(rt.path_search(requests, manifest, 10, hot_rows=5)) == key(want)


def test_paths_of_hot_tokens_are_ranked_by_class(spark):
    from folioframe.functions import scoring as sc

    rng = random.Random(7)
    paths = [f"arc/{rng.choice(['Act', 'plan'])} {i} {rng.choice(['one', 'two', 'six'])}.pdf" for i in range(150)]
    paths += [f"Arc/{x} a b act plan one two six seven {i}.pdf" for i, x in enumerate(["Act", "act"] * 4)] + ["arc/x ++ y.pdf"]
    long_ = "act plan one two six seven"
    asks = ["Act 17 two", "plan", "Plan", "act plan arc", "zzz", "two 1", "Act 5", "pdf arc zzz", "act", "ct 1", "+", "++ y", ".", "", None]
    asks += [long_, long_.upper(), long_ + " 3", "act act two", "pdf act zz plan"]
    requests = spark.createDataFrame([(str(i), q, "n") for i, q in enumerate(asks)], "trace_id string, query string, corpus_id string")
    corpora = "nse"
    manifest = spark.createDataFrame([(p, corpora[i % 3]) for i, p in enumerate(paths)], "relative_path string, corpus_id string")
    pairs = requests.withColumnRenamed("corpus_id", "own").crossJoin(manifest)
    pairs = pairs.withColumn("score", F.round(sc.path_score(F.col("query"), F.col("relative_path")), 3)).where("score > 0").cache()
    want = rt.rank_by_score(pairs, ["trace_id"], 4, tie="relative_path")
    key = lambda df: sorted((r["trace_id"], r["rank"], r["relative_path"], r["score"]) for r in df.collect())
    tops = pairs.where("corpus_id <> own").groupBy("trace_id", "corpus_id").agg(F.max("score").alias("score"))
    tops = rt.rank_by_score(tops, ["trace_id"], 1, tie="corpus_id").where("score >= 2")
    top = lambda df: sorted((r["trace_id"], r["corpus_id"], r["score"]) for r in df.collect())
    for rows, n in [(20, 0), (0, 0), (10**9, 0)]:
        assert key(rt.path_search(requests, manifest, 4, rows, n)) == key(want)
        assert top(rt.cross_corpus_suggest(requests, manifest, 2.0, rows, n)) == top(tops)


def test_small_doc_search_scores_every_document(spark, monkeypatch):
    from folioframe.functions import scoring as sc
    from folioframe.operators import held

    monkeypatch.setattr(held, "BLOCK", 3)
    monkeypatch.setattr(held, "SLICE", 4)
    rng = random.Random(3)
    words = ["plan", "planung", "Акт", "об", "one", "x,y", "ab", "two\u00a0six", "File_3.txt", "the", "\n"]
    docs = [(f"arc/{rng.choice(words).strip()}/File_{i}.txt", " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(40)]
    docs += [("arc/none.txt", None), ("arc/empty.txt", "")]
    asks = ["plan, one", "File_3.txt", "акт об", "ab", "the the lan", "", " ", None, "x,y", "zzz", "two six", "plan one the " * 9, "arc/none"]
    requests = spark.createDataFrame([(str(i), q) for i, q in enumerate(asks)], "trace_id string, query string")
    table = spark.createDataFrame(docs, "relative_path string, content string").repartition(3)
    pairs = requests.crossJoin(table).withColumn("score", sc.small_doc_score(F.col("query"), F.col("relative_path"), F.col("content")))
    want = rt.rank_by_score(pairs.where("score > 0"), ["trace_id"], 5, tie="relative_path")
    want = want.withColumn("snippet", sc.snippet_around(F.col("query"), F.col("content")))
    key = lambda df: sorted((r["trace_id"], r["rank"], r["relative_path"], r["score"], str(r["snippet"])) for r in df.collect())
    assert key(rt.small_doc_search(requests, table, 5)) == key(want)


def test_short_tokens_find_their_chunks(spark):
    chunks, scopes = _corpus(spark, ["акт о сдаче", "тракт дорог", "план", "об акте"])
    asks = spark.createDataFrame([("a", "акт", 0), ("b", "ак об", 0), ("c", "зз план", 0)], "trace_id string, query string, scope_id bigint")
    got = {(r["trace_id"], r["chunk_id"], r["score"]) for r in rt.keyword_matches(asks, chunks, scopes).collect()}
    assert got == {("a", "c0", 1.0), ("a", "c1", 1.0), ("a", "c3", 1.0), ("b", "c3", 0.88), ("c", "c2", 0.4)}


def test_a_moved_word_costs_one_anchor(spark):
    from folioframe.operators import corrections as co

    rows = [
        ("moved alpha beta gamma delta eps zeta eta", "alpha betta gamma delta epps zeta eta moved"),
        ("moved alpha beta gamma delta eps zeta eta", "alpha betta gamma delta epps zeta eta moved"),
        ("same same", "same same"),
        (None, "x"),
    ]
    df = spark.createDataFrame(rows, "raw_text string, corrected_text string")
    got = {(r["wrong"], r["replacement"]): r["count"] for r in co.rule_counts(co.mine_pairs(df)).collect()}
    assert got[("beta", "betta")] == 2 and got[("eps", "epps")] == 2


def test_longest_increasing_is_longest(spark):
    import random

    from folioframe.operators.corrections import _longest_increasing

    def longest(row):
        best = []
        for k, x in enumerate(row):
            best.append(1 + max((best[i] for i in range(k) if row[i] < x), default=0))
        return max(best, default=0)

    rng = random.Random(1)
    rows = [rng.sample(range(40), rng.randrange(0, 30)) for _ in range(60)]
    df = spark.createDataFrame([(r,) for r in rows], "v array<int>").withColumn("k", _longest_increasing("v"))
    for r in df.collect():
        kept = [x for x, k in zip(r.v, r.k) if k]
        assert kept == sorted(kept) and len(kept) == longest(r.v)


def test_sums_follow_an_upsert(spark):
    from folioframe.operators import ingest as ig

    before = [("a", "a1", "x"), ("a", "a2", "y"), ("b", "b1", None), ("c", "c1", "z")]
    after = [("a", "a1", "x"), ("a", "a2", "changed"), ("a", "a3", "new"), ("b", "b1", None)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id string, chunk_id string, content string")
    state = ig.chunk_sums(df(before))
    new = ig.apply_chunk_sums(state, df([r for r in before if r not in after]), df([r for r in after if r not in before]))
    rows = lambda d: sorted(map(tuple, d.select("doc_id", "n", "sum_a", "sum_b").collect()))
    assert rows(new) == rows(ig.chunk_sums(df(after))) != rows(state)
