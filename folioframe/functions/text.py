"""Text columns: tokens, normalisation, intents, parsing.

Everything here is a ``Column -> Column`` expression that stays in the JVM.
Patterns are matched on lowered text or with ``(?iu)``: plain ``(?i)`` does not
fold Cyrillic case in Java.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe import fixed_values as fx

TOKEN2 = "[а-яёa-z0-9]{2,}"
TOKEN3 = "[а-яёa-z0-9]{3,}"
_EDGE = r"(?U)^\s+|\s+$"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression inside a lambda is evaluated for every element; a bound one is not.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.regexp_replace(c, _EDGE, "")


def squeeze(c: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def has(c: Column, pattern: str) -> Column:
    """Case-insensitive (Unicode) pattern search."""
    return c.rlike("(?iu)(?:" + pattern + ")")


def tokens(c: Column, min_len: int = 2) -> Column:
    """Lower-case tokens of at least ``min_len`` letters or digits, in order."""
    pattern = TOKEN3 if min_len == 3 else "[а-яёa-z0-9]{%d,}" % min_len
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def raw_tokens(c: Column) -> Column:
    """Tokens with their original spelling."""
    return F.regexp_extract_all(
        F.coalesce(c, F.lit("")), F.lit("[а-яёА-ЯЁa-zA-Z0-9]{2,}"), F.lit(0)
    )


def lemma(token: Column) -> Column:
    """Base form without a morphology plug-in: lower case with ё folded to е."""
    return F.translate(F.lower(token), "ё", "е")


def lemmas(c: Column) -> Column:
    """Lemma tokens in order.  ё-folding keeps token borders, so it can run first."""
    return tokens(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Constant map lookup (null when absent)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def token_in_text(token: Column, text_lower: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Literal containment of a token, or of one of its scan aliases."""
    table = fx.SCAN_ALIASES if aliases is None else aliases
    hit = text_lower.contains(token)
    for word, forms in table.items():
        hit = hit | ((token == word) & any_of([text_lower.contains(f) for f in forms]))
    return hit


def alias_forms(aliases: dict[str, list[str]] | None = None) -> list[str]:
    table = fx.SCAN_ALIASES if aliases is None else aliases
    return [f for forms in table.values() for f in forms]


def stem_in_text(word: Column, text: Column, min_prefix: int = 4) -> Column:
    """True when a prefix of ``word`` of at least ``min_prefix`` letters occurs in ``text``.

    A longer prefix occurring implies the shortest one does, so one test is enough.
    """
    return F.when(F.length(word) < min_prefix, text.contains(word)).otherwise(
        text.contains(F.substring(word, 1, min_prefix))
    )


def count_in(tokens_col: Column, text: Column) -> Column:
    """Number of array elements that occur in the text."""
    return let(text, lambda t: F.size(F.filter(tokens_col, lambda x: t.contains(x))))


def literal_prefilter(query: Column, text: Column) -> Column:
    """Phrase of four or more letters, or all tokens (the single one when there is one)."""
    q = F.lower(strip(query))
    return let(
        F.lower(F.coalesce(text, F.lit(""))),
        lambda t: (t != "")
        & (((F.length(q) >= 4) & t.contains(q)) | F.forall(tokens(query), lambda x: t.contains(x))),
    )


def all_tokens_in_text(query_tokens: Column, query_lemmas: Column, text: Column, text_lemmas: Column) -> Column:
    """All tokens literally present, or else all lemmas present."""
    literal = let(F.lower(text), lambda low: F.forall(query_tokens, lambda t: token_in_text(t, low)))
    by_lemma = (F.size(query_lemmas) > 0) & (F.size(F.array_except(query_lemmas, text_lemmas)) == 0)
    return (F.size(query_tokens) > 0) & (F.length(text) > 0) & (literal | by_lemma)


# --- queries ---------------------------------------------------------------------------


def expand_mark(q: Column) -> Column:
    """Append the drawing mark of a numbered part ("ограждение 1" -> "Ограждение Ог-1")."""
    rx = F.lit("(?iu)" + fx.MARK_QUERY)
    kind = F.lower(F.regexp_extract(q, "(?iu)" + fx.MARK_QUERY, 1))
    num = F.regexp_extract(q, "(?iu)" + fx.MARK_QUERY, 2)
    prefix = F.coalesce(*[F.when(kind.startswith(stem), F.lit(mark)) for stem, mark in fx.MARK_PREFIXES])
    mark = F.concat_ws("-", prefix, num)
    phrase = F.when(kind.startswith("огражден"), F.concat(F.lit("Ограждение "), mark)).otherwise(mark)
    add = F.regexp_like(q, rx) & prefix.isNotNull() & ~F.lower(q).contains(F.lower(phrase))
    return F.when(add, F.concat(q, F.lit(" "), phrase)).otherwise(q)


def normalize_query(
    c: Column,
    replacements: list[tuple[str, str]] | None = None,
    appends: list[tuple[str, str]] | None = None,
) -> Column:
    """Collapse white space, replace phrases, append aliases, expand drawing marks."""
    rules = fx.QUERY_REPLACEMENTS if replacements is None else replacements
    extras = fx.QUERY_APPENDS if appends is None else appends
    table = F.array(*[F.struct(F.lit(src).alias("src"), F.lit(dst).alias("dst")) for src, dst in rules])

    def rewrite(q0: Column) -> Column:
        lowered = F.lower(q0)
        pattern = lambda r: F.concat(F.lit(r"(?iu)\Q"), r["src"], F.lit(r"\E"))
        out = F.aggregate(
            F.filter(table, lambda r: lowered.contains(r["src"])),
            q0,
            lambda acc, r: F.regexp_replace(acc, pattern(r), r["dst"]),
        )
        tail = [F.when(lowered.contains(src), F.lit(extra)) for src, extra in extras]
        return F.concat_ws(" ", out, *tail)

    q = let(squeeze(c), rewrite) if rules else squeeze(c)
    return F.trim(let(q, expand_mark))


def is_summary_query(c: Column) -> Column:
    return (strip(c) != "") & has(c, fx.SUMMARY_INTENT)


def query_intent(c: Column) -> Column:
    """open / analyze / summarize / qa, in this order."""
    summary = is_summary_query(c)
    edge = r"(?<![\p{L}\p{N}_])" + fx.OPEN_INTENT + r"(?![\p{L}\p{N}_])"
    return (
        F.when(has(c, edge) & ~summary, "open")
        .when(has(c, fx.ANALYZE_INTENT), "analyze")
        .when(summary, "summarize")
        .otherwise("qa")
    )


def looks_like_filename(c: Column) -> Column:
    """Extension, path separator or drawing code; or two tokens with digits among ten."""
    q = strip(c)
    toks = tokens(q, 3)
    with_digit = F.size(F.filter(toks, lambda t: t.rlike("[0-9]")))
    return (F.length(q) >= 4) & (
        has(q, fx.FILE_NAME_HINT) | ((with_digit >= 2) & (F.size(toks) <= 10))
    )


def has_doc_number(name: Column, number: Column) -> Column:
    """The number stands alone in the name, not inside another number."""
    pattern = F.concat(
        F.lit(r"(?iu)(?:№|#|(?<![\p{L}\p{N}_]))"), number, F.lit(r"(?:(?![\p{L}\p{N}_])|\.|_|-)")
    )
    return (number != "") & (name != "") & F.regexp_like(name, pattern)


def doc_number_score(name: Column, numbers: Column) -> Column:
    """+100 for each asked number in the name, -40 for each other number in it."""
    found = F.regexp_extract_all(name, F.lit(r"(\d{2,})"), F.lit(1))
    hits = F.size(F.filter(numbers, lambda n: has_doc_number(name, n)))
    others = F.size(F.filter(found, lambda n: ~F.array_contains(numbers, n)))
    return F.when((name == "") | (F.size(numbers) == 0), 0).otherwise(hits * 100 - others * 40)


def is_follow_up(c: Column) -> Column:
    """A short continuation of the dialog rather than a new question."""
    q = strip(c)
    words = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    return (q != "") & (
        ((F.length(q) < 80) & has(q, fx.FOLLOW_UP))
        | ((F.length(q) < 35) & ~q.rlike(r"\d") & (words <= 8))
    )


def doc_type_from_path(path: Column) -> Column:
    target = F.lower(path)
    return F.coalesce(
        *[F.when(target.rlike(rx), F.lit(label)) for rx, label in fx.DOC_TYPES],
        F.lit(fx.DEFAULT_DOC_TYPE),
    )


# --- parsing ----------------------------------------------------------------------------


def parse_analysis(c: Column) -> Column:
    """Labelled analysis text -> struct(gist, key_points, doc_type)."""
    raw = strip(F.coalesce(c, F.lit("")))
    gist = squeeze(F.regexp_extract(raw, r"(?siu)суть\s*:\s*(.+?)(?=\n(?:главное|тип)\s*:|$(?![\r\n]))", 1))
    kind = F.regexp_replace(strip(F.regexp_extract(raw, r"(?miu)тип\s*:\s*(.+?)$", 1)), r"\.+$", "")
    block = F.regexp_extract(raw, r"(?siu)главное\s*:\s*(.+?)(?=\nтип\s*:|$(?![\r\n]))", 1)

    def clean(line: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(strip(line), r"^[-•*]\s*", ""), r"^\d+[.)]\s*", "")

    def lines(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda x: x != "")

    points = F.filter(F.transform(lines(block), clean), lambda x: x != "")
    plain = lines(raw)
    fallback = (gist == "") & (F.size(points) == 0) & (F.size(plain) > 0)
    tail = F.filter(
        F.transform(F.slice(plain, 2, 7), lambda x: F.regexp_replace(x, r"^[-•* ]+", "")), lambda x: x != ""
    )
    return F.struct(
        F.when(fallback, F.substring(plain[0], 1, 500)).otherwise(gist).alias("gist"),
        F.slice(F.when(fallback, tail).otherwise(points), 1, 8).alias("key_points"),
        F.when(kind == "", fx.DEFAULT_DOC_TYPE).otherwise(kind).alias("doc_type"),
    )


_QA = r"(?si)\[Q\]\s*:\s*(.*?)\s*\[A\]\s*:\s*(.*?)(?=\[Q\]\s*:|$(?![\r\n]))"


def qa_pairs(c: Column) -> Column:
    """Question/answer structs from the tagged form, else from a JSON array in the text."""
    text = strip(F.coalesce(c, F.lit("")))
    tagged = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, F.lit(_QA), F.lit(1)), strip).alias("question"),
        F.transform(F.regexp_extract_all(text, F.lit(_QA), F.lit(2)), strip).alias("answer"),
    )
    tagged = F.filter(
        F.transform(
            tagged, lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer"))
        ),
        lambda p: (p["question"] != "") & (p["answer"] != ""),
    )
    blob = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(blob, "array<struct<question:string,answer:string>>")
    parsed = F.filter(
        F.transform(
            parsed,
            lambda p: F.struct(
                strip(F.coalesce(p["question"], F.lit(""))).alias("question"),
                strip(F.coalesce(p["answer"], F.lit(""))).alias("answer"),
            ),
        ),
        lambda p: (p["question"] != "") & (p["answer"] != ""),
    )
    empty = F.from_json(F.lit("[]"), "array<struct<question:string,answer:string>>")
    return F.when(F.size(tagged) > 0, tagged).otherwise(F.coalesce(parsed, empty))


def user_correction(c: Column) -> Column:
    """The corrected statement in a user's reply, or null."""
    raw = strip(F.coalesce(c, F.lit("")))
    found = []
    for rx in fx.CORRECTION_PATTERNS:
        body = F.regexp_replace(F.regexp_extract(raw, "(?siu)" + rx, 1), "^[ .\"']+|[ .\"']+$", "")
        found.append(F.when(body != "", body))
    plain = F.when((F.length(raw) > 12) & ~raw.endswith("?"), raw)
    return F.when(raw != "", F.coalesce(*found, plain))


def training_correction(c: Column) -> Column:
    """Correction text used as a training answer; null when the feedback is too short."""
    fb = strip(F.coalesce(c, F.lit("")))
    rx = "(?siu)" + fx.TRAINING_CORRECTION
    body = F.when(fb.rlike(rx), strip(F.regexp_extract(fb, rx, 1))).otherwise(fb)
    body = F.substring(body, 1, 2000)
    return F.when((F.length(fb) >= 12) & (body != ""), body)


def is_no_answer(c: Column) -> Column:
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return (t == "") | any_of([t.contains(m) for m in fx.NO_ANSWER_MARKERS])


def todo_items(c: Column) -> Column:
    """To-do texts of a transcript: the first matching pattern of each line."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\r\n]"), strip), lambda x: x != "")

    def item(line: Column) -> Column:
        hits = []
        for rx in fx.TODO_PATTERNS:
            body = strip(F.regexp_extract(line, "(?iu)" + rx, 1))
            hits.append(F.when(line.rlike("(?iu)" + rx), body))
        return F.coalesce(*hits)

    return F.filter(F.transform(lines, item), lambda x: x.isNotNull())


def fix_speech(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Replace known recognition errors; blanks and case variants are folded."""
    out = strip(F.translate(c, "\u00a0\u202f\u2009", "   "))
    for rx, repl in fx.SPEECH_FIXES if rules is None else rules:
        out = F.regexp_replace(out, "(?iuU)" + rx, repl)
    return F.when(strip(c) == "", c).otherwise(squeeze(out))


def redact(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    for rx, token in fx.REDACTIONS if rules is None else rules:
        c = F.regexp_replace(c, rx, token)
    return c


def normalize_path(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\\", "/"), "/+$", "")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot, or an empty string (a leading dot is no extension)."""
    return F.lower(F.regexp_extract(base_name(name), r"[^.](\.[^.]+)$", 1))


def guess_suffix(name: Column, content: Column) -> Column:
    """Extension from the name, else from the magic bytes."""
    head = F.hex(F.substring(content, 1, 5))
    magic = (
        F.when(head.startswith("25504446"), ".pdf")
        .when(head.startswith("504B0304"), ".docx")
        .when(head == "7B5C727466", ".rtf")
        .otherwise("")
    )
    return F.when(F.coalesce(name, F.lit("")) != "", suffix(name)).otherwise(magic)


def corpus_id(c: Column, aliases: dict[str, str], default: str) -> Column:
    """Alias -> corpus id; blank or unknown values take the default."""
    key = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "\\", "/")
    return F.coalesce(lookup(aliases, key), F.lit(default))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"(?U)[^\w\- ]+", "")
    s = F.substring(F.translate(s, " ", "-"), 1, 80)
    return F.when(s == "", "task").otherwise(s)


def remove_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\0"), F.lit(""))


def error_key(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text == "", "unknown").otherwise(F.substring(F.split_part(text, F.lit(":"), F.lit(1)), 1, 80))


def keyword_hits(answer: Column, keywords: Column) -> Column:
    """Keywords found in the answer: as a substring, or sharing a token either way."""
    low = F.lower(F.coalesce(answer, F.lit("")))

    def search(text: Column, toks: Column) -> Column:
        def found(k: Column) -> Column:
            key = F.lower(k)
            return text.contains(key) | F.exists(toks, lambda t: t.contains(key) | key.contains(t))

        return F.filter(keywords, found)

    return let(low, lambda text: let(F.array_distinct(tokens(text)), lambda toks: search(text, toks)))


def keyword_score(answer: Column, keywords: Column) -> Column:
    n = F.size(keywords)
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.size(keyword_hits(answer, keywords)) / n)


# --- quality ------------------------------------------------------------------------------


def share_of(c: Column, char_class: str) -> Column:
    """Share of characters in the class (0 for empty text)."""
    n = F.length(c)
    kept = n - F.length(F.regexp_replace(c, char_class, ""))
    return F.when(n > 0, kept / n).otherwise(F.lit(0.0))


def text_quality(c: Column, script: str = "[а-яёА-ЯЁ]", stub_text: str | None = None) -> Column:
    """0..1: how much a piece of text looks like prose in the given script."""
    facts = let(
        strip(F.coalesce(c, F.lit(""))),
        lambda t: F.struct(
            t.alias("t"),
            F.length(t).alias("n"),
            share_of(t, script).alias("letters"),
            share_of(t, "[0-9]").alias("digits"),
        ),
    )
    return let(facts, lambda x: _quality(x["t"], x["n"], x["letters"], x["digits"], stub_text))


def _quality(t: Column, n: Column, letters: Column, digits: Column, stub_text: str | None) -> Column:
    score = (
        F.lit(0.35)
        + F.least(letters, F.lit(0.55))
        + F.least(n / 400.0, F.lit(0.25))
        - F.when(digits > 0.4, 0.15).otherwise(0.0)
    )
    empty = (n == 0) if stub_text is None else (n == 0) | (t == stub_text)
    return (
        F.when(empty, 0.0)
        .when(n < 24, 0.15)
        .when(F.substring(t, 1, 120).rlike(r"^[\d\s.,\-+]+$"), 0.05)
        .when((digits > 0.55) & (letters < 0.08), 0.1)
        .when((letters < 0.12) & (digits > 0.25), 0.2)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    )
