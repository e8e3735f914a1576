import random
import re

from folioframe.llm import secrets as sx


def plain(text):
    """The base patterns, each run alone over the whole text."""
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=sx._place)


def test_base_spans():
    rng = random.Random(5)
    parts = ["token", "=", " ", "secret", ":", "\"", "'", "password=", "api_key", "ApiKey", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef" * 4, "é", "\n", "PaSSwd : x", "ſecret=abcdefghij", "toKen=abcdefghij", "secret=token=password", "/._-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert sx.base_spans(text) == plain(text), text


def test_grammar_finds_formats(spark):
    rng = random.Random(1)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    access = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    word = lambda: "".join(rng.choice(["then", "tion", "er", "an", "ou", "ble", "ing"]) for _ in range(rng.randint(4, 7)))
    rows = [(i, f'{word()} token = "{key()}" {access()} ' + " ".join(word() for _ in range(60))) for i in range(150)]
    odd = [(1000, "x " + key()[:28] + " y"), (1001, None), (1002, ""), (1003, " ".join(word() for _ in range(200))), (None, "a" * 300_000), (1000, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(3)
    grammars = sx.infer(docs)
    got = {(r.doc_id, len(r.spans) - len(r.base)) for r in sx.find_secrets(docs, grammars).collect()}
    assert (1000, 1) in got and (1000, 0) in got and (1001, 0) in got and (1003, 0) in got and (None, 0) in got
    assert sum(n for i, n in got if i is not None and i < 1000) == 0
    assert sx.find_secrets(docs.limit(0), sx.infer(docs.limit(0))).count() == 0
