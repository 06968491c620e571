"""Secret spans against Python's regular expressions, and the randomness battery."""

import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from cellmetry.llm import secrets
from cellmetry.session import ship
from llm_fixtures import SF01, docs_frame

BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
)


def base_spans(text):
    out = []
    for i, (kind, pattern, holds) in enumerate(BASE):
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text or "", re.A) if holds(m)]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def check_base(rows, got):
    texts = dict(rows)
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), r.doc_id
        for kind in ("assign", "access", "hex"):
            assert r[f"n_{kind}"] == sum(k == kind for k, *_ in want)


def test_base_spans(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_base(rows, secrets.find_secrets(docs).collect())


def test_hard_texts(spark):
    key = "AKIA" + "Q7" * 8
    texts = [
        "password = token = abcdefgh12", "PassWord:'abcdefgh' 😀 secret=\"ABCDEFGHI\"", "ſecret=abcdefghij",
        "token : = abcdefgh", "api_key=a.b.c.d.e-f apikey=12345678", "passwd=1234567 passwd=12345678",
        f"{key}{key} x{key.lower()}", "AKIAAKIA" + "A1" * 5, "AKIA123", "f" * 31 + "g" + "0" * 32,
        "secret=" + "0123456789abcdef" * 4, "é😀" * 50 + "api-key=abcdefgh token=é token=abcdefgh", "",
        "token=" * 500 + "abcdefgh", None,
    ]
    rows = list(enumerate(texts))
    docs = docs_frame(spark, rows)
    check_base(rows, secrets.find_secrets(docs).collect())


def p_value(token, alphabet):
    """The battery on one token, written plainly."""
    n, k = len(token), len(alphabet)
    v = [alphabet.index(c) for c in token]
    x, f = sum(token.count(c) ** 2 for c in set(token)) * k / n - n, k - 1
    tail = lambda z: 1 / (1 + math.exp(min(700, 1.5976 * z + 0.070565992 * z**3)))
    chi = tail(((x / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f)))
    high = [a >= k // 2 for a in v]
    runs, g = 1 + sum(a != b for a, b in zip(high, high[1:])), 2 * sum(high) * (n - sum(high))
    zr = 9 if g <= n else abs(runs - g / n - 1) / math.sqrt(g * (g - n) / (n * n * (n - 1)))
    m = sum(v) / n
    var = sum((a - m) ** 2 for a in v)
    zs = 9 if not var else abs(sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / var + 1 / n) * math.sqrt(n)
    ps = [min(1 - 1e-9, max(1e-15, p)) for p in (chi, 2 * tail(zr), 2 * tail(zs))]
    return max(1e-15, 0.5 - math.atan(sum(math.tan(math.pi * (0.5 - p)) for p in ps) / 3) / math.pi)


def tokens_of(seed):
    """(random tokens, structured tokens) of several lengths and encodings."""
    rng = random.Random(seed)
    good, bad = [], []
    for _ in range(60):
        for alphabet in (a for _, a in secrets.ENCODINGS):
            t = "".join(rng.choice(alphabet) for _ in range(rng.choice((24, 40, 80))))
            if re.search("[0-9]", t) and re.search("[A-Za-z]", t) and not re.search("[0-9a-f]{32}", t):
                good.append(t)
        unit = "".join(rng.choice("abcxyz12") for _ in range(3)) + "a1"
        bad.append((unit * 30)[: rng.choice((40, 80))])
        bad.append("Abcdefghijklmnopqrstuvw" * 2 + str(rng.randrange(100, 999)))
    return good, bad


def test_battery(spark):
    ship(spark)
    good, bad = tokens_of(5)
    rows = [(i, f"see {t} here") for i, t in enumerate([*good, *bad])]
    docs = docs_frame(spark, rows)
    column = F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"), F.split("text", " ")[1].alias("t")))
    tested = secrets._tested(docs.select("doc_id", column.alias("tokens"))).collect()
    for r in tested:
        token = rows[r.doc_id][1].split(" ")[1]
        alphabet = next(a for p, a in secrets.ENCODINGS if re.match(p, token))
        assert abs(r.tokens[0].q - math.floor(-math.log10(p_value(token, alphabet)) * secrets.STEPS)) <= 1
        assert r.tokens[0].stratum == max(s for s in secrets.STRATA if s <= len(token))
    named = {r.doc_id for r in secrets.find_secrets(docs).collect() if f"random:4:{4 + len(rows[r.doc_id][1].split(' ')[1])}" in r.spans}
    found = sum(i < len(good) for i in named)
    assert found >= 0.95 * len(good) and len(named) - found <= 0.05 * len(bad)


def test_step_up_procedure(spark):
    rows = [(20, 60)] * 3 + [(20, 40)] + [(20, 5)] * 16 + [(32, 3)] * 5
    df = spark.createDataFrame([([r],) for r in rows], "tokens array<struct<stratum:int,q:int>>")
    assert secrets.rejected_from(df, 0.05) == {20: 40}


def test_edges_and_plan(spark):
    rows = [(1, None), (2, ""), (3, "word " * 300000 + "password=abcdefgh1"), (4, "token=12345678"),
            (4, "token=12345678"), (None, "secret: longenough")]
    docs = docs_frame(spark, rows).withColumn("tokens", F.lit(1)).withColumn("base", F.lit(1))
    got = secrets.find_secrets(docs)
    assert sorted((r.doc_id or 0, r.spans) for r in got.collect()) == [
        (0, "assign:0:18"), (1, ""), (2, ""), (3, "assign:1500000:1500018"),
        (4, "assign:0:14"), (4, "assign:0:14"),
    ]
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_time_grows_with_the_text(spark):
    """Long runs, many matches and many parts: quadratic work would take many minutes."""
    rng = random.Random(3)
    hexes = " ".join("%032x" % rng.getrandbits(128) for _ in range(50000))
    mixed = "a_1/" * 20000
    value = "9fK3LmQ0zXc81VbNrT5yPq27"
    rows = [(1, "x" * 1_000_000), (2, hexes), (3, mixed), (4, "x1" * 100_000), (5, (value + " ") * 20000),
            (6, "x" * 500_000 + " password=abcdefgh1")]
    start = time.monotonic()
    got = {r.doc_id: r for r in secrets.find_secrets(docs_frame(spark, rows)).collect()}
    assert time.monotonic() - start < 60
    check_base(rows, got.values())
    assert got[1].spans == got[3].spans == "" and got[2].n_hex == 50000
    assert got[5].spans.split(",")[-1] == f"random:{19999 * 25}:{19999 * 25 + 24}"


def test_names_and_mixed_separators(spark):
    value, slashed = "9fK3LmQ0zXc81VbNrT5yPq27", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    wanted = [
        (f"session={value}", value), (f"?sig={value}", value), (f"AWS_SECRET_ACCESS_KEY={slashed}", slashed),
        (f"SESSION_KEY_1={value}&x=1", value), (f"files/of_a/{value}", value), (f"my_key_{value}+q/", f"{value}+q/"),
        (f"auth: {value}==", f"{value}=="), (f"password=abcdefgh1&sig={value}", value),
    ]
    docs = docs_frame(spark, [(i, f"see {t} é") for i, (t, _) in enumerate(wanted)])
    for r in secrets.find_secrets(docs).collect():
        text, token = f"see {wanted[r.doc_id][0]} é", wanted[r.doc_id][1]
        start = text.index(token)
        assert f"random:{start}:{start + len(token)}" in r.spans.split(","), (text, r.spans)
