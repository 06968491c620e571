"""Secret scan: fixed patterns, and a battery of randomness tests on other long tokens.

Base spans come from three patterns.  Further tokens of letters and digits are tested for
being random in the alphabet of their inferred encoding: chi-squared uniformity of the
characters, Wald-Wolfowitz runs about the middle of the alphabet, and serial correlation at
lag one.  The three p-values are combined (Cauchy), and within each stratum of lengths
the Benjamini-Hochberg procedure over all tokens of the corpus decides which of them are
not random.  What it does not reject is reported as kind ``random``.

A token that mixes '+' or '/' with '_' or '-' is in no encoding: its parts between '+' and '/' and
its parts between '_' and '-' are tested instead, and both may be reported.

All of it is DataFrame and SQL functions on the row of the document; only counts per
stratum and p-value class are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.session import cut_lineage

# The base patterns. Lookaheads only say early where a match cannot start.
ASSIGN = (
    "(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Tokens that are tested: 20 characters or more with a letter and a digit among them; '=' only
#: pads the end, so that names and values are tokens of their own. The quantifiers give nothing
#: back, so a run is read once; its letter and digit are looked for in the match.
TOKEN = "[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?"
BOTH = "c.t RLIKE '[0-9]' AND c.t RLIKE '[A-Za-z]'"
MIN_ASSIGNED = 8
#: Lower ends of the strata of lengths.
STRATA = (20, 24, 32, 48, 64, 128)
RATE = 0.05
#: Classes of p-values per power of ten.
STEPS = 20

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings from the smallest alphabet to the largest: pattern of a token, alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    ("^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
KINDS = ("assign", "access", "hex", "random")


def _matches(text: Column, kind: str, pattern: str) -> list[Column]:
    """Columns of all matches of a pattern and of what lies between them."""
    hit, none = F.rlike(text, F.lit(pattern)), F.array().cast("array<string>")
    return [
        F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m_{kind}"),
        F.when(hit, F.split(text, pattern, -1)).otherwise(none).alias(f"b_{kind}"),
    ]


def _width(array: str) -> str:
    """SQL for the length of the blocks an array is cut into: the root of its size."""
    return f"CAST(greatest(1, ceil(sqrt(size({array})))) AS int)"


def _blocks(array: str) -> str:
    """SQL for the blocks of an array, which must be a column or a lambda's variable."""
    w = _width(array)
    return f"""transform(sequence(0, CAST(greatest(size({array}) - 1, 0) DIV {w} AS int)),
        k -> slice({array}, k * {w} + 1, {w}))"""


def _starts(lengths: str) -> str:
    """SQL for the sums of all lengths before each one.

    Sums grow block by block, so no array longer than a block is copied per element.
    """
    growing = """named_struct('at', acc.at + {step}, 'out', concat(acc.out, array(acc.at)))"""
    none = "CAST(array() AS array<int>)"
    total = "aggregate(x, 0, (z, y) -> z + y)"
    return f"""transform(array({lengths}), l -> transform(array({_blocks('l')}), blocks -> flatten(zip_with(
      blocks,
      aggregate(blocks, named_struct('at', 0, 'out', {none}), (acc, x) -> {growing.format(step=total)}, acc -> acc.out),
      (block, top) -> aggregate(block, named_struct('at', top, 'out', {none}),
        (acc, x) -> {growing.format(step='x')}, acc -> acc.out))))[0])[0]"""


def _placed(kind: str) -> str:
    """SQL for the (start, end) of the matches in code points."""
    m, b = f"m_{kind}", f"b_{kind}"
    return f"""transform({_starts(f'transform({m}, (x, i) -> length({b}[i]) + length(x))')}, (at, i) ->
      named_struct('s', at + length({b}[i]), 'e', at + length({b}[i]) + length({m}[i])))"""


def _parts(separators: str) -> str:
    """SQL for the parts of a token c that are tokens too, with their places."""
    parts = f"split(c.t, '{separators}', -1)"
    return f"""filter(zip_with({parts}, {_starts(f'transform({parts}, x -> length(x) + 1)')}, (x, at) ->
      named_struct('s', c.s + at, 'e', c.s + at + length(x), 't', x)),
      c -> c.t RLIKE '^{TOKEN}$' AND {BOTH})"""


def _free() -> str:
    """SQL for the tokens that touch no base span; a block of tokens looks at the spans in its reach."""
    reach = "array(named_struct('from', array_min(block.s), 'to', array_max(block.e)))"
    near = f"transform({reach}, r -> filter(base, b -> b.s < r.to AND r.from < b.e))"
    return f"""flatten(transform({_blocks('tokens')}, block -> transform({near}, near ->
        filter(block, c -> NOT exists(near, b -> b.s < c.e AND c.s < b.e)))[0]))"""


def _tail(z: str) -> str:
    """SQL for the upper tail of the normal distribution (logistic approximation)."""
    return f"(1 / (1 + exp(least(700D, 1.5976 * {z} + 0.070565992 * {z} * {z} * {z}))))"


def _tested(found: DataFrame) -> DataFrame:
    """Adds to each candidate (s, e, t) its stratum and the class of its p-value."""
    alphabet = "CASE " + " ".join(f"WHEN t RLIKE '{p}' THEN '{a}'" for p, a in ENCODINGS) + " END"
    step = lambda df, fields: df.withColumn(
        "tokens", F.expr(f"transform(tokens, c -> named_struct('s', c.s, 'e', c.e, {fields}))")
    )
    found = step(found, "'t', rtrim('=', c.t)")
    found = step(found, f"'t', c.t, 'a', {alphabet.replace('t RLIKE', 'c.t RLIKE')}")
    found = found.withColumn("tokens", F.expr("filter(tokens, c -> c.a IS NOT NULL AND length(c.t) >= 20)"))
    found = step(
        found,
        """'n', CAST(length(c.t) AS double), 'k', CAST(length(c.a) AS double),
        'v', transform(regexp_extract_all(c.t, '(.)', 1), x -> CAST(locate(x, c.a) AS double)),
        'c2', aggregate(sequence(1, length(c.a)), CAST(0 AS double), (z, i) -> z + pow(
            CAST(length(c.t) - length(replace(c.t, substr(c.a, i, 1), '')) AS double), 2D)),
        'u', translate(c.t, c.a, concat(repeat('0', CAST(length(c.a) DIV 2 AS int)),
            repeat('1', CAST(length(c.a) - length(c.a) DIV 2 AS int))))""",
    )
    found = step(
        found,
        """'n', c.n, 'x', c.c2 * c.k / c.n - c.n, 'f', c.k - 1, 'v', c.v,
        'm', aggregate(c.v, 0D, (z, x) -> z + x) / c.n,
        'n1', CAST(length(replace(c.u, '0', '')) AS double),
        'r', 1 + (length(c.u) - length(replace(c.u, '01', ''))) / 2
              + (length(c.u) - length(replace(c.u, '10', ''))) / 2""",
    )
    found = step(
        found,
        """'n', c.n, 'r', c.r, 'g', 2 * c.n1 * (c.n - c.n1),
        'zc', (cbrt(c.x / c.f) - (1 - 2 / (9 * c.f))) / sqrt(2 / (9 * c.f)),
        'lag', aggregate(zip_with(c.v, slice(c.v, 2, size(c.v)), (x, y) ->
            IF(y IS NULL, 0D, (x - c.m) * (y - c.m))), 0D, (z, x) -> z + x),
        'var', aggregate(c.v, 0D, (z, x) -> z + (x - c.m) * (x - c.m))""",
    )
    found = step(
        found,
        """'n', c.n, 'zc', c.zc,
        'zr', IF(c.g <= c.n, 9D, abs(c.r - c.g / c.n - 1) / sqrt(c.g * (c.g - c.n) / (c.n * c.n * (c.n - 1)))),
        'zs', IF(c.var = 0, 9D, abs(c.lag / c.var + 1 / c.n) * sqrt(c.n))""",
    )
    turned = " + ".join(
        f"tan(pi() * (0.5D - least(1 - 1e-9D, greatest(1e-15D, {p}))))"
        for p in (_tail("c.zc"), f"(2 * {_tail('c.zr')})", f"(2 * {_tail('c.zs')})")
    )
    found = step(found, f"'n', c.n, 'p', greatest(1e-15D, 0.5D - atan(({turned}) / 3) / pi())")
    stratum = "CASE " + " ".join(f"WHEN c.n >= {n} THEN {n}" for n in reversed(STRATA)) + " END"
    return step(found, f"'stratum', {stratum}, 'q', CAST(floor(-log10(c.p) * {STEPS}) AS int)")


def rejected_from(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per stratum the lowest p-value class that is rejected as random, if any is.

    Benjamini and Hochberg's step-up procedure over all tokens of the stratum, on the
    classes' upper ends; a few hundred counts, whatever the size of the corpus.
    """
    rows = (
        found.select(F.explode("tokens").alias("c"))
        .groupBy("c.stratum", "c.q")
        .count()
        .collect()
    )
    limits: dict[int, int] = {}
    for stratum in {r["stratum"] for r in rows}:
        counts = {r["q"]: r["count"] for r in rows if r["stratum"] == stratum}
        total, below = sum(counts.values()), 0
        for q in sorted(counts, reverse=True):
            below += counts[q]
            if 10 ** (-q / STEPS) <= rate * below / total:
                limits[stratum] = q
    return limits


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, ordered by start and then in
    the order of KINDS; base_sha256 is taken over those of the three patterns.  Random
    tokens are reported where they touch no base span.  Null texts count as empty and
    have no spans; repeated rows are scanned as rows of their own; other columns
    are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text)
    column = F.col("text")
    matched = rows.select(
        "doc_id",
        *(c for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN)) for c in _matches(column, k, p)),
        F.when(F.rlike(column, F.lit(ASSIGN)), F.regexp_extract_all(column, F.lit(ASSIGN), F.lit(1)))
        .otherwise(F.array().cast("array<string>"))
        .alias("values"),
    )
    placed = matched.select(
        "doc_id", "values", "m_random", *(F.expr(_placed(k)).alias(f"p_{k}") for k in KINDS)
    )
    ranked = [
        f"transform({source}, (x, i) -> named_struct('s', x.s, 'k', {i}, 'e', x.e))"
        for i, source in enumerate(
            (f"filter(p_assign, (x, i) -> length(values[i]) >= {MIN_ASSIGNED})", "p_access", "p_hex")
        )
    ]
    based = placed.select(
        "doc_id",
        F.expr(f"array_sort(concat({', '.join(ranked)}))").alias("base"),
        F.expr(
            f"filter(transform(p_random, (x, i) -> named_struct('s', x.s, 'e', x.e, 't', m_random[i])), c -> {BOTH})"
        ).alias("tokens"),
    )
    mixed = "c.t RLIKE '[+/]' AND c.t RLIKE '[_-]'"
    parts = f"concat({_parts('[+/]')}, {_parts('[_-]')})"
    based = based.withColumn(
        "tokens", F.expr(f"flatten(transform(tokens, c -> IF({mixed}, {parts}, array(c))))")
    )
    free = based.withColumn("tokens", F.expr(_free()))
    found = cut_lineage(_tested(free))
    limits = rejected_from(found, rate)
    limit = "CASE c.stratum " + " ".join(f"WHEN {s} THEN {q}" for s, q in limits.items()) + " ELSE 1000000 END"
    random = f"transform(filter(tokens, c -> c.q < {limit if limits else 1000000}), c -> named_struct('s', c.s, 'k', 3, 'e', c.e))"
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    joined = lambda spans: (
        f"concat_ws(',', transform({spans}, x -> concat_ws(':', array({kinds})[x.k], x.s, x.e)))"
    )
    counts = [
        F.expr(f"CAST(size(filter(base, x -> x.k = {i})) AS long)").alias(f"n_{KINDS[i]}")
        for i in range(3)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined(f"array_sort(concat(base, {random}))")).alias("spans"),
    )
