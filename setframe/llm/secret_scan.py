"""Secrets: fixed patterns, and a battery of randomness tests for other tokens.

Everything is a column expression. Matches are located by what stands between them: a text split by a
pattern gives the gaps, and gaps and matches in turn give every position.

Every token of at least ``LEAST`` characters gets an encoding: the smallest alphabet that holds its
letters and digits, with separators left out, since a uniform key is uniform over the rest as well. A
token with too many separators for that is tested whole over base64. Against the hypothesis that the
token is uniform over its alphabet stand four tests: chi-squared of the counts, the number of runs above
and below the middle of the alphabet, the serial correlation, and how common its letters are in prose
(which tells words apart where the others have little power). The smallest of the four p-values, times
four, is the token's. Tests of short tokens tell little, so tokens are judged among their like: within an
encoding and length band, the procedure of Benjamini and Hochberg at level
``RATE`` finds those that are not random, and what it does not find counts as a key. P-values enter as
counts on a logarithmic grid, rounded up, so that any number of tokens is settled by a small table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setframe.session import materialise

KINDS = ("assign", "access", "hex")
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"

LEAST = 20
SEPARATORS = "-_+/"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by size, and the tokens without separators that each can hold.
ENCODINGS = {
    "decimal": (_DIGITS, "^[0-9]+$"),
    "hex": (_DIGITS + "abcdef", "^[0-9a-f]+$"),
    "HEX": (_DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    "lower": (_LOWER, "^[a-z]+$"),
    "UPPER": (_UPPER, "^[A-Z]+$"),
    "base32": (_UPPER + "234567", "^[A-Z2-7]+$"),
    "alnum": (_DIGITS + _LOWER, "^[0-9a-z]+$"),
    "ALNUM": (_DIGITS + _UPPER, "^[0-9A-Z]+$"),
    "letters": (_UPPER + _LOWER, "^[A-Za-z]+$"),
    "base62": (_UPPER + _LOWER + _DIGITS, "^[A-Za-z0-9]+$"),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", ""),  # tested whole
}
#: Rounded shares of letters in English prose, per thousand; digits and signs count as ``RARE``.
SHARES = dict(zip("etaoinshrdlcumwfgypbvkjxqz",
                  (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8,
                   1.5, 1.5, 1, 0.7), strict=True))
RARE = 3
RATE = 0.05
STEPS = 20  # grid steps to a factor of ten
MOST_LEVEL = 400
#: Matches that are placed one after the other.
BLOCK = 256


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(pattern: str, kind: int, checked: str | None = None) -> str:
    """SQL for ``array<struct<start, kind, stop, token>>`` of a pattern's matches in ``t``.

    Matches are placed within blocks first, then blocks by their lengths, so the time does not grow with
    the square of their number. ``checked``: the group whose length the caller tests afterwards, instead of the whole match.
    """
    p = _quoted(pattern)
    shown = checked or "0"
    span = "struct<start: int, kind: int, stop: int, token: string>"
    matches = f"""arrays_zip(slice(split(t, {p}, -1), 1, size(regexp_extract_all(t, {p}, 0))),
        regexp_extract_all(t, {p}, 0), regexp_extract_all(t, {p}, {shown}))"""
    block = f"""aggregate(slice(z, b * {BLOCK} + 1, {BLOCK}),
        named_struct('at', 0, 'spans', cast(array() as array<{span}>)),
        (acc, m) -> named_struct(
          'at', acc.at + length(m.`0`) + length(m.`1`),
          'spans', concat(acc.spans, array(named_struct(
            'start', acc.at + length(m.`0`), 'kind', {kind},
            'stop', acc.at + length(m.`0`) + length(m.`1`), 'token', m.`2`)))))"""
    offsets = """aggregate(blocks, named_struct('at', 0, 'all', cast(array() as array<int>)),
        (acc, b) -> named_struct('at', acc.at + b.at, 'all', concat(acc.all, array(acc.at))),
        acc -> acc.all)"""
    shifted = f"""flatten(zip_with(blocks, {offsets}, (b, o) -> transform(b.spans, s -> named_struct(
        'start', s.start + o, 'kind', s.kind, 'stop', s.stop + o, 'token', s.token))))"""
    # ``transform(array(x), name -> ...)[0]`` names a value, so that it is computed once.
    return f"""
      case when t rlike {p} then
        transform(transform(array({matches}), z ->
            transform(sequence(0, (size(z) - 1) div {BLOCK}), b -> {block})), blocks -> {shifted})[0]
      else cast(array() as array<{span}>) end"""


def base_spans() -> Column:
    """Spans of the fixed patterns in column ``t``, by start and then kind."""
    assign = f"filter({_located(ASSIGN, 0, '2')}, s -> length(s.token) >= 6)"
    access = f"filter({_located(ACCESS, 1)}, s -> length(s.token) >= 20)"
    return F.expr(f"""array_sort(transform(concat({assign}, {access}, {_located(HEX, 2)}),
        s -> named_struct('start', s.start, 'kind', s.kind, 'stop', s.stop)))""")


def _upper_tail(z: str) -> str:
    """P(Z > z) of the normal distribution (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    series = (f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * "
              f"(-1.821255978 + {t} * 1.330274429))))")
    tail = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {series})"
    return f"(case when {z} >= 0 then {tail} else 1 - {tail} end)"


def _scores(letters: str) -> str:
    """SQL of the standardised logarithms of the shares in prose of an alphabet's letters."""
    logs = [math.log(SHARES.get(c.lower(), RARE)) for c in letters]
    mean = sum(logs) / len(logs)
    spread = math.sqrt(sum((x - mean) ** 2 for x in logs) / len(logs))
    return "array(" + ", ".join(f"{(x - mean) / spread:.6f}D" for x in logs) + ")"


def _tokens() -> str:
    """Tokens of ``t`` with their encoding, alphabet and values."""
    encoding = "case " + " ".join(
        f"when s.joined rlike {_quoted(shape)} then '{name}'"
        for name, (_, shape) in ENCODINGS.items() if shape) + " end"
    alphabet = "case " + " ".join(f"when x.encoding = '{name}' then '{letters}'"
                                  for name, (letters, _) in ENCODINGS.items()) + " end"
    joined = f"""transform({_located(TOKEN, 0)}, s -> named_struct('start', s.start,
        'stop', s.stop, 'token', translate(s.token, '_-', '/+'),
        'joined', translate(s.token, '{SEPARATORS}', '')))"""
    named = f"""transform({joined}, s ->
        case when length(s.joined) * 4 >= length(s.token) * 3 then named_struct('start', s.start,
          'stop', s.stop, 'token', s.joined, 'encoding', {encoding})
        else named_struct('start', s.start, 'stop', s.stop, 'token', s.token,
          'encoding', 'base64') end)"""
    lettered = f"""transform({named}, x -> named_struct('start', x.start, 'stop', x.stop,
        'token', x.token, 'encoding', x.encoding, 'alphabet', {alphabet}))"""
    return f"""transform({lettered}, x -> named_struct('start', x.start, 'stop', x.stop,
        'encoding', x.encoding, 'k', length(x.alphabet), 'n', length(x.token),
        'v', transform(split(x.token, ''), c -> instr(x.alphabet, c) - 1)))"""


def _counted() -> str:
    """The sums that the tests need, in one step per token."""
    squares = """aggregate(sequence(0, x.k - 1), cast(0 as double), (a, c) ->
        a + power(size(filter(x.v, y -> y = c)), 2))"""
    total = "aggregate(x.v, cast(0 as double), (a, y) -> a + y)"
    high = "size(filter(x.v, y -> y * 2 >= x.k))"
    runs = """1 + size(filter(sequence(1, x.n - 1), i ->
        (x.v[i] * 2 >= x.k) <> (x.v[i - 1] * 2 >= x.k)))"""
    # Alphabets of digits and a few letters write no words.
    common = "case " + " ".join(
        f"when x.encoding = '{name}' then aggregate(x.v, cast(0 as double), (a, y) -> "
        f"a + {_scores(letters)}[y])" for name, (letters, _) in ENCODINGS.items()
        if name not in ("decimal", "hex", "HEX")) + " else 0D end"
    return f"""transform({_tokens()}, x -> named_struct('start', x.start, 'stop', x.stop,
        'encoding', x.encoding, 'k', x.k, 'n', x.n, 'v', x.v, 'squares', {squares},
        'mean', {total} / x.n, 'high', {high}, 'runs', {runs}, 'common', {common}))"""


def _tested() -> str:
    products = """aggregate(sequence(1, x.n - 1), cast(0 as double), (a, i) ->
        a + (x.v[i] - x.mean) * (x.v[i - 1] - x.mean))"""
    spread = "aggregate(x.v, cast(0 as double), (a, y) -> a + (y - x.mean) * (y - x.mean))"
    chi = "(x.k * x.squares / x.n - x.n - (x.k - 1)) / sqrt(2.0 * (x.k - 1) * (x.n - 1) / x.n)"
    pairs = "(2.0 * x.high * (x.n - x.high))"
    runs = f"""case when x.high = 0 or x.high = x.n then 9.0 else
        (x.runs - {pairs} / x.n - 1)
        / sqrt({pairs} * ({pairs} - x.n) / (1.0 * x.n * x.n * (x.n - 1)) + 1e-9) end"""
    serial = f"""case when {spread} = 0 then 9.0 else
        ({products} / {spread} + 1.0 / (x.n - 1)) * sqrt(x.n) end"""
    return f"""transform({_counted()}, x -> named_struct('start', x.start, 'stop', x.stop,
        'encoding', x.encoding, 'n', x.n, 'chi', {chi}, 'runs', {runs}, 'serial', {serial},
        'common', x.common / sqrt(x.n)))"""


def tested_tokens() -> Column:
    """Tokens of column ``t`` as ``array<struct<start, stop, stratum, level>>``: the stratum names
    encoding and length band, the level is the p-value's place on the grid (0: at least 1)."""
    p = f"""4 * least({_upper_tail('x.chi')}, 2 * {_upper_tail('abs(x.runs)')},
                      2 * {_upper_tail('abs(x.serial)')}, {_upper_tail('x.common')})"""
    level = f"""cast(least({MOST_LEVEL}, greatest(0, floor(-{STEPS} * log10(greatest({p}, 1e-30)))))
                     as int)"""
    stratum = "concat(x.encoding, ':', cast(floor(log2(x.n)) as int))"
    return F.expr(f"""case when t rlike {_quoted(TOKEN)} then
        transform({_tested()}, x -> named_struct('start', x.start, 'stop', x.stop,
                  'stratum', {stratum}, 'level', {level}))
        else cast(array() as array<struct<start: int, stop: int, stratum: string, level: int>>) end""")


def rejection_levels(rows: DataFrame, rate: float = RATE) -> dict[str, int]:
    """For each stratum, the lowest level whose tokens are found not to be random.

    A few numbers for each of at most ``encodings x 31`` strata reach the driver.
    """
    levels = (rows.select(F.explode("tokens").alias("token")).select("token.stratum", "token.level")
              .groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n")))
    stratum = Window.partitionBy("stratum")
    found = (levels.withColumn("so_far", F.sum("n").over(stratum.orderBy(F.desc("level"))))
             .withColumn("total", F.sum("n").over(stratum))
             .where(F.pow(F.lit(10.0), -F.col("level") / F.lit(float(STEPS)))
                    <= F.lit(rate) * F.col("so_far") / F.col("total"))
             .groupBy("stratum").agg(F.min("level").alias("level")))
    return {r.stratum: r.level for r in found.collect()}


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, "random")) + ")"
    return f"""array_join(transform({spans}, s ->
        concat({names}[s.kind], ':', s.start, ':', s.stop)), ',')"""


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """Spans of secrets in every text: key, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``,
    ``spans``.

    One row for every input row, repeated rows and NULL keys included; other columns are not read.
    Positions count characters; NULL and empty texts have no spans. Tokens that the tests take for
    keys are added as kind ``random`` where they touch no base span.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("k", base_spans().alias("base"), tested_tokens().alias("tokens"))
    rows = materialise(rows, "tokens")
    levels = rejection_levels(rows, rate)
    rejected = " or ".join(f"(x.stratum = '{s}' and x.level >= {v})"
                           for s, v in sorted(levels.items())) or "false"
    added = f"""transform(filter(tokens, x -> not ({rejected})
        and not exists(base, b -> b.start < x.stop and x.start < b.stop)),
        x -> named_struct('start', x.start, 'kind', {len(KINDS)}, 'stop', x.stop))"""
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{name}")
             for i, name in enumerate(KINDS)]
    return rows.select(F.col("k").alias(key), *count,
                       F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"),
                       F.expr(_joined(f"array_sort(concat(base, {added}))")).alias("spans"))
