"""Scalar and aggregate functions of the dialect as Spark SQL text.

Only names whose meaning differs from Spark's function of that name are listed; all others pass through.
Every expansion is built of built-in expressions, so it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from tessella.errors import SemanticError

Args = list[str]


def floor_mod(a: str, b: str) -> str:
    """Remainder with the divisor's sign; an error for a zero divisor."""
    return f"((({a}) % ({b}) + ({b})) % ({b}))"


def float_div(a: str, b: str) -> str:
    """Double division; a zero divisor gives an infinity of the numerator's sign, plus for zero itself."""
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return f"(CASE WHEN {y} = 0 AND {x} IS NOT NULL THEN IF({x} >= 0, DOUBLE('Infinity'), DOUBLE('-Infinity')) ELSE try_divide({x}, {y}) END)"


def int_div(a: str, b: str, narrow: bool) -> str:
    """Integer division towards zero; an error for a zero divisor."""
    return f"CAST(({a}) div ({b}) AS INT)" if narrow else f"(({a}) div ({b}))"


def pad(side: str) -> Callable[[Args], str]:
    def made(a: Args) -> str:
        fill = f"left({a[2]}, 1)" if len(a) > 2 else "' '"
        return f"(CASE WHEN char_length({a[0]}) >= {a[1]} THEN {a[0]} ELSE {side}({a[0]}, {a[1]}, {fill}) END)"

    return made


def substring(a: Args) -> str:
    start = f"greatest(coalesce({a[1]}, 1), 1)"
    return f"substring({a[0]}, {start}" + (f", coalesce({a[2]}, 2147483647))" if len(a) > 2 else ")")


def rounded(a: Args) -> str:
    return f"CAST(bround(CAST({a[0]} AS DOUBLE), 0) AS BIGINT)" if len(a) == 1 else f"bround(CAST({a[0]} AS DOUBLE), {a[1]})"


DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy/MM/dd")
#: The longest first, so that no token eats another's letters.
DATE_TOKENS = (("YYYY", "yyyy"), ("DD", "dd"), ("MI", "mm"), ("SS", "ss"))
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "on", "1", "y"), ("false", "f", "no", "off", "0", "n")


def to_date(text: str) -> str:
    # A date's text is ISO, so dates pass as well as texts.
    tries = ", ".join(f"CAST(try_to_timestamp(CAST({text} AS STRING), '{f}') AS DATE)" for f in DATE_FORMATS)
    return f"coalesce({tries}, try_cast(CAST({text} AS STRING) AS DATE))"


def date_format(a: Args) -> str:
    pattern = a[1]
    for old, new in DATE_TOKENS:
        pattern = pattern.replace(old, new)
    return f"date_format({a[0]}, {pattern})"


def cast_to(text: str, kind: str) -> str:
    """CAST of the dialect: what can't be converted becomes null."""
    if kind == "boolean":
        low = f"lower(trim(CAST({text} AS STRING)))"
        words = lambda ws: ", ".join(f"'{w}'" for w in ws)
        return f"(CASE WHEN {low} IN ({words(TRUE_WORDS)}) THEN true WHEN {low} IN ({words(FALSE_WORDS)}) THEN false ELSE try_cast(CAST({text} AS STRING) AS DOUBLE) != 0 END)"
    return to_date(text) if kind == "date" else f"try_cast({text} AS {kind})"


def typeof(a: Args) -> str:
    pairs = ("int", "INT"), ("bigint", "BIGINT"), ("double", "DOUBLE"), ("float", "FLOAT"), ("boolean", "BOOLEAN"), ("string", "VARCHAR"), ("date", "DATE"), ("timestamp_ntz", "TIMESTAMP"), ("timestamp", "TIMESTAMP"), ("void", "NULL")
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs)
    return f"(CASE WHEN ({a[0]}) IS NULL THEN 'NULL' ELSE (CASE typeof({a[0]}) {cases} ELSE upper(typeof({a[0]})) END) END)"


def cosine(a: Args) -> str:
    """Over the shorter length; 0 if either is all zero."""
    x, y = (f"slice({v}, 1, least(size({a[0]}), size({a[1]})))" for v in a)
    total = lambda e: f"aggregate({e}, 0D, (s, v) -> s + v)"
    dot, p, q = total(f"zip_with({x}, {y}, (u, w) -> CAST(u AS DOUBLE) * w)"), total(f"transform({x}, u -> CAST(u AS DOUBLE) * u)"), total(f"transform({y}, u -> CAST(u AS DOUBLE) * u)")
    return f"(CASE WHEN {p} = 0 OR {q} = 0 THEN 0D ELSE {dot} / (sqrt({p}) * sqrt({q})) END)"


def jaccard(a: Args) -> str:
    return f"(CASE WHEN size(array_union({a[0]}, {a[1]})) = 0 THEN 1D ELSE size(array_intersect({a[0]}, {a[1]})) / CAST(size(array_union({a[0]}, {a[1]})) AS DOUBLE) END)"


def tokens(text: str) -> str:
    return f"filter(split(lower({text}), '\\\\s+'), w -> w != '')"


def once(value: str, name: str, body: str) -> str:
    """``body`` over ``name``, which stands for ``value``: bound as a lambda's argument it is computed once, not for each element inside."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def simhash(text: str) -> str:
    """64-bit SimHash: each bit is the sign of the sum of the tokens' bits."""
    bit = "aggregate(hs, 0, (s, h) -> s + IF(getbit(h, i) = 1, 1, -1)) > 0"
    bits = f"aggregate(transform(sequence(0, 63), i -> IF({bit}, shiftleft(1L, i), 0L)), 0L, (s, v) -> s | v)"
    return once(f"transform({tokens(text)}, w -> xxhash64(w))", "hs", bits)


def minhash_jaccard(a: Args) -> str:
    side = lambda t: once(tokens(t), "ws", "transform(sequence(1, 64), k -> array_min(transform(ws, w -> xxhash64(k, w))))")
    return f"(size(filter(zip_with({side(a[0])}, {side(a[1])}, (p, q) -> p <=> q), e -> e)) / 64D)"


def sorted_mode(a: Args) -> str:
    """Ties go to the smallest value, so that results don't depend on row order."""
    return f"mode() WITHIN GROUP (ORDER BY {a[0]})"


def part(a: Args) -> str:
    return f"CAST(date_part({a[0]}, {a[1]}) AS INT)"


def split(a: Args) -> str:
    return f"split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))"


FUNCTIONS: dict[str, Callable[[Args], str]] = {
    # strings
    "LENGTH": lambda a: f"char_length({a[0]})",
    "TRIM": lambda a: f"regexp_replace({a[0]}, '^\\\\s+|\\\\s+$', '')",
    "LTRIM": lambda a: f"regexp_replace({a[0]}, '^\\\\s+', '')",
    "RTRIM": lambda a: f"regexp_replace({a[0]}, '\\\\s+$', '')",
    "INITCAP": lambda a: f"array_join(transform(regexp_extract_all({a[0]}, '([\\\\p{{L}}]+|[^\\\\p{{L}}]+)', 1), w -> concat(upper(left(w, 1)), lower(substring(w, 2)))), '')",
    "SUBSTR": substring,
    "SUBSTRING": substring,
    "CONCAT": lambda a: f"concat_ws('', {', '.join(a)})",
    "POSITION": lambda a: f"locate({a[0]}, {a[1]})",
    "LPAD": pad("lpad"),
    "RPAD": pad("rpad"),
    "STARTS_WITH": lambda a: f"startswith({a[0]}, {a[1]})",
    "ENDS_WITH": lambda a: f"endswith({a[0]}, {a[1]})",
    "CHR": lambda a: f"decode(unhex(lpad(hex({a[0]}), 8, '0')), 'UTF-32')",
    "SPLIT": split,
    "REGEXP_MATCH": lambda a: f"regexp_like({a[0]}, {a[1]})",
    "REGEXP_EXTRACT": lambda a: f"regexp_extract({a[0]}, {a[1]}, 0)",
    "REGEXP_REPLACE": lambda a: f"regexp_replace({a[0]}, {a[1]}, regexp_replace({a[2]}, '\\\\\\\\(\\\\d)', '\\\\$$1'))",
    # numbers
    "ROUND": rounded,
    "TRUNC": lambda a: f"CAST({a[0]} AS BIGINT)",
    "TRUNCATE": lambda a: f"CAST({a[0]} AS BIGINT)",
    "MOD": lambda a: f"(CASE WHEN ({a[1]}) = 0 THEN NULL ELSE try_mod(try_mod({a[0]}, {a[1]}) + ({a[1]}), {a[1]}) END)",
    "SIGN": lambda a: f"CAST(sign({a[0]}) AS INT)",
    "RANDOM": lambda a: "rand()",
    "WIDTH_BUCKET": lambda a: f"(CASE WHEN {' AND '.join(f'({x}) IS NOT NULL' for x in a)} THEN coalesce(width_bucket({', '.join(a)}), 0) END)",
    "BIT_COUNT": lambda a: f"bit_count(abs(CAST({a[0]} AS BIGINT)))",
    "GREATEST": lambda a: f"greatest({', '.join(a)})" if len(a) > 1 else a[0],
    "LEAST": lambda a: f"least({', '.join(a)})" if len(a) > 1 else a[0],
    # conditions
    "TYPEOF": typeof,
    "HASH": lambda a: f"xxhash64({a[0]})",
    "MURMUR_HASH": lambda a: f"xxhash64({a[0]})",
    "ENCODE": lambda a: f"encode({a[0]}, {a[1] if len(a) > 1 else repr('UTF-8')})",
    "DECODE": lambda a: f"decode({a[0]}, {a[1] if len(a) > 1 else repr('UTF-8')})",
    # dates
    "DAY_OF_WEEK": lambda a: f"(weekday({a[0]}) + 1)",
    "DAY_OF_YEAR": lambda a: f"dayofyear({a[0]})",
    "WEEK_OF_YEAR": lambda a: f"weekofyear({a[0]})",
    "EXTRACT": part,
    "EPOCH": lambda a: f"(CASE typeof({a[0]}) WHEN 'date' THEN CAST(unix_date(CAST({a[0]} AS DATE)) AS BIGINT) ELSE unix_micros(CAST({a[0]} AS TIMESTAMP)) END)",
    "DATE_DIFF": lambda a: f"datediff({a[0]}, {a[1]})",
    "DATE_TRUNC": lambda a: f"CAST(date_trunc({a[0]}, {a[1]}) AS TIMESTAMP_NTZ)",  # of a DATE: see the translator
    "DATE_FORMAT": date_format,
    "TO_DATE": lambda a: to_date(a[0]),
    "TO_TIMESTAMP": lambda a: f"CAST(try_to_timestamp(CAST({a[0]} AS STRING)) AS TIMESTAMP_NTZ)",
    # arrays
    "ARRAY_CREATE": lambda a: f"array({', '.join(a)})",
    "ARRAY_LENGTH": lambda a: f"size({a[0]})",
    "ARRAY_POSITION": lambda a: f"CAST(array_position({a[0]}, {a[1]}) AS INT)",
    "ARRAY_SLICE": lambda a: f"slice({a[0]}, greatest({a[1]}, 1), greatest({a[2]} - greatest({a[1]}, 1) + 1, 0))",
    "ARRAY_CONCAT": lambda a: f"concat({', '.join(a)})",
    "ARRAY_REVERSE": lambda a: f"reverse({a[0]})",
    "ARRAY_FLATTEN": lambda a: f"flatten({a[0]})",
    "ARRAY_INTERSECT": lambda a: f"filter({a[0]}, x -> array_contains({a[1]}, x))",
    "ARRAY_EXCEPT": lambda a: f"filter({a[0]}, x -> NOT array_contains({a[1]}, x))",
    "UNNEST": lambda a: f"explode({a[0]})",
    "GENERATE_SERIES": lambda a: f"sequence({', '.join(a)})",
    # similarity
    "JACCARD_SIMILARITY": jaccard,
    "COSINE_SIMILARITY": cosine,
    "SIMHASH_SIMILARITY": lambda a: f"(1D - bit_count({simhash(a[0])} ^ {simhash(a[1])}) / 64D)",
    "MINHASH_JACCARD": minhash_jaccard,
    # aggregates
    "COUNT_DISTINCT": lambda a: f"count(DISTINCT {a[0]})",
    "SUM_DISTINCT": lambda a: f"sum(DISTINCT {a[0]})",
    "AVG_DISTINCT": lambda a: f"avg(DISTINCT {a[0]})",
    "STDDEV": lambda a: f"stddev_samp({a[0]})",
    "VARIANCE": lambda a: f"var_samp({a[0]})",
    "PERCENTILE_CONT": lambda a: f"percentile({a[0]}, {a[1] if len(a) > 1 else 0.5})",
    "PERCENTILE_DISC": lambda a: f"percentile_disc({a[1] if len(a) > 1 else 0.5}) WITHIN GROUP (ORDER BY {a[0]})",
    "MODE": sorted_mode,
    "APPROX_COUNT_DISTINCT": lambda a: f"approx_count_distinct({a[0]}, 0.023)",
    "APPROX_PERCENTILE": lambda a: f"percentile_approx({a[0]}, {a[1] if len(a) > 1 else 0.5}, 10000)",
    "APPROX_TOP_K": lambda a: f"transform(approx_top_k({a[0]}, {a[1] if len(a) > 1 else 10}) FILTER (WHERE {a[0]} IS NOT NULL), x -> x.item)",
    "ARRAY_AGG": lambda a: f"nullif(collect_list({a[0]}), array())",
    "STRING_AGG": lambda a: f"listagg(CAST({a[0]} AS STRING), {a[1] if len(a) > 1 else repr(',')})",
    "GROUPING": lambda a: "0",
}


def expand(name: str, args: Args) -> str:
    """A call of the dialect as Spark SQL text."""
    made = FUNCTIONS.get(name.upper())
    if made is None:
        return f"{name}({', '.join(args)})"
    try:
        return made(args)
    except IndexError:
        raise SemanticError(f"{name} is given too few arguments") from None
