"""Scalar function queries: one for each function of the dialect, in groups by table."""

from __future__ import annotations

from tessella.plans.registry import Registry

QUERIES = Registry()


def each(prefix: str, key: str, source: str, cases: dict[str, tuple[str, str] | str]) -> None:
    """A query for each case: (expression of the dialect, DuckDB's), or one text for both."""
    for name, case in cases.items():
        mine, theirs = case if isinstance(case, tuple) else (case, case)
        QUERIES.sql(f"{prefix}_{name}", f"SELECT {key}, {mine} AS v FROM {source}", f"SELECT {key}, {theirs} AS v FROM {source}")


def blanked(text: str) -> str:
    return f"' ' || {text} || '  '"


each("str", "p_partkey", "part", {
    "upper": "upper(p_name)", "lower": "lower(p_brand)", "length": ("length(p_name)", "CAST(length(p_name) AS INT)"), "trim": (f"trim({blanked('p_name')})", "p_name"), "ltrim": (f"ltrim({blanked('p_name')})", "p_name || '  '"),
    "rtrim": (f"rtrim({blanked('p_name')})", "' ' || p_name"), "reverse": "reverse(p_name)", "replace": "replace(p_name, 'a', '_')", "substr": "substr(p_name, 3, 4)", "substr_clamped": ("substr(p_name, -2, 4)", "substr(p_name, 1, 4)"),
    "initcap": ("initcap('o''neil ab-cd 3x')", "'O''Neil Ab-Cd 3X'"), "concat_nulls": "concat(p_name, NULL, p_brand)", "concat_ws": "concat_ws('/', p_name, NULL, p_brand)", "position": ("position('a', p_name)", "CAST(strpos(p_name, 'a') AS INT)"),
    "left": "left(p_name, 3)", "right": "right(p_name, 3)", "repeat": "repeat(p_brand, 2)", "starts_with": "starts_with(p_name, 'p')", "ends_with": "ends_with(p_name, '1')", "contains": "contains(p_name, '2')",
    "lpad": ("lpad(p_brand, 12, '*-')", "CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '*') END"), "lpad_long": ("lpad(p_brand, 3, '*')", "p_brand"), "rpad": ("rpad(p_brand, 12, '.')", "rpad(p_brand, 12, '.')"),
    "ascii": ("ascii(p_name)", "CAST(ascii(p_name) AS INT)"), "chr": ("chr(8364)", "chr(8364)"), "split_part": "split_part(p_name, ' ', 2)", "split": ("array_join(split(p_name, ' '), '|')", "array_to_string(string_split(p_name, ' '), '|')"),
    "regexp_replace": ("regexp_replace(p_name, '([a-z])([0-9])', '\\2\\1')", "regexp_replace(p_name, '([a-z])([0-9])', '\\2\\1', 'g')"), "regexp_match": ("regexp_match(p_name, '[0-9]{2}')", "regexp_matches(p_name, '[0-9]{2}')"), "regexp_extract": ("regexp_extract(p_name, '[0-9]+')", "regexp_extract(p_name, '[0-9]+')"),
    "like_backslash": ("'a\\b' LIKE 'a\\_'", "'a\\b' LIKE 'a\\_'"),
})
each("math", "p_partkey", "part", {
    "abs": "abs(p_size - 25)", "ceil": ("ceil(p_retailprice)", "CAST(ceil(p_retailprice) AS BIGINT)"), "floor": ("floor(p_retailprice)", "CAST(floor(p_retailprice) AS BIGINT)"), "round_even": ("round(p_size / 2.0)", "CAST(round_even(p_size / 2.0, 0) AS BIGINT)"),
    "round_digits": ("round(p_retailprice, 1)", "round_even(p_retailprice, 1)"), "trunc": ("trunc(0 - p_retailprice)", "CAST(trunc(0 - p_retailprice) AS BIGINT)"), "power": "power(p_size, 2)", "sqrt": "round(sqrt(p_size), 8)", "cbrt": "round(cbrt(p_size), 8)",
    "mod": ("mod(p_size - 25, 7)", "(((p_size - 25) % 7) + 7) % 7"), "mod_zero": ("mod(p_size, 0)", "CAST(NULL AS INT)"), "sign": ("sign(p_size - 25)", "CAST(sign(p_size - 25) AS INT)"), "ln": "round(ln(p_size), 8)", "log2": "round(log2(p_size), 8)", "log10": "round(log10(p_size), 8)",
    "log_base": ("round(log(3, p_size), 8)", "round(ln(p_size) / ln(3), 8)"), "exp": "round(exp(p_size / 50.0), 8)", "greatest": "greatest(p_size, NULL, 20)", "least": "least(p_size, NULL, 20)", "random": ("random() BETWEEN 0 AND 1", "true"),
    "width_bucket": ("width_bucket(p_size, 10, 40, 3)", "CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 4 ELSE (p_size - 10) // 10 + 1 END AS BIGINT)"), "bit_count": ("bit_count(p_size - 25)", "CAST(bit_count(abs(p_size - 25)) AS INT)"),
    "int_div_trunc": ("(p_size - 25) / 7", "(p_size - 25) // 7"), "floor_mod": ("(p_size - 25) % 7", "(((p_size - 25) % 7) + 7) % 7"), "floor_mod_negative": ("(p_size - 25) % -7", "(((p_size - 25) % -7) - 7) % -7"), "float_div": ("p_retailprice / 3", "p_retailprice / 3"),
    "float_div_zero": ("CASE WHEN p_retailprice / 0.0 > 1000000 THEN 'inf' ELSE 'other' END", "'inf'"), "bool_arith": ("TRUE + p_size", "1 + p_size"), "int_promotion": ("p_size + 3000000000", "p_size + 3000000000"), "unary": "-p_size + +1", "precedence": ("'s' || p_size + 1", "'s' || (p_size + 1)"),
})
each("cond", "p_partkey", "part", {
    "if": ("if(p_size > 20, 'big', 'small')", "CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END"), "if_null": ("if(nullif(p_size, 1) > 20, 1, 0)", "CASE WHEN nullif(p_size, 1) > 20 THEN 1 ELSE 0 END"), "coalesce": "coalesce(nullif(p_size, 1), 99)", "nullif": "nullif(p_brand, 'Brand#11')",
    "typeof": ("concat_ws(',', typeof(p_size), typeof(p_name), typeof(p_retailprice), typeof(NULL))", "'INT,VARCHAR,DOUBLE,NULL'"), "try_cast": ("try_cast(right(p_name, 2), 'INT')", "TRY_CAST(right(p_name, 2) AS INT)"), "hash": ("hash(p_name) = hash(p_name)", "true"),
    "murmur_hash": ("murmur_hash(p_name) = hash(p_name)", "true"), "encode_decode": ("decode(encode(p_name))", "p_name"), "cast_bool": ("CAST('on' AS BOOLEAN)", "true"), "cast_formats": ("CAST('31.12.2024' AS DATE)", "DATE '2024-12-31'"), "number_as_truth": ("CASE WHEN p_size - 1 THEN 'y' ELSE 'n' END", "CASE WHEN p_size - 1 <> 0 THEN 'y' ELSE 'n' END"),
})
D, DD = "CAST(o_orderdate AS DATE)", "CAST(o_orderdate AS DATE)"
each("date", "o_orderkey", "orders", {
    **{p: (f"{p}(o_orderdate)", f"CAST({p}(o_orderdate) AS INT)") for p in ("year", "month", "day", "hour", "minute", "quarter")}, "second": ("second(o_orderdate)", "CAST(second(o_orderdate) AS INT)"),
    "day_of_week": ("day_of_week(o_orderdate)", "CAST(isodow(o_orderdate) AS INT)"), "day_of_year": ("day_of_year(o_orderdate)", "CAST(dayofyear(o_orderdate) AS INT)"), "week_of_year": ("week_of_year(o_orderdate)", "CAST(week(o_orderdate) AS INT)"),
    "extract": ("extract('MONTH', o_orderdate)", "CAST(month(o_orderdate) AS INT)"), "epoch_date": (f"epoch({D})", f"CAST({DD} - DATE '1970-01-01' AS BIGINT)"), "epoch_ts": ("epoch(o_orderdate)", "epoch_us(o_orderdate)"), "date_add": (f"date_add({D}, 10)", f"CAST({DD} + 10 AS DATE)"), "date_sub": (f"date_sub({D}, 10)", f"CAST({DD} - 10 AS DATE)"),
    "date_diff": (f"date_diff({D}, to_date('1995-01-01'))", f"CAST({DD} - DATE '1995-01-01' AS INT)"), "date_trunc_month": ("date_trunc('MONTH', o_orderdate)", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)"), "date_format": ("date_format(o_orderdate, 'YYYY/MM/DD HH:MI')", "strftime(o_orderdate, '%Y/%m/%d %H:%M')"),
    "to_date": ("to_date('03/15/2024')", "DATE '2024-03-15'"), "to_timestamp": ("to_timestamp('2024-03-15 10:20:30')", "TIMESTAMP '2024-03-15 10:20:30'"), "to_date_bad": ("to_date('no date')", "CAST(NULL AS DATE)"), "plus_days": (f"to_date('2024-01-01') + 31", "DATE '2024-02-01'"),
    "minus_date": (f"to_date('2024-03-01') - to_date('2024-02-01')", "CAST(29 AS INT)"), "ts_minus_ts": ("o_orderdate - to_timestamp('1995-01-01 00:00:00')", "epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')"), "ts_plus_us": ("o_orderdate + 1000000", "o_orderdate + INTERVAL 1 SECOND"), "now": ("now() > to_timestamp('2020-01-01 00:00:00') AND current_date > to_date('2020-01-01')", "true"),
})
P, PP = "split(p_name, ' ')", "string_split(p_name, ' ')"
join = lambda mine, theirs: (f"array_join({mine}, ',')", f"array_to_string({theirs}, ',')")
each("arr", "p_partkey", "part", {
    "array": join("array(p_brand, p_type)", "[p_brand, p_type]"), "length": (f"array_length({P})", f"CAST(len({PP}) AS INT)"), "contains": (f"array_contains({P}, 'part')", f"list_contains({PP}, 'part')"), "position": (f"array_position({P}, 'zz')", f"CAST(coalesce(list_position({PP}, 'zz'), 0) AS INT)"),
    "slice": join(f"array_slice({P}, 1, 2)", f"{PP}[1:2]"), "append": join(f"array_append({P}, 'z')", f"list_append({PP}, 'z')"), "prepend": join(f"array_prepend({P}, 'z')", f"list_prepend('z', {PP})"), "remove": join(f"array_remove({P}, 'part')", f"list_filter({PP}, lambda x: x <> 'part')"),
    "concat": join(f"array_concat({P}, array(p_brand))", f"list_concat({PP}, [p_brand])"), "sort": join(f"array_sort({P})", f"list_sort({PP})"), "reverse": join(f"array_reverse({P})", f"list_reverse({PP})"), "distinct": (f"array_length(array_distinct(array_concat({P}, {P})))", f"CAST(len(list_distinct({PP})) AS INT)"),
    "flatten": join(f"array_flatten(array({P}, array('q')))", f"flatten([{PP}, ['q']])"), "intersect": join("array_intersect(array(1, 1, 2, 3), array(1, 3))", "[1, 1, 3]"), "union": join("array_union(array(1, 1, 2), array(3, 2))", "[1, 2, 3]"), "except": join("array_except(array(1, 1, 2, 2), array(1))", "[2, 2]"),
    "join": (f"array_join({P}, '+')", f"array_to_string({PP}, '+')"), "series": join("generate_series(1, 9, 4)", "[1, 5, 9]"), "create": join("array_create(1, 2)", "[1, 2]"),
})
each("sim", "p_partkey", "part", {
    "jaccard": (f"round(jaccard_similarity({P}, array('part', 'goods')), 6)", f"round(CAST(len(list_intersect({PP}, ['part', 'goods'])) AS DOUBLE) / len(list_distinct(list_concat({PP}, ['part', 'goods']))), 6)"), "jaccard_empty": ("jaccard_similarity(array_remove(array('a'), 'a'), array_remove(array('a'), 'a'))", "CAST(1 AS DOUBLE)"),
    "simhash_self": ("simhash_similarity(p_name, upper(p_name))", "CAST(1 AS DOUBLE)"), "minhash_self": ("minhash_jaccard(p_name, p_name)", "CAST(1 AS DOUBLE)"),
})
QUERIES.sql("sim_cosine", "SELECT vec_id, round(cosine_similarity(embedding, q), 6) AS v FROM embeddings CROSS JOIN (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) t", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS v FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)")
