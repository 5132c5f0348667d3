"""SQL fragments shared by the oracle statements (DuckDB dialect)."""

from __future__ import annotations

import math

from clauselake.functions import lexicons as lx

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def trim(expr: str) -> str:
    return f"trim({expr}, {BLANKS})"


def has(expr: str, terms: list[str]) -> str:
    return f"coalesce(regexp_matches({expr}, '{lx.any_of(terms)}'), false)"


def with_(*ctes: tuple[str, str], recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({q})" for n, q in ctes) + " "


_NUM = r"[0-9]+(?:\.[0-9]+)?"


def rate_digit(expr: str) -> str:
    arms = " ".join(
        f"WHEN '{ch}' THEN {v}"
        for ch, v in [("零", 0.0), ("一", 1.0), ("二", 2.0), ("两", 2.0), ("三", 3.0), ("四", 4.0), ("五", 5.0),
                      ("六", 6.0), ("七", 7.0), ("八", 8.0), ("九", 9.0), ("十", 10.0), ("半", 0.5)]
    )
    return f"CAST(CASE {expr} {arms} ELSE TRY_CAST({expr} AS DOUBLE) END AS DOUBLE)"


def stated_rate(t: str) -> str:
    ten, thousand = "万分之([0-9零一二三四五六七八九十半两])", "千分之([0-9零一二三四五六七八九十半两])"
    percent = rf"利率[^%]*?({_NUM})\s*%"
    return (
        f"CASE WHEN regexp_matches({t}, '{ten}') THEN {rate_digit(f'''regexp_extract({t}, '{ten}', 1)''')} / 10.0 "
        f"WHEN regexp_matches({t}, '{thousand}') THEN {rate_digit(f'''regexp_extract({t}, '{thousand}', 1)''')} "
        f"WHEN regexp_matches({t}, '{percent}') THEN CAST(regexp_extract({t}, '{percent}', 1) AS DOUBLE) * 10.0 END"
    )


def _amounts(source: str, key: str, text: str, pattern: str, order: int, unit: bool) -> str:
    """Rows (key, priority, pos, value) of every amount with its context class."""
    ctx = (
        "substring(t, greatest(st - 15, 0) + 1, st + length(hit) + 15 - greatest(st - 15, 0))"
    )
    scale = "CASE WHEN ends_with(hit, '亿') THEN 1e8 ELSE 1e4 END" if unit else "1e0"
    return (
        f"SELECT {key}, CASE WHEN {has(ctx, lx.EXCLUDED_CONTEXT)} THEN 2 WHEN {has(ctx, lx.PRINCIPAL_CONTEXT)} THEN 0 "
        f"ELSE 1 END AS priority, i + {order} AS pos, CAST(regexp_extract(hit, '^({_NUM})', 1) AS DOUBLE) * {scale} AS v "
        f"FROM (SELECT {key}, t, i, hit, CAST(st0 AS BIGINT) AS st FROM (SELECT {key}, t, i, hits[i] AS hit, "
        "coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) "
        "+ list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS st0 "
        f"FROM (SELECT {key}, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS i "
        f"FROM (SELECT {key}, {text} AS t, regexp_extract_all({text}, '{pattern}') AS hits, "
        f"string_split_regex({text}, '{pattern}') AS gaps FROM {source}))))"
    )


def params_ctes(source: str, key: str, text: str = "text") -> list[tuple[str, str]]:
    """CTEs ending in ``params(key, text, principal, rate_per_mille, rate_specified, days, force_majeure, penalty_context)``."""
    t = text
    days = (
        f"CAST(CASE WHEN {has(t, lx.NOT_OVERDUE)} THEN 0 "
        rf"WHEN regexp_matches({t}, '([0-9]+)\s*天') THEN CAST(regexp_extract({t}, '([0-9]+)\s*天', 1) AS INT) "
        f"WHEN contains({t}, '半年') THEN 180 WHEN contains({t}, '一个半月') THEN 45 WHEN contains({t}, '两个月') THEN 60 "
        rf"WHEN regexp_matches({t}, '([0-9]+)\s*个?月') THEN CAST(regexp_extract({t}, '([0-9]+)\s*个?月', 1) AS INT) * 30 "
        rf"WHEN regexp_matches({t}, '([0-9]+)\s*年') THEN CAST(regexp_extract({t}, '([0-9]+)\s*年', 1) AS INT) * 365 END AS INT)"
    )
    fallback = rf"TRY_CAST(regexp_extract({t}, '本金\s*(?:是\s*)?({_NUM})', 1) AS DOUBLE)"
    amounts = " UNION ALL ".join(
        [
            _amounts(source, key, t, rf"{_NUM}\s*(?:万|亿)", 0, True),
            _amounts(source, key, t, rf"{_NUM}\s*元", 1_000_000, False),
        ]
    )
    return [
        ("amounts", amounts),
        ("chosen", f"SELECT {key}, arg_min(v, priority * 10000000 + pos) AS v FROM amounts GROUP BY {key}"),
        (
            "params",
            f"SELECT {key}, {t}, coalesce(v, {fallback}) AS principal, "
            f"coalesce({stated_rate(t)}, CASE WHEN {has(t, lx.PENALTY_CONTEXT)} THEN 0.5 END) AS rate_per_mille, "
            f"({stated_rate(t)}) IS NOT NULL AS rate_specified, {days} AS days, "
            f"coalesce(contains({t}, '不可抗力'), false) AS force_majeure, {has(t, lx.PENALTY_CONTEXT)} AS penalty_context "
            f"FROM {source} LEFT JOIN chosen USING ({key})",
        ),
    ]


def cents_half_up(expr: str) -> str:
    cents, high = "(abs(x) * 100.0::DOUBLE)", "(abs(x) * 134217729.0::DOUBLE - (abs(x) * 134217729.0::DOUBLE - abs(x)))"
    error = f"(({high} * 100.0::DOUBLE - {cents}) + (abs(x) - {high}) * 100.0::DOUBLE)"
    part = f"({cents} - floor({cents}))"
    up = f"CASE WHEN {part} > 0.5 OR ({part} = 0.5 AND {error} >= 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    exact = f"(floor({cents}) + {up}) / 100.0::DOUBLE * CASE WHEN x < 0 THEN -1 ELSE 1 END"
    return f"list_transform([CAST({expr} AS DOUBLE)], lambda x: CASE WHEN abs(x) < 1e13 THEN {exact} WHEN abs(x) < 'inf'::DOUBLE THEN x END)[1]"


def cents_nearest(expr: str) -> str:
    return (
        f"list_transform([CAST({expr} AS DOUBLE)], lambda x: CASE WHEN abs(x) < 1e13 THEN floor(x * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE "
        "WHEN abs(x) < 'inf'::DOUBLE THEN x END)[1]"
    )


def java_double(expr: str) -> str:
    """A double as text the way the JVM prints it: plain up to 10^7, with an exponent from there on."""
    v = "CAST(x AS VARCHAR)"
    whole, rest = f"split_part({v}, '.', 1)", f"split_part({v}, '.', 2)"
    digits = f"({whole} || CASE WHEN {rest} = '0' THEN '' ELSE {rest} END)"
    tail = f"coalesce(nullif(rtrim(substring({digits}, 2), '0'), ''), '0')"
    large = f"substring({digits}, 1, 1) || '.' || {tail} || 'E' || (length({whole}) - 1)"
    huge = f"CASE WHEN contains({v}, '.') THEN regexp_replace({v}, 'e\\+?', 'E') ELSE regexp_replace({v}, 'e\\+?', '.0E') END"
    return f"list_transform([CAST({expr} AS DOUBLE)], lambda x: CASE WHEN contains({v}, 'e') THEN {huge} WHEN x >= 1e7 THEN {large} ELSE {v} END)[1]"


def normalized_rate(rate: str, text: str) -> str:
    return (
        f"(CASE WHEN {rate} <= 1.0 THEN {rate} ELSE coalesce({stated_rate(text)}, "
        f"CASE WHEN {rate} < 10.0 THEN {rate} / 10.0 ELSE {rate} END) END)"
    )


def penalty(p: str, r: str, d: str, t: str) -> str:
    return f"CASE WHEN {p} >= 0 AND {d} >= 0 THEN {cents_half_up(f'{p} * ({normalized_rate(r, t)} / 1000.0) * {d}')} END"


def interest(p: str, r: str, d: str) -> str:
    annual = f"CASE WHEN {r} IS NOT NULL THEN least({r} / 1000.0 * 365.0, 0.138) END"
    return f"CASE WHEN {p} >= 0 AND {d} >= 0 THEN {cents_nearest(f'{p} * ({annual}) * ({d} / 365.0::DOUBLE)')} END"


def explicit_type(t: str) -> str:
    return (
        f"CASE WHEN {has(t, lx.LOAN_WORDS)} THEN 'LOAN_INTEREST' WHEN {has(t, lx.REWRITE_CUES)} THEN NULL "
        "ELSE 'PENALTY' END"
    )


def amount(calc_type: str, p: str, r: str, d: str, majeure: str, t: str) -> str:
    return (
        f"CASE WHEN {majeure} THEN 0.0::DOUBLE WHEN {calc_type} = 'LOAN_INTEREST' THEN {interest(p, r, d)} "
        f"ELSE {penalty(p, r, d, t)} END"
    )


def bootstrap_ctes(cases: str, rates: dict[str, tuple[str, str]], replicates: int = 200) -> list[tuple[str, str]]:
    """CTEs ending in ``intervals(metric, value, lower, upper)``; ``cases`` has ``case_id`` and the columns of the rates."""
    total, bounds = 0.0, []
    for k in range(10):
        total += math.exp(-1) / math.factorial(k)
        bounds.append(round(4294967296 * total))
    weight = " + ".join(f"CAST(u >= {b} AS INT)" for b in bounds)
    return [
        ("draws", f"SELECT *, CASE WHEN b = 0 THEN 1 ELSE {weight} END AS wt FROM (SELECT *, CAST('0x' || substr(md5(case_id || '#' || b), 1, 8) AS BIGINT) AS u FROM {cases}, (SELECT unnest(range(0, {replicates + 1})) AS b))"),
        ("again", " UNION ALL ".join(f"SELECT '{m}' AS metric, b, CASE WHEN sum(wt * {d}) > 0 THEN sum(wt * {n}) / sum(wt * {d}) END AS rate FROM draws GROUP BY b" for m, (n, d) in rates.items())),
        ("intervals", "SELECT metric, round(max(rate) FILTER (b = 0), 6) AS value, round(quantile_cont(rate, 0.025) FILTER (b > 0), 6) AS lower, round(quantile_cont(rate, 0.975) FILTER (b > 0), 6) AS upper FROM again GROUP BY metric"),
    ]


# ---- retrieval -------------------------------------------------------------
def bm25_ctes(queries: str, chunks: str, k: int, prefix: str = "") -> list[tuple[str, str]]:
    """CTEs ending in ``{prefix}bm25(query_id, chunk_id, score, rank)``."""

    def tokens(text: str) -> str:
        spaced = rf"regexp_replace(lower({text}), '(\p{{Han}})', ' \1 ', 'g')"
        return rf"regexp_extract_all({spaced}, '[\p{{L}}\p{{N}}]+')"

    x = prefix
    return [
        (f"{x}qt", f"SELECT query_id, kb_id, term, count(*) AS w FROM (SELECT query_id, kb_id, unnest({tokens('text')}) AS term FROM {queries}) GROUP BY ALL"),
        (f"{x}tk", f"SELECT chunk_id, kb_id, {tokens('content')} AS toks FROM {chunks}"),
        (f"{x}corp", f"SELECT count(*) FILTER (len(toks) > 0) AS n, avg(len(toks)) FILTER (len(toks) > 0) AS avg_dl FROM {x}tk"),
        (f"{x}po", f"SELECT chunk_id, kb_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, kb_id, len(toks) AS dl, unnest(toks) AS term FROM {x}tk) WHERE term IN (SELECT term FROM {x}qt) GROUP BY ALL"),
        (f"{x}dfq", f"SELECT term, count(*) AS df FROM {x}po GROUP BY term"),
        (
            f"{x}sc",
            "SELECT query_id, chunk_id, round(sum(w * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS score "
            f"FROM {x}po JOIN {x}qt USING (term, kb_id) JOIN {x}dfq USING (term), {x}corp GROUP BY query_id, chunk_id",
        ),
        (
            f"{x}bm25",
            "SELECT query_id, chunk_id, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM {x}sc) WHERE rn <= {k}",
        ),
    ]


def knn_ctes(queries: str, chunks: str, k: int, prefix: str = "") -> list[tuple[str, str]]:
    x = prefix
    cos = "list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[]))"
    return [
        (
            f"{x}kn",
            f"SELECT query_id, chunk_id, round((1.0::DOUBLE + {cos}) / 2.0, 6) AS score FROM {queries} q JOIN {chunks} c "
            "ON q.kb_id = c.kb_id WHERE q.vector IS NOT NULL AND c.vector IS NOT NULL",
        ),
        (
            f"{x}knn",
            "SELECT query_id, chunk_id, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM {x}kn) WHERE rn <= {k}",
        ),
    ]


def fuse_ctes(chunks: str, k: int, prefix: str = "") -> list[tuple[str, str]]:
    """CTEs ending in ``{prefix}fused(query_id, clause_id, chunk_id, score, rank, knn_rank, bm25_rank)``."""
    x = prefix
    return [
        (
            f"{x}en",
            f"SELECT query_id, chunk_id, 0 AS src, rank, 1.0::DOUBLE / (10 + rank) AS share FROM {x}knn UNION ALL "
            f"SELECT query_id, chunk_id, 1, rank, 0.3::DOUBLE / (10 + rank) FROM {x}bm25",
        ),
        (
            f"{x}fu",
            "SELECT query_id, coalesce(canonical_id, chunk_id) AS clause_id, arg_min(chunk_id, src * 1000000 + rank) AS chunk_id, "
            "round(sum(share), 6) AS score, min(rank) FILTER (src = 0) AS knn_rank, min(rank) FILTER (src = 1) AS bm25_rank "
            f"FROM {x}en JOIN {chunks} USING (chunk_id) GROUP BY 1, 2",
        ),
        (
            f"{x}fused",
            "SELECT query_id, clause_id, chunk_id, score, CAST(rn AS INT) AS rank, knn_rank, bm25_rank FROM (SELECT *, row_number() OVER "
            "(PARTITION BY query_id ORDER BY score DESC, coalesce(knn_rank, 1000000000), coalesce(bm25_rank, 1000000000), clause_id) AS rn "
            f"FROM {x}fu) WHERE rn <= {k}",
        ),
    ]


def hybrid_ctes(queries: str, chunks: str, k: int, prefix: str = "") -> list[tuple[str, str]]:
    return [
        *bm25_ctes(queries, chunks, k, prefix),
        *knn_ctes(queries, chunks, k, prefix),
        *fuse_ctes(chunks, k, prefix),
    ]


# ---- clause splitting ------------------------------------------------------
def clause_number(e: str) -> str:
    """Clause ordinal up to 千 from well-formed numerals, by place."""
    digit = "[一二三四五六七八九]"

    def place(unit: str) -> str:
        d = rf"regexp_extract({e}, '({digit}?){unit}', 1)"
        return f"CASE WHEN contains({e}, '{unit}') THEN greatest(strpos('一二三四五六七八九', nullif({d}, '')), 1) ELSE 0 END"

    ones = rf"coalesce(strpos('一二三四五六七八九', nullif(regexp_extract({e}, '({digit})$', 1), '')), 0)"
    thousand, hundred, ten = place("千"), place("百"), place("十")
    return (
        f"CASE WHEN regexp_matches({e}, '^[0-9]+$') THEN CAST({e} AS INT) ELSE "
        f"CAST(coalesce({thousand}, 1000) * 1000 + coalesce({hundred}, 1) * 100 + coalesce({ten}, 1) * 10 + {ones} AS INT) END"
    )


def split_ctes(source: str, key: str) -> list[tuple[str, str]]:
    """CTEs ending in ``blocks(key, pos, canonical_id, sub_index, content)``; ``source`` has ``label, text``."""
    head = rf"第\s*[{lx.CLAUSE_DIGITS}]+\s*条"
    mark = rf"({head})([{lx.HEADING_BOUNDARY}\s]|$)"
    number = clause_number(rf"regexp_extract(piece, '^第\s*([{lx.CLAUSE_DIGITS}]+)\s*条', 1)")
    return [
        ("sp_docs", f"SELECT {key}, label, text, string_split(regexp_replace(text, '{mark}', chr(1) || '\\1\\2', 'g'), chr(1)) AS ps FROM {source} WHERE {trim('text')} <> ''"),
        ("sp_pieces", f"SELECT {key}, label, i, piece, CASE WHEN i > 1 THEN {number} END AS no FROM (SELECT {key}, label, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece FROM sp_docs)"),
        (
            "sp_fold",
            f"SELECT {key}, 1::BIGINT AS i, -100 AS last, false AS take FROM sp_docs UNION ALL "
            f"SELECT p.{key}, p.i, CASE WHEN f.last >= 0 AND p.no - f.last > 3 THEN f.last ELSE p.no END, "
            f"NOT (f.last >= 0 AND p.no - f.last > 3) FROM sp_fold f JOIN sp_pieces p ON p.{key} = f.{key} AND p.i = f.i + 1",
        ),
        ("sp_grp", f"SELECT {key}, label, i, piece, no, take, sum(CASE WHEN take THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS g FROM sp_pieces JOIN sp_fold USING ({key}, i)"),
        ("sp_clause", f"SELECT {key}, label, g, max(no) FILTER (take) AS no, {trim('''string_agg(piece, '' ORDER BY i)''')} AS body, max(g) OVER (PARTITION BY {key}) AS gmax FROM sp_grp GROUP BY {key}, label, g"),
        (
            "sp_long",
            f"SELECT {key}, label, g, no, body, CASE WHEN regexp_matches(body, '{lx.SUB_MARK}') THEN "
            f"list_transform(string_split(regexp_replace(body, '({lx.SUB_MARK})', chr(1) || '\\1', 'g'), chr(1))[2:], lambda x: {trim('x')}) "
            f"ELSE list_filter(list_transform(string_split_regex(body, '[；。]'), lambda x: {trim('x')}), lambda x: x <> '') END AS subs "
            "FROM sp_clause WHERE g > 0 AND length(body) > 800",
        ),
        (
            "sp_cut",
            f"SELECT {key}, label, g, no, CASE WHEN len(subs) = 1 AND length(subs[1]) > 800 THEN "
            f"list_transform(range(0, CAST(ceil(length(body) / 800.0) AS BIGINT)), lambda n: {trim('substring(body, n * 800 + 1, 800)')}) "
            "ELSE subs END AS subs FROM sp_long",
        ),
        (
            "sp_all",
            f"SELECT {key}, g, 0 AS sub_index, label || CASE WHEN gmax = 0 THEN '{lx.WHOLE_SUFFIX}' ELSE '{lx.INTRO_SUFFIX}' END AS canonical_id, body AS content FROM sp_clause WHERE g = 0 AND body <> '' "
            f"UNION ALL SELECT {key}, g, 0, label || '-第' || no || '条', body FROM sp_clause WHERE g > 0 AND length(body) <= 800 "
            f"UNION ALL SELECT {key}, g, CAST(i AS INT), label || '-第' || no || '条', content FROM (SELECT {key}, label, g, no, unnest(range(1, len(subs) + 1)) AS i, unnest(subs) AS content FROM sp_cut)",
        ),
        (
            "blocks",
            f"SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY g, sub_index) - 1 AS INT) AS chunk_index, canonical_id, "
            "CAST(sub_index AS INT) AS sub_index, CASE WHEN sub_index = 0 THEN canonical_id ELSE canonical_id || '#' || sub_index END AS chunk_id, content FROM sp_all",
        ),
    ]
