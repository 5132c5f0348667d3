"""The named tools and the clause splitter as functions of Spark SQL.

``register`` creates temporary SQL functions, so that a session's SQL text can call them; they run inside the JVM like any
built-in expression.

* ``calculate_penalty(principal, daily_rate_per_mille, days, context)`` - table function of one row, ``rate, error, penalty``:
  ``FROM calls, LATERAL calculate_penalty(...)``.  It becomes a projection, without a join.
* ``clause_blocks(text, label)`` - array of the blocks of a text, for ``LATERAL VIEW OUTER posexplode(...)``.  It is no table
  function, because Spark turns a generator inside one into a join on the whole texts.
* ``cite_clause(asked, top_k)`` - table function, ``rank, text`` of the clauses found for a query; ``citations`` creates it over
  the hits of a search.  It becomes an equi-join on the query.

Words, limits and patterns are those of ``lexicons``, ``numerals`` and ``params``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.functions import numerals, params
from clauselake.functions import text as tx

#: view that ``cite_clause`` reads: the hits of a search
CITED = "cited_clauses"
_DIGITS = ", ".join(f"'{c}', {i}" for i, c in enumerate(numerals.SIMPLE_DIGITS)) + ", '十', 10, '百', 100, '千', 1000"
_RATE_DIGITS = ", ".join(f"'{c}', {v}D" for c, v in numerals.RATE_DIGITS.items())
_SPACE = tx._CONTROL_AND_SPACE
_BLOCK = "STRUCT<canonical_id: STRING, sub_index: INT, chunk_id: STRING, content: STRING>"


def _rate_digit(pattern: str) -> str:
    found = f"regexp_extract(context, r'{pattern}', 1)"
    return f"CASE WHEN {found} RLIKE '^[0-9]$' THEN TRY_CAST({found} AS DOUBLE) ELSE try_element_at(map({_RATE_DIGITS}), {found}) END"


_ORDINAL = f"""CASE WHEN raw = '' THEN NULL WHEN raw RLIKE '^[0-9]+$' THEN coalesce(TRY_CAST(raw AS INT), 0) ELSE aggregate(
    transform(filter(split(raw, ''), ch -> ch <> ''), ch -> try_element_at(map({_DIGITS}), ch)),
    named_struct('total', 0, 'pending', 0, 'ok', true),
    (a, v) -> CASE WHEN v IS NULL THEN named_struct('total', a.total, 'pending', a.pending, 'ok', false)
        WHEN v >= 10 THEN named_struct('total', a.total + greatest(a.pending, 1) * v, 'pending', 0, 'ok', a.ok)
        ELSE named_struct('total', a.total, 'pending', v, 'ok', a.ok) END,
    a -> IF(a.ok, a.total + a.pending, 0)) END"""

# Lambdas over one-element arrays bind what is used several times: t text, l label, p pieces, n their numbers, s the starts.
_PIECES = f"""transform(array(named_struct('t', coalesce(text, ''), 'l', IF(label RLIKE r'\\P{{javaWhitespace}}', label, 'doc'))),
    v -> named_struct('t', v.t, 'l', v.l, 'p', split(v.t, r'(?={tx._HEADING})')))"""
_NUMBERED = f"""transform({_PIECES}, v -> named_struct('t', v.t, 'l', v.l, 'p', v.p,
    'n', transform(transform(v.p, p -> regexp_extract(p, r'^{tx._HEADING}', 1)), raw -> {_ORDINAL})))"""
_STARTED = f"""transform({_NUMBERED}, v -> named_struct('t', v.t, 'l', v.l, 'p', v.p, 'n', v.n, 's', aggregate(
    sequence(0, size(v.n) - 1), named_struct('last', -100, 'starts', CAST(array() AS ARRAY<INT>)),
    (a, i) -> CASE WHEN get(v.n, i) IS NOT NULL AND NOT (a.last >= 0 AND get(v.n, i) - a.last > {lx.MAX_HEADING_JUMP})
        THEN named_struct('last', get(v.n, i), 'starts', concat(a.starts, array(i))) ELSE a END,
    a -> a.starts)))"""
_NONE = "CAST(array() AS ARRAY<STRUCT<cid: STRING, body: STRING>>)"
_BODIES = f"""CASE WHEN NOT v.t RLIKE r'\\P{{javaWhitespace}}' THEN {_NONE}
    WHEN size(v.s) = 0 THEN array(named_struct('cid', v.l || '{lx.WHOLE_SUFFIX}', 'body', btrim(v.t, '{_SPACE}')))
    ELSE concat(
        IF(get(v.n, 0) IS NULL AND btrim(get(v.p, 0), '{_SPACE}') <> '',
            array(named_struct('cid', v.l || '{lx.INTRO_SUFFIX}', 'body', btrim(get(v.p, 0), '{_SPACE}'))), {_NONE}),
        transform(v.s, (s, j) -> named_struct('cid', v.l || '-第' || CAST(get(v.n, s) AS STRING) || '条',
            'body', btrim(array_join(slice(v.p, s + 1, coalesce(get(v.s, j + 1), size(v.p)) - s), ''), '{_SPACE}')))) END"""
#: first cut of a long body ``b.body``, before the check for one oversize piece
_CUT = f"""IF(b.body RLIKE '{lx.SUB_MARK}',
    slice(split(b.body, '(?={lx.SUB_MARK})'), IF(b.body RLIKE '^{lx.SUB_MARK}', 1, 2), greatest(size(split(b.body, '(?={lx.SUB_MARK})')), 1)),
    filter(split(b.body, '[；。]'), s -> s RLIKE r'[^\\x00-\\x20]'))"""
_WIDTHS = f"""transform(sequence(0, CAST(floor((length(b.body) - 1) / {lx.MAX_CLAUSE_LEN}) AS INT)),
    i -> substr(b.body, i * {lx.MAX_CLAUSE_LEN} + 1, {lx.MAX_CLAUSE_LEN}))"""

#: (signature, result, body) of every function, in the order in which they build on one another
FUNCTIONS = [
    ("stated_daily_rate(context STRING)", "DOUBLE", f"""CASE
        WHEN context RLIKE r'{params.PER_TEN_THOUSAND}' THEN {_rate_digit(params.PER_TEN_THOUSAND)} / 10.0D
        WHEN context RLIKE r'{params.PER_THOUSAND}' THEN {_rate_digit(params.PER_THOUSAND)}
        WHEN context RLIKE r'{params.PERCENT_RATE}' THEN TRY_CAST(regexp_extract(context, r'{params.PERCENT_RATE}', 1) AS DOUBLE) * 10.0D END"""),
    ("normal_daily_rate(rate DOUBLE, context STRING)", "DOUBLE",
     "CASE WHEN rate <= 1.0D THEN rate ELSE coalesce(stated_daily_rate(context), IF(rate < 10.0D, rate / 10.0D, rate)) END"),
    # a * 100 as a double and its error, by halves of a whose products are exact
    ("cents_half_up(x DOUBLE)", "DOUBLE", """get(transform(transform(
        array(named_struct('a', abs(x), 'cents', abs(x) * 100.0D, 'high', abs(x) * 134217729.0D - (abs(x) * 134217729.0D - abs(x)))),
        v -> named_struct('a', v.a, 'whole', CAST(floor(v.cents) AS DOUBLE), 'part', v.cents - CAST(floor(v.cents) AS DOUBLE),
            'error', (v.high * 100.0D - v.cents) + (v.a - v.high) * 100.0D)),
        v -> CASE WHEN v.a < 1.0E13D THEN (v.whole + IF(v.part > 0.5D OR (v.part = 0.5D AND v.error >= 0), 1.0D, 0.0D)) / 100.0D * IF(x < 0, -1.0D, 1.0D)
            WHEN v.a < double('infinity') THEN x END), 0)"""),
    ("calculate_penalty(principal DOUBLE, daily_rate_per_mille DOUBLE, days INT, context STRING)", "TABLE (rate DOUBLE, error STRING, penalty DOUBLE)",
     f"""SELECT rate, error, CASE WHEN error = '' AND principal >= 0 AND days >= 0 THEN cents_half_up(principal * (rate / 1000.0D) * days) END
        FROM (SELECT rate, array_join(array(
                CASE WHEN NOT principal > 0 THEN 'principal 必须为正数' END,
                CASE WHEN NOT rate > 0 THEN 'daily_rate_per_mille 必须为正数'
                    WHEN rate > {lx.MAX_RATE_PER_MILLE}D THEN 'daily_rate_per_mille 超出合理范围(<= {lx.MAX_RATE_PER_MILLE})' END,
                CASE WHEN NOT days > 0 THEN 'days 必须为正整数' END), '; ') AS error
            FROM (SELECT normal_daily_rate(daily_rate_per_mille, context) AS rate))"""),
    ("clause_blocks(text STRING, label STRING)", f"ARRAY<{_BLOCK}>", f"""flatten(get(transform({_STARTED}, v -> transform({_BODIES}, b -> CASE
        WHEN length(b.body) <= {lx.MAX_CLAUSE_LEN} OR endswith(b.cid, '{lx.INTRO_SUFFIX}') OR endswith(b.cid, '{lx.WHOLE_SUFFIX}')
            THEN array(named_struct('canonical_id', b.cid, 'sub_index', 0, 'chunk_id', b.cid, 'content', b.body))
        ELSE transform(flatten(transform(array({_CUT}), c -> IF(size(c) = 1 AND length(btrim(get(c, 0), '{_SPACE}')) > {lx.MAX_CLAUSE_LEN}, {_WIDTHS}, c))),
            (piece, k) -> named_struct('canonical_id', b.cid, 'sub_index', k + 1, 'chunk_id', b.cid || '#' || CAST(k + 1 AS STRING),
                'content', btrim(piece, '{_SPACE}'))) END)), 0))"""),
]


def register(spark: SparkSession) -> None:
    """Create the functions in the session, but for ``cite_clause``, which needs a table of hits (``citations``)."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")


def citations(hits: DataFrame) -> None:
    """Create ``cite_clause`` over hits: ``query_id, rank, content``."""
    hits.select("query_id", F.col("rank").cast("int").alias("rank"), "content").createOrReplaceTempView(CITED)
    hits.sparkSession.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cite_clause(asked STRING, top_k INT) RETURNS TABLE (rank INT, text STRING) "
        f"RETURN SELECT c.rank, c.content FROM {CITED} c WHERE c.query_id = cite_clause.asked AND c.rank <= cite_clause.top_k"
    )
