"""The registered queries as DuckDB SQL over the given tables, written independently of the
Spark plans: tokens as rows, self-joins by position, ordered lists."""

from __future__ import annotations

import re

from termgauge.functions import stats
from termgauge.plans import derived

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
HASH32 = "CAST(sum(CAST('0x' || left(md5({0}), 8) AS BIGINT)) AS BIGINT) AS checksum"
UNITS = "second|minute|hour|day|week|month|year|decade"


class dims:
    """Fixed values, stated here once more so that the SQL does not share them with the plans."""

    UNITS = {
        "minute": (60, "seconds"),
        "hour": (60, "minutes"),
        "day": (24, "hours"),
        "week": (7, "days"),
        "month": (4, "weeks"),
        "year": (12, "months"),
        "decade": (10, "years"),
    }
    FACTORIES = {
        "Num1Mult": ("*", "times"),
        "Num2Mult": ("*", "times"),
        "Num1#*": ("*", "#"),
        "Num2#*": ("*", "#"),
        "Num1Plus": ("+", "plus"),
        "Num2Plus": ("+", "plus"),
        "Num1#+": ("+", "#"),
        "Num2#+": ("+", "#"),
        "Num1concat#": ("concat", "#"),
        "Num1mode10#": ("%", "#"),
        "Num1Less": ("comp", "lower"),
        "Num1More": ("comp", "higher"),
        "Num1MoreLess": ("comp", "higherlower"),
    }
    WORDS_WITHOUT_UNIT = "mult plus concat plushashtag multhashtag mode10hashtag compareless comparemore comparemoreless".split()
    MODE_LABELS = {
        "mult": "Arithmetics-Multiplication",
        "plus": "Arithmetics-Adding",
        "concat": "Numbers-Concatination",
        "mode10hashtag": "Numbers-Mode10#",
        "plushashtag": "Numbers-Add#",
        "multhashtag": "Numbers-Mult#",
        "compareless": "Numbers-lower",
        "comparemore": "Numbers-higher",
    }
    MODEL_LABELS = {"gptjsmall": "1.3B", "gptjlarge": "2.7B", "gptj": "6B"}
    MODEL_NAMES = {"gptjsmall": "GPT-NEO-1.3B", "gptjlarge": "GPT-NEO-2.7B", "gptj": "GPT-J-6B"}
    ARITHMETIC_TASKS = {"mult": "Multiplication", "plus": "Addition"}
    ABSTRACT_TASKS = {"multhashtag": "Multiplication", "plushashtag": "Addition"}
    COMPARISON_TASKS = {"compareless": "Min", "comparemore": "Max"}
    TIME_TASKS = {
        "minute": "Min2Sec",
        "hour": "Hour2Min",
        "day": "Day2Hour",
        "week": "Week2Day",
        "month": "Month2Week",
        "year": "Year2Month",
        "decade": "Decade2Year",
    }
    KEYWORD_FILES = {"*": "sign_multiply", "+": "sign_plus", "-": "sign_minus"}
    KEY_TYPES = {"x": "x", "xy": "xy", "xz": "xz", "yz": "yz", "xyz": "xyz"}


CTES: dict[str, str] = {}


def _fields(step: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in step.items())


CTES["lines"] = f"""
SELECT CAST(row_number() OVER () AS BIGINT) AS rid, {derived.LINE_TEXT} AS text, {derived.LINE_META} AS meta
FROM (SELECT l_partkey AS p, {_fields(derived.LINE_FIELDS)} FROM lineitem)"""

CTES["docs"] = f"""
SELECT -1 - doc_id AS rid, array_to_string(list_transform(toks, lambda w, i:
         CASE (i - 1) % 16 WHEN 0 THEN chr(10) WHEN 8 THEN chr(160) ELSE ' ' END
         || {derived.WORD_RULE.replace('word', 'w')}), '') AS text,
       '{{"lang":"' || lang || '","source":"' || source || '"}}' AS meta
FROM (SELECT *, list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '') AS toks FROM documents)"""

CTES["corpus"] = "SELECT * FROM lines UNION ALL SELECT * FROM docs"


def _tokens(source: str) -> str:
    return f"""
SELECT rid, meta, unnest(toks) AS t, unnest(range(len(toks))) AS pos, len(toks) AS n_tokens
FROM (SELECT rid, meta, list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '') AS toks FROM {source})"""


CTES["tok"] = _tokens("corpus")
CTES["num"] = "SELECT * FROM tok WHERE regexp_full_match(t, '[0-9]{1,6}')"
CTES["line_num"] = f"SELECT * FROM ({_tokens('lines')}) WHERE regexp_full_match(t, '[0-9]{{1,6}}')"
CTES["kw"] = f"""
SELECT *, CASE WHEN lower(t) IN ('plus', '+', 'minus', '-', 'times', '*') THEN lower(t)
  ELSE regexp_extract(lower(t), '^({UNITS})s?$', 1) END AS keyword
FROM tok WHERE lower(t) IN ('plus', '+', 'minus', '-', 'times', '*') OR regexp_full_match(lower(t), '({UNITS})s?')"""


def _pairs(num: str) -> str:
    return f"""
SELECT least(a.t, b.t) AS n1, greatest(a.t, b.t) AS n2, count(*) AS frequency
FROM {num} a JOIN {num} b ON a.rid = b.rid AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 GROUP BY 1, 2"""


CTES["k1"] = "SELECT t AS n1, count(*) AS frequency FROM num GROUP BY 1"
CTES["k2"] = _pairs("num")
CTES["line_k2"] = _pairs("line_num")
CTES["k3"] = """
SELECT l[1] AS n1, l[2] AS n2, l[3] AS n3, count(*) AS frequency
FROM (SELECT list_sort([a.t, b.t, c.t]) AS l
      FROM num a JOIN num b ON a.rid = b.rid AND b.pos BETWEEN a.pos + 1 AND a.pos + 4
      JOIN num c ON a.rid = c.rid AND c.pos BETWEEN b.pos + 1 AND a.pos + 4) GROUP BY 1, 2, 3"""
CTES["w1"] = """
SELECT a.t AS n1, k.keyword, count(*) AS frequency
FROM num a JOIN kw k ON a.rid = k.rid AND k.pos BETWEEN a.pos - 4 AND a.pos + 4 GROUP BY 1, 2"""
CTES["w2"] = """
SELECT least(a.t, b.t) AS n1, greatest(a.t, b.t) AS n2, k.keyword, count(*) AS frequency
FROM num a JOIN num b ON a.rid = b.rid AND b.pos BETWEEN a.pos + 1 AND a.pos + 4
JOIN kw k ON a.rid = k.rid AND abs(k.pos - a.pos) < 5 AND abs(k.pos - b.pos) < 5 GROUP BY 1, 2, 3"""
CTES["w3"] = """
SELECT l[1] AS n1, l[2] AS n2, l[3] AS n3, keyword, count(*) AS frequency
FROM (SELECT list_sort([a.t, b.t, c.t]) AS l, k.keyword
      FROM num a JOIN num b ON a.rid = b.rid AND b.pos BETWEEN a.pos + 1 AND a.pos + 4
      JOIN num c ON a.rid = c.rid AND c.pos BETWEEN b.pos + 1 AND a.pos + 4
      JOIN kw k ON a.rid = k.rid AND abs(k.pos - a.pos) < 5 AND abs(k.pos - b.pos) < 5 AND abs(k.pos - c.pos) < 5)
GROUP BY 1, 2, 3, 4"""
CTES["arith"] = """
SELECT a.t AS x, b.t AS y, c.t AS z, count(*) AS frequency
FROM num a JOIN tok b ON a.rid = b.rid AND b.pos = a.pos + 2 JOIN tok c ON a.rid = c.rid AND c.pos = a.pos + 4
WHERE regexp_full_match(b.t, '[0-9]+') AND regexp_full_match(c.t, '[0-9]+') GROUP BY 1, 2, 3"""
CTES["per_keyword"] = """
SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY frequency DESC, n1) AS rank FROM w1
QUALIFY rank <= 200"""


def window(w: int, centre: str = "tok") -> str:
    """Every centre token with its padded window as text, by joining the neighbours."""
    return f"""
SELECT c.rid, c.pos, c.meta, c.t AS middle,
  repeat('NONEWORD ', greatest({w - 1} - c.pos, 0)::BIGINT) || string_agg(n.t, ' ' ORDER BY n.pos)
  || repeat(' NONEWORD', greatest(c.pos + {w} - c.n_tokens, 0)::BIGINT) AS text
FROM {centre} c JOIN tok n ON c.rid = n.rid AND n.pos BETWEEN c.pos - {w - 1} AND c.pos + {w - 1}
GROUP BY c.rid, c.pos, c.meta, c.t, c.n_tokens"""


# ---------------------------------------------------------------- questions

CTES["top1"] = "SELECT * FROM k1 ORDER BY frequency DESC, n1 LIMIT 200"
CTES["top2"] = "SELECT * FROM k2 ORDER BY frequency DESC, n1, n2 LIMIT 200"
CTES["unit"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{u}', CAST({m} AS BIGINT), '{u}s', '{t}')" for u, (m, t) in dims.UNITS.items()
) + ") u(unit, multiplier, source, target)"
CTES["factory"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{f}', '{o}', '{w}')" for f, (o, w) in dims.FACTORIES.items()
) + ") f(factory_type, math_operator, word)"


def num1(factory: str, low: int, high: int, z: str, where: str = "true", terms="top1", x="CAST(a AS VARCHAR)") -> str:
    operator, word = dims.FACTORIES[factory]
    return f"""
SELECT '{factory}' AS factory_type, n1 AS key, frequency, {x} AS x, CAST(b AS VARCHAR) AS y,
  CAST({z} AS VARCHAR) AS z, '{word}' AS word, '{operator}' AS math_operator
FROM (SELECT n1, frequency, CAST(n1 AS BIGINT) AS a, unnest(range({low}, {high + 1})) AS b FROM {terms}) WHERE {where}"""


def num2(factory: str, z: str) -> str:
    operator, word = dims.FACTORIES[factory]
    return f"""
SELECT '{factory}' AS factory_type, '(''' || n1 || ''', ''' || n2 || ''')' AS key, frequency, n1 AS x, n2 AS y,
  CAST({z} AS VARCHAR) AS z, '{word}' AS word, '{operator}' AS math_operator
FROM (SELECT *, CAST(n1 AS BIGINT) AS a, CAST(n2 AS BIGINT) AS b FROM top2)"""


CTES["mult"] = num1("Num1Mult", 0, 99, "a * b")
CTES["plus"] = num1("Num1Plus", 0, 99, "a + b")
CTES["more"] = num1("Num1More", 1, 100, "greatest(a, b)", "a <> b")
CTES["less"] = num1("Num1Less", 1, 100, "least(a, b)", "a <> b")
CTES["moreless"] = "SELECT * FROM more UNION ALL SELECT * FROM less"
CTES["times"] = """
SELECT upper(left(keyword, 1)) || substr(keyword, 2) || '1' AS factory_type,
  '(''' || n1 || ''', ''' || keyword || ''')' AS key, frequency, n1 AS x, CAST(multiplier AS VARCHAR) AS y,
  CAST(CAST(n1 AS BIGINT) * multiplier AS VARCHAR) AS z, keyword AS word, '*' AS math_operator
FROM per_keyword JOIN unit ON unit = keyword"""

ARITHMETIC = "'What is ' || x || ' ' || word || ' ' || y || '?'"
COMPARISON = "'Which one is ' || word || '? ' || x || ' or ' || y"
TWO_DIGITS = "length(x) <= 2 AND length(y) <= 2"
CTES["mult_points"] = f"SELECT *, {ARITHMETIC} AS question, z AS answer FROM mult WHERE {TWO_DIGITS}"
CTES["plus_points"] = f"SELECT *, {ARITHMETIC} AS question, z AS answer FROM plus WHERE {TWO_DIGITS}"
CTES["compare_points"] = f"SELECT *, {COMPARISON} AS question, z AS answer FROM moreless WHERE {TWO_DIGITS}"
CTES["time_questions"] = """
SELECT times.*, 'What is ' || x || ' ' || source || ' in ' || target || '?' AS question FROM times JOIN unit ON unit = word"""


def seeded(points: str) -> str:
    return f"""
SELECT *, md5(seed || ':' || question) AS draw,
  row_number() OVER (PARTITION BY seed, factory_type ORDER BY md5(seed || ':' || question), key) AS place
FROM (SELECT CAST(unnest(range(0, 5)) AS INT) AS seed, * FROM {points})"""


# Numbers of a question without its last character, as a sorted set.
NUMBER_SET = """list_sort(list_distinct(list_transform(list_filter(
  string_split(left(question, length(question) - 1), ' '), lambda w: regexp_full_match(w, '[0-9]+')),
  lambda w: CAST(w AS BIGINT))))"""


def experiment(name: str, points: str, quota: str) -> None:
    """CTEs <name>_all, _train, _test (leak-free) and _cases (with the prompt)."""
    CTES[f"{name}_all"] = f"SELECT *, {NUMBER_SET} AS numbers, place <= ({quota}) AS shot FROM ({seeded(points)})"
    CTES[f"{name}_train"] = f"SELECT * FROM {name}_all WHERE shot"
    CTES[f"{name}_test"] = f"""
SELECT * FROM {name}_all t WHERE NOT shot
AND NOT EXISTS (SELECT 1 FROM {name}_train s WHERE s.seed = t.seed AND s.numbers = t.numbers)"""
    CTES[f"{name}_cases"] = f"""
SELECT t.*, shots || 'Q: ' || question || chr(10) || 'A:' AS body FROM {name}_test t JOIN (
  SELECT seed, string_agg('Q: ' || question || chr(10) || 'A: ' || answer || chr(10) || chr(10), ''
    ORDER BY draw, factory_type, key) AS shots FROM {name}_train GROUP BY seed) USING (seed)"""


experiment("cmp", "compare_points", "CASE factory_type WHEN 'Num1More' THEN 3 ELSE 2 END")
experiment("mlt", "mult_points", "2")
experiment("mlt8", "mult_points", "8")
CTES["results"] = """
SELECT *, CAST(coalesce(generated_answer = answer, false) AS INT) AS is_correct FROM (
  SELECT *, CASE WHEN lot < 60 THEN z WHEN lot < 95 THEN CAST(CAST(z AS BIGINT) + 1 AS VARCHAR) END AS generated_answer
  FROM (SELECT *, (CAST(x AS INT) * 7 + CAST(y AS INT) * 13 + seed * 5) % 100 AS lot FROM mlt_cases))"""

# ---------------------------------------------------------------- graded answers

_graded = "lineitem"
for _i, _step in enumerate(derived.GRADED_STEPS):
    _graded = f"(SELECT {'' if _i == 0 else '*, '}{_fields(_step)} FROM {_graded})"
CTES["graded"] = f"SELECT {', '.join(derived.GRADED_COLUMNS)} FROM {_graded}"

NO_WORD = "(" + ", ".join(f"'{w}'" for w in dims.WORDS_WITHOUT_UNIT) + ")"


def frequency(k: int) -> str:
    numbers = ", ".join(f"n{i + 1}" for i in range(k))
    return f"SELECT {numbers}, '' AS keyword, frequency FROM k{k} UNION ALL SELECT {numbers}, keyword, frequency FROM w{k}"


for _k in (1, 2, 3):
    CTES[f"freq{_k}"] = frequency(_k)


def keyed(key_type: str, source: str = "graded") -> str:
    """Graded answers with the sorted operand strings in ``l`` and the unit in ``unitword``."""
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in dims.KEY_TYPES[key_type])
    return f"""
SELECT *, list_sort([{parts}]) AS l, CASE WHEN word IN {NO_WORD} THEN '' ELSE word END AS unitword FROM {source}"""


def key_text(key_type: str) -> str:
    listed = "'(' || array_to_string(list_transform(CASE WHEN unitword = '' THEN l ELSE list_append(l, unitword) END, lambda w: '''' || w || ''''), ', ') || ')'"
    return listed if len(key_type) > 1 else f"CASE WHEN unitword = '' THEN l[1] ELSE {listed} END"


def on_key(key_type: str) -> str:
    k = len(key_type)
    return " AND ".join(f"f.n{i + 1} = l[{i + 1}]" for i in range(k)) + " AND f.keyword = unitword"


def looked_up(key_type: str) -> str:
    return f"""
SELECT {', '.join('g.' + c for c in derived.GRADED_COLUMNS)}, {key_text(key_type)} AS lookup_key,
  coalesce(f.frequency, 0) AS lookup_frequency, CAST(f.frequency IS NOT NULL AS INT) AS found
FROM ({keyed(key_type)}) g LEFT JOIN freq{len(key_type)} f ON {on_key(key_type)}"""


def key_accuracy(key_type: str, source: str = "graded") -> str:
    return f"""
SELECT word, model, shots, '{key_type}' AS key_type, key, CAST(f.frequency AS DOUBLE) AS frequency, answers, correct,
  correct / answers AS accuracy, mean_x, list_transform(l, lambda w: CAST(w AS BIGINT)) AS parts
FROM (SELECT word, model, shots, unitword, l, {key_text(key_type)} AS key, count(*) AS answers,
        CAST(sum(is_correct) AS BIGINT) AS correct, avg(x) AS mean_x
      FROM ({keyed(key_type, source)}) GROUP BY word, model, shots, unitword, l) g
JOIN freq{len(key_type)} f ON {on_key(key_type)}"""


for _kt in dims.KEY_TYPES:
    CTES[f"keys_{_kt}"] = key_accuracy(_kt)
CTES["looked_up"] = " UNION ALL ".join(f"SELECT *, '{kt}' AS key_type FROM ({looked_up(kt)})" for kt in dims.KEY_TYPES)
CTES["keys"] = " UNION ALL ".join(f"SELECT * FROM keys_{kt}" for kt in dims.KEY_TYPES)
CTES["both_ways"] = """
SELECT seed, shots, model, word, key, frequency, x, y, z, is_correct FROM graded
UNION ALL SELECT seed, shots, model, word, key, frequency, y, x, z, is_correct FROM graded WHERE x <> y"""

# ---------------------------------------------------------------- bins

CELL = "word, model, shots, key_type"
Q = 10


def _edge(i: int) -> str:
    h = f"((n - 1) * {(1.0 if i == Q else i * (1.0 / Q))!r}::DOUBLE)"
    lo = f"fs[CAST(floor({h}) AS BIGINT) + 1]"
    hi = f"fs[least(CAST(floor({h}) AS BIGINT) + 2, n)]"
    t = f"({h} - floor({h}))"
    value = f"CASE WHEN {t} < 0.5 THEN {lo} + ({hi} - {lo}) * {t} ELSE {hi} - ({hi} - {lo}) * (1 - {t}) END"
    return f"{value}{' + 1.0' if i == Q else ''}"


CTES["edges"] = f"""
SELECT {CELL}, [{', '.join(_edge(i) for i in range(Q + 1))}] AS edges
FROM (SELECT {CELL}, list(frequency ORDER BY frequency) AS fs, count(*) AS n FROM keys GROUP BY {CELL})"""
CTES["bins"] = f"""
SELECT {CELL}, bin, coalesce(b.keys, 0) AS keys,
  CASE WHEN bin < first THEN 0.0 ELSE b.accuracy END AS accuracy, CASE WHEN bin < first THEN 0.0 ELSE b.h END AS h,
  edges[bin] AS low, edges[bin + 1] AS high, edges[bin + 1] - edges[bin] AS width, sqrt(edges[bin] * edges[bin + 1]) AS mid,
  exp((1 - (bin - 1) / {Q - 1}.0::DOUBLE) * ln(edges[bin]) + (bin - 1) / {Q - 1}.0::DOUBLE * ln(edges[bin + 1])) AS dilated
FROM (SELECT *, CAST(unnest(range(1, {Q + 1})) AS INT) AS bin FROM edges)
LEFT JOIN (
  SELECT *, sem * {stats.t_975_sql('(keys - 1)')} AS h FROM (
    SELECT {CELL}, CAST(len(list_filter(edges, lambda e: e <= frequency)) AS INT) AS bin, count(*) AS keys,
      avg(accuracy) AS accuracy, stddev_samp(accuracy) / sqrt(count(*)) AS sem
    FROM keys JOIN edges USING ({CELL}) GROUP BY ALL)) b USING ({CELL}, bin)
JOIN (SELECT {CELL}, min(len(list_filter(edges, lambda e: e <= frequency))) AS first
      FROM keys JOIN edges USING ({CELL}) GROUP BY {CELL}) USING ({CELL})"""
CTES["gaps"] = f"""
SELECT {CELL}, max(accuracy) FILTER (bin = 1) AS q_first, max(accuracy) FILTER (bin = {Q}) AS q_last,
  max(accuracy) FILTER (bin = {Q}) - max(accuracy) FILTER (bin = 1) AS gap FROM bins GROUP BY {CELL}"""
CTES["overall"] = f"""
SELECT {CELL}, CAST(sum(answers) AS BIGINT) AS answers, sum(correct) / sum(answers) AS accuracy FROM keys GROUP BY {CELL}"""


def _beyond(edge: str, i: str, j: str) -> str:
    slope = f"((a{j} - a{i}) / nullif(ln(m{j}) - ln(m{i}), 0))"
    return f"({slope} * ln({edge}) + (a{i} - {slope} * ln(m{i})))"


_at = lambda name, column, b: f"max({column}) FILTER (bin = {b}) AS {name}"
CTES["ends"] = f"""
SELECT {CELL}, {', '.join(_at(f'm{b}', 'mid', b) + ', ' + _at(f'a{b}', 'accuracy', b) for b in (1, 2, Q - 1, Q))},
  {_at('l', 'low', 1)}, {_at('r', 'high', Q)}, {_at('hl', 'h', 1)}, {_at('hr', 'h', Q)} FROM bins GROUP BY {CELL}"""
CTES["curve"] = f"""
SELECT {CELL}, bin AS point, mid AS frequency, accuracy, h FROM bins
UNION ALL SELECT {CELL}, 0, l, {_beyond('l', '1', '2')}, hl FROM ends
UNION ALL SELECT {CELL}, {Q + 1}, r, {_beyond('r', str(Q - 1), str(Q))}, hr FROM ends"""
CTES["spearman"] = f"""
SELECT {CELL}, CASE WHEN stddev_pop(rf) > 0 AND stddev_pop(ra) > 0
  THEN covar_pop(rf, ra) / (stddev_pop(rf) * stddev_pop(ra)) END AS spearman
FROM (SELECT {CELL},
  rank() OVER (PARTITION BY {CELL} ORDER BY frequency) + (count(*) OVER (PARTITION BY {CELL}, frequency) - 1) / 2.0 AS rf,
  rank() OVER (PARTITION BY {CELL} ORDER BY accuracy) + (count(*) OVER (PARTITION BY {CELL}, accuracy) - 1) / 2.0 AS ra
  FROM keys) GROUP BY {CELL}"""
CTES["pearson"] = f"""
SELECT {CELL}, CASE WHEN stddev_pop(accuracy) > 0 AND stddev_pop(ln(frequency)) > 0
  THEN covar_pop(accuracy, ln(frequency)) / (stddev_pop(accuracy) * stddev_pop(ln(frequency))) END AS pearson
FROM keys GROUP BY {CELL}"""


def farthest(key_type: str, n: int = 100) -> str:
    gap = lambda c: f"(CASE WHEN i.parts[{c}] = j.parts[{c}] THEN 0.01::DOUBLE ELSE abs(i.parts[{c}] - j.parts[{c}])::DOUBLE END)"
    gaps = "(" + " * ".join(gap(c + 1) for c in range(len(key_type))) + ")"
    smaller = "i.parts[1] < j.parts[1]" if len(key_type) == 1 else "i.key < j.key"
    df = "(i.frequency - j.frequency)"
    return f"""
SELECT {CELL}, score, key_i, key_j, log_gap, a_i, a_j, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY {CELL} ORDER BY score DESC, key_i, key_j) AS rank FROM (
    SELECT {CELL}, i.key AS key_i, j.key AS key_j, i.accuracy AS a_i, j.accuracy AS a_j,
      {df} * {df} * {df} * (i.accuracy - j.accuracy) / ({gaps} * {gaps}) AS score,
      abs(log10(i.frequency) - log10(j.frequency)) AS log_gap
    FROM pts i JOIN pts j USING ({CELL}) WHERE {smaller})) WHERE rank <= {n}"""


NOT_ROUND = "len(list_filter(parts, lambda p: p < 10 OR p % 10 = 0)) = 0"
for _kt in dims.KEY_TYPES:
    CTES[f"pts_{_kt}"] = f"SELECT * FROM keys_{_kt} WHERE {NOT_ROUND}"
    CTES[f"far_{_kt}"] = farthest(_kt).replace("pts ", f"pts_{_kt} ")


def _case(column: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def gap_report(tasks: dict[str, str], key_types: tuple[str, ...], fields: tuple[str, ...], factor: str = "", ratios=()) -> str:
    words = ", ".join(f"'{w}'" for w in tasks)
    value = lambda f, kt: f"max({f}) FILTER (key_type = '{kt}')"
    columns = [f"round({value(f, kt)}{factor} + 1e-9, 6) + 0.0 AS {f}_{kt}" for kt in key_types for f in fields]
    base = f"nullif({value('accuracy', 'x')}, 0)"
    columns += [f"round({value('gap', kt)} / {base} + 1e-9, 6) + 0.0 AS ratio_{kt}" for kt in ratios]
    return f"""
SELECT {_case('word', tasks)} AS task, model, shots, round({value('accuracy', 'x')}{factor} + 1e-9, 6) AS accuracy, {', '.join(columns)}
FROM gaps JOIN overall USING ({CELL}) WHERE model = 'gptj' AND word IN ({words}) GROUP BY word, model, shots"""


# ---------------------------------------------------------------- queries

QUERIES: dict[str, str] = {}
GRADED = ", ".join(derived.GRADED_COLUMNS)
OPERANDS = "factory_type, key, frequency, x, y, z, word, math_operator"
SHORT_MODE = _case("word", {w: dims.MODE_LABELS[w] for w in ("mult", "plus")}, "'Time-Coversion-From' || word")


def _r(columns: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in columns.split())


QUERIES |= {
    "tokenize": "SELECT t AS token, count(*) AS n FROM tok GROUP BY 1",
    "is_number": "SELECT length(t) AS digits, count(*) AS n FROM num GROUP BY 1",
    "match_keyword": "SELECT t AS token, keyword, count(*) AS n FROM kw GROUP BY 1, 2",
    "text_windows": f"SELECT length(middle) AS length, count(*) AS n, {HASH32.format('text')} FROM ({window(5)}) GROUP BY 1",
    "surrounding_search": f"""SELECT lower(middle) AS match, count(*) AS n, {HASH32.format('text')}
      FROM ({window(4, "(SELECT * FROM tok WHERE regexp_full_match(t, '[A-Z][a-z]{1,3}'))")}) GROUP BY 1""",
    "number_windows": f"SELECT meta, middle, count(*) AS n, {HASH32.format('text')} FROM ({window(5, 'num')}) GROUP BY 1, 2",
    "keyword_windows": f"""SELECT keyword AS match, meta, count(*) AS n, {HASH32.format('text')}
      FROM (SELECT v.*, kw.keyword FROM ({window(5, 'kw')}) v JOIN kw USING (rid, pos)) GROUP BY 1, 2""",
    "number_keyword_patterns": f"""
      SELECT before || a.t || ' ' || k.t || ' ' || b.t || CASE WHEN alternative <> 2 THEN ' ' || c.t ELSE '' END
        || CASE WHEN a.pos + CASE WHEN alternative = 2 THEN 3 ELSE 4 END = a.n_tokens THEN '' ELSE ' ' END AS span,
        regexp_extract(k.t, '(?i)^({UNITS})s?$', 1) AS keyword, alternative, count(*) AS n
      FROM (SELECT *, regexp_full_match(t, '[0-9]+') AS is_num, CASE WHEN rid < 0 OR pos > 0 THEN ' ' ELSE '' END AS before FROM tok) a
      JOIN tok k ON k.rid = a.rid AND k.pos = a.pos + 1 AND regexp_full_match(lower(k.t), '({UNITS})s?')
      JOIN tok b ON b.rid = a.rid AND b.pos = a.pos + 2
      LEFT JOIN tok c ON c.rid = a.rid AND c.pos = a.pos + 3,
      LATERAL (SELECT regexp_full_match(b.t, '[0-9]+') AS nb, coalesce(regexp_full_match(c.t, '[0-9]+'), false) AS nc),
      LATERAL (SELECT CASE WHEN nb AND nc THEN 1 WHEN nb THEN 2 WHEN nc THEN 3 END AS alternative)
      WHERE a.is_num AND alternative IS NOT NULL GROUP BY 1, 2, 3""",
    "num_occurrence": "SELECT * FROM k1",
    "num_co_occurrence": "SELECT * FROM k2",
    "num_co_occurrence_k3": "SELECT * FROM k3",
    "word_num_occurrence": "SELECT * FROM w1",
    "word_num_occurrence_k2": "SELECT * FROM w2",
    "word_num_occurrence_original": "SELECT * FROM w1",
    "word_num_occurrence_original_k2": "SELECT * FROM w2",
    "arithmetic_pattern": "SELECT * FROM arith",
    "num_co_occurrence_in_windows": "SELECT * FROM k2",
    "word_num_occurrence_in_windows": "SELECT * FROM w1",
    "arithmetic_pattern_in_windows": "SELECT * FROM arith",
    "count_by_key": "SELECT word, model, shots, key, count(*) AS frequency FROM graded GROUP BY 1, 2, 3, 4",
    "merge_counts": "SELECT * FROM k2",
    "distinct_keywords": "SELECT DISTINCT keyword FROM w1",
    "sort_by_frequency": "SELECT * FROM w1 ORDER BY frequency DESC, n1, keyword",
    "top_terms": "SELECT * FROM top2",
    "top_terms_per_keyword": "SELECT * FROM per_keyword",
    "incremental_counts": "SELECT * FROM k2",
    "word_num_occurrence_k3": "SELECT * FROM w3",
    # sources and sinks
    "read_corpus": f"SELECT meta, count(*) AS n, {HASH32.format('text')} FROM corpus GROUP BY 1",
    "read_windows": "SELECT * FROM k2",
    "write_windows": f"SELECT middle, count(*) AS n, {HASH32.format('text')} FROM ({window(5, 'num')}) GROUP BY 1",
    "read_counts": "SELECT * FROM w2",
    "read_frequency": "SELECT * FROM top1",
    "constant_frequency": """SELECT CAST(i AS VARCHAR) AS n1, CAST(100 AS BIGINT) AS frequency, k1.frequency AS counted
      FROM range(0, 100) r(i) LEFT JOIN k1 ON n1 = CAST(i AS VARCHAR)""",
    "read_results": f"""SELECT key, frequency, count(*) AS n, CAST(sum(is_correct) AS BIGINT) AS correct,
      CAST(sum(CAST(z AS BIGINT)) AS BIGINT) AS z, {HASH32.format('body')} FROM results GROUP BY 1, 2""",
    "frequency_for": f"""SELECT n1, '' AS keyword, frequency, unnest({dims.WORDS_WITHOUT_UNIT}) AS word FROM k1
      UNION ALL SELECT n1, keyword, frequency, keyword FROM w1 WHERE keyword IN ({', '.join(f"'{u}'" for u in dims.UNITS)})""",
    "write_counts": "SELECT * FROM arith",
    "write_sorted_counts": "SELECT * FROM k2",
    "write_counts_by_keyword": f"SELECT *, {_case('keyword', dims.KEYWORD_FILES, 'keyword')} AS keyword_file FROM w1",
    "write_results": """SELECT CAST(seed AS VARCHAR) AS seed, CASE is_correct WHEN 1 THEN 'true' ELSE 'false' END AS is_correct,
      md5(body) AS body, question FROM results""",
    "write_report": gap_report(dims.ARITHMETIC_TASKS, ("x", "xy", "xz"), ("gap",)),
    # questions
    "num1_mult": "SELECT * FROM mult",
    "num1_plus": "SELECT * FROM plus",
    "num1_compare": "SELECT * FROM less",
    "num1_concat": num1("Num1concat#", 1, 50, "n1 || b", x="n1"),
    "num1_mod10": num1("Num1mode10#", 10, 10, "right(n1, 1)", x="n1"),
    "num2_plus": num2("Num2Plus", "a + b"),
    "num2_mult": num2("Num2Mult", "a * b"),
    "time_unit": "SELECT * FROM times",
    "more_less": "SELECT * FROM moreless",
    "operand_expand": " UNION ALL ".join(
        [num1("Num1#*", 0, 99, "a * b"), num1("Num1#+", 0, 99, "a + b"), num2("Num2#*", "a * b"), num2("Num2#+", "a + b")]
    ),
    "unit_dim_join": "SELECT n1, keyword, frequency, multiplier, source, target FROM w1 JOIN unit ON unit = keyword",
    "template_dim_join": """SELECT factory_type, key, frequency, x, y, z, f.math_operator, f.word
      FROM moreless m JOIN factory f USING (factory_type)""",
    "digit_limit_filter": f"SELECT * FROM ({num1('Num1Plus', 0, 99, 'a + b', terms='k1')}) WHERE {TWO_DIGITS}",
    "question_arithmetic": f"SELECT key, {ARITHMETIC} AS question, z FROM mult",
    "question_comparison": f"SELECT key, {COMPARISON} AS question, z FROM moreless",
    "question_time_unit": "SELECT key, question, z FROM time_questions",
    "datapoints": f"""SELECT {OPERANDS}, question, answer FROM plus_points
      UNION ALL SELECT {OPERANDS}, question, answer FROM compare_points
      UNION ALL SELECT {OPERANDS}, question, z FROM time_questions WHERE {TWO_DIGITS}""",
    "question_numbers": """SELECT question, array_to_string(list_transform(list_filter(
      string_split(left(question, length(question) - 1), ' '), lambda w: regexp_full_match(w, '[0-9]+')),
      lambda w: CAST(CAST(w AS BIGINT) AS VARCHAR)), ',') AS numbers FROM compare_points""",
    # prompts and grading
    "multi_seed": "SELECT CAST(s AS INT) AS seed, key, count(*) AS n FROM mult_points, range(0, 5) r(s) GROUP BY 1, 2",
    "split_shots": f"SELECT seed, {OPERANDS}, question, answer, draw FROM mlt8_train",
    "split_shots_grouped": """SELECT seed, CASE WHEN shot THEN 'train' ELSE 'test' END AS part, factory_type, question, answer
      FROM cmp_all""",
    "leakage_filter": "SELECT seed, factory_type, key, question FROM cmp_test",
    "render_prompt": """SELECT seed, factory_type, key, question, md5('Answer.' || chr(10) || chr(10) || body) AS body
      FROM cmp_cases""",
    "grade_completions": "SELECT seed, key, question, answer, generated_answer, is_correct FROM results",
    "flatten_results": """SELECT seed, factory_type, draw, generated_answer, is_correct = 1 AS is_correct,
      md5(body) AS "testcase.body", question AS "testcase.data_point.question", answer AS "testcase.data_point.answer",
      x AS "testcase.data_point.frequency_data.x", y AS "testcase.data_point.frequency_data.y",
      z AS "testcase.data_point.frequency_data.z", word AS "testcase.data_point.frequency_data.word",
      math_operator AS "testcase.data_point.frequency_data.math_operator",
      key AS "testcase.data_point.frequency_data.key", frequency AS "testcase.data_point.frequency_data.frequency"
      FROM results""",
    # lookup
    "lookup_pair_frequency": f"""SELECT {', '.join('g.' + c for c in derived.GRADED_COLUMNS)},
      '(''' || l[1] || ''', ''' || l[2] || ''')' AS pair_key, coalesce(f.frequency, 0) AS pair_frequency,
      CAST(f.frequency IS NOT NULL AS INT) AS found
      FROM ({keyed('xz')}) g LEFT JOIN k2 f ON f.n1 = l[1] AND f.n2 = l[2]""",
    "pair_order_check": """SELECT i.x AS a, i.y AS b, i.f AS frequency_ab, j.f AS frequency_ba
      FROM (SELECT x, y, CAST(sum(frequency) AS BIGINT) AS f FROM arith GROUP BY 1, 2) i
      JOIN (SELECT x, y, CAST(sum(frequency) AS BIGINT) AS f FROM arith GROUP BY 1, 2) j
      ON i.x = j.y AND i.y = j.x WHERE i.x < i.y""",
    "not_found_count": """SELECT key_type, word, count(*) AS looked_up, CAST(sum(1 - found) AS BIGINT) AS not_found
      FROM looked_up GROUP BY 1, 2""",
    "pair_digit_filter": "SELECT * FROM k2 WHERE length(n1) <= 2 OR length(n2) <= 2",
    "small_operand_filter": "SELECT * FROM graded WHERE x >= 11 AND y >= 11 AND z >= 11",
    "symmetry_union": "SELECT * FROM both_ways",
    "symmetry_check": """SELECT k, count(*) FILTER (side = 'xb') AS x_before, count(*) FILTER (side = 'yb') AS y_before,
      count(*) FILTER (side = 'xa') AS x_after, count(*) FILTER (side = 'ya') AS y_after FROM (
      SELECT x AS k, 'xb' AS side FROM graded UNION ALL SELECT y, 'yb' FROM graded
      UNION ALL SELECT x, 'xa' FROM both_ways UNION ALL SELECT y, 'ya' FROM both_ways)
      WHERE k IN (0, 7, 24, 50, 90, 91) GROUP BY 1""",
    "drop_zero_frequency": "SELECT * FROM looked_up WHERE lookup_frequency >= 1",
    "drop_zero_frequency_kept": """SELECT key_type, word, CASE WHEN lookup_frequency > 0 THEN 'counted' ELSE 'jitter' END AS kind,
      count(*) AS n FROM looked_up GROUP BY 1, 2, 3""",
    "round_key_filter": f"SELECT {CELL}, key FROM keys WHERE {NOT_ROUND}",
    "key_parts": f"SELECT {CELL}, key, array_to_string(list_transform(parts, lambda p: CAST(p AS VARCHAR)), ',') AS parts FROM keys",
    "important_points": f"""SELECT {CELL}, {_r('frequency accuracy')}, array_to_string(list_transform(parts, lambda p: CAST(p AS VARCHAR)), ' ') AS label FROM keys
      WHERE CAST(trunc(mean_x) AS INT) IN (72, 71, 23, 24)""",
    # accuracy
    "accuracy_by_key": """SELECT seed, key, frequency, CAST(sum(is_correct) AS BIGINT) AS correct, count(*) AS total,
      round(avg(is_correct) + 1e-9, 6) AS accuracy FROM graded GROUP BY 1, 2, 3""",
    "accuracy_by_key_of_testcases": """SELECT seed, key, frequency, CAST(sum(is_correct) AS BIGINT) AS correct,
      count(*) AS total, round(avg(is_correct) + 1e-9, 6) AS accuracy FROM results GROUP BY 1, 2, 3""",
    "key_accuracy": f"SELECT {CELL}, key, {_r('frequency')}, answers, correct, {_r('accuracy mean_x')} FROM keys",
    "key_accuracy_filtered": f"""SELECT word, model, shots, key, {_r('frequency')}, answers, correct, {_r('accuracy mean_x')}
      FROM ({key_accuracy('xyz', "(SELECT * FROM both_ways WHERE x >= 11 AND y >= 11 AND z >= 11)")})""",
    "mean_by_frequency_key": """SELECT word, model, shots, key, round(avg(x) + 1e-9, 6) AS mean_x, round(avg(is_correct) + 1e-9, 6) AS accuracy,
      round(avg(frequency) + 1e-9, 6) AS mean_frequency FROM graded GROUP BY 1, 2, 3, 4""",
    "overall_accuracy": f"SELECT {CELL}, answers, {_r('accuracy')} FROM overall",
    "frequency_quantiles": f"""SELECT {CELL}, CAST(unnest(range(0, {Q + 1})) AS INT) AS place,
      round(unnest(edges) + 1e-9, 6) AS edge FROM edges""",
    "bin_accuracy": f"SELECT {CELL}, bin, keys, {_r('accuracy')} FROM bins",
    "bin_confidence": f"SELECT {CELL}, bin, {_r('h')} FROM bins",
    "bin_geometry": f"SELECT {CELL}, bin, {_r('low high width mid dilated')} FROM bins",
    "extrapolated_curve": f"SELECT {CELL}, point, {_r('frequency accuracy h')} FROM curve",
    "performance_gap": f"SELECT {CELL}, {_r('q_first q_last gap')} FROM gaps",
    "spearman_corr": f"SELECT {CELL}, {_r('spearman')} FROM spearman",
    "pearson_log_corr": f"SELECT {CELL}, {_r('pearson')} FROM pearson",
    "farthest_points": f"SELECT {CELL}, rank, key_i, key_j, {_r('score log_gap a_i a_j')} FROM far_xy",
    "top_pairs": f"SELECT {CELL}, rank, key_i, key_j, {_r('score log_gap a_i a_j')} FROM far_xz",
    # reports
    "gap_report_arithmetic": gap_report(dims.ARITHMETIC_TASKS, ("x", "xy", "xz"), ("gap",)),
    "gap_report_comparison": gap_report(dims.COMPARISON_TASKS, ("x", "xy", "xz"), ("gap",)),
    "gap_report_timeunit": gap_report(dims.TIME_TASKS, ("x", "xy"), ("gap",)),
    "gap_report_full": gap_report(
        dims.ARITHMETIC_TASKS, ("x", "xy", "xz"), ("q_first", "q_last", "gap"), ratios=("x", "xy")
    ),
    "gap_report_percent": gap_report(dims.ABSTRACT_TASKS, ("x", "xy", "xz"), ("gap",), " * 100"),
    "model_shot_error_bars": f"""SELECT word, model, shots, {_case('model', dims.MODEL_LABELS)} AS model_label, {_r('accuracy')},
      round(accuracy - q_first + 1e-9, 6) AS error_lower, round(q_last - accuracy + 1e-9, 6) AS error_upper
      FROM gaps JOIN overall USING ({CELL}) WHERE key_type = 'x'""",
    "labels": f"""SELECT DISTINCT word, model, {_case('word', dims.MODE_LABELS, "'Time-Coversion-From-' || word")} AS mode,
      {SHORT_MODE} AS summary_mode, {_case('model', dims.MODEL_LABELS)} AS size, {_case('model', dims.MODEL_NAMES)} AS model_name
      FROM graded""",
    "experiment_summary": f"""SELECT {SHORT_MODE} AS mode, shots, {_case('model', dims.MODEL_NAMES)} AS model, {_r('spearman pearson')}
      FROM spearman JOIN pearson USING ({CELL}) WHERE key_type = 'xz'""",
}
QUERIES["write_accuracy_by_key"] = QUERIES["accuracy_by_key"]
for _kt in dims.KEY_TYPES:
    QUERIES[f"lookup_frequency_{_kt}"] = looked_up(_kt)
    if _kt in ("x", "yz", "xyz"):
        QUERIES[f"farthest_points_{_kt}"] = f"SELECT {CELL}, rank, key_i, key_j, {_r('score log_gap a_i a_j')} FROM far_{_kt}"
for _by in ("shots", "models", "both"):
    _label = {
        "models": f"'LM = ' || {_case('model', dims.MODEL_LABELS)}",
        "shots": "'k=' || shots",
        "both": f"'k=' || shots || ', LM=' || {_case('model', dims.MODEL_LABELS)}",
    }[_by]
    QUERIES[f"interpolation_series_by_{_by}"] = f"""SELECT {CELL}, point, {_r('frequency accuracy h')}, {_label} AS label
      FROM curve WHERE key_type = 'x'"""


# From corpus to report: experiments with two and eight shots, three models, two tasks.
_cases = []
for _word in ("mult", "plus"):
    for _shots in (2, 8):
        experiment(f"{_word}_{_shots}", f"{_word}_points", str(_shots))
        _cases.append(f"SELECT seed, CAST({_shots} AS INT) AS shots, '{_word}' AS word, frequency, x, y, z FROM {_word}_{_shots}_cases")
CTES["exp_answers"] = f"""
SELECT seed, shots, model, word, x, y, z, CAST((x * 7 + y * 13 + seed * 5 + shots * 3 + length(model) * 11) % 100
  < 30 + shots * 2 + length(CAST(frequency AS VARCHAR)) * 5 AS INT) AS is_correct
FROM (SELECT seed, shots, word, frequency, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z,
        unnest(['gptjsmall', 'gptjlarge', 'gptj']) AS model FROM ({' UNION ALL '.join(_cases)}))"""
CTES["exp_keys"] = " UNION ALL ".join(key_accuracy(kt, "exp_answers") for kt in ("x", "xy", "xz"))
for _name in ("edges", "bins", "gaps", "overall"):
    CTES[f"exp_{_name}"] = re.sub(r"\b(FROM|JOIN) (keys|edges|bins|gaps|overall)\b", r"\1 exp_\2", CTES[_name])
QUERIES["experiment_report"] = re.sub(
    r"\b(FROM|JOIN) (gaps|overall)\b",
    r"\1 exp_\2",
    gap_report(dims.ARITHMETIC_TASKS, ("x", "xy", "xz"), ("q_first", "q_last", "gap"), ratios=("x", "xy")),
)

# Fits: Newton steps over the answers summed per frequency; twenty of them settle every cell.
STEPS = 20
CTES["suff"] = f"""
SELECT {CELL}, log10(frequency) AS t, CAST(sum(answers) AS DOUBLE) AS n, CAST(sum(correct) AS DOUBLE) AS k
FROM keys GROUP BY {CELL}, log10(frequency)"""
CTES["suff_cells"] = f"""
SELECT {CELL}, CAST(sum(n) AS BIGINT) AS answers, sum(k) AS correct, min(t) AS t_min, max(t) AS t_max FROM suff GROUP BY {CELL}"""
CTES["newton"] = f"""
SELECT 0 AS step, {CELL}, 0.0::DOUBLE AS coef, ln((correct + 0.5) / (answers - correct + 0.5)) AS intercept, t_min, t_max
FROM suff_cells WHERE correct > 0 AND correct < answers
UNION ALL
SELECT step + 1, {CELL}, coef - d * s0, intercept - d * s1, t_min, t_max FROM (
  SELECT *, least(1.0, 4.0 / greatest(abs(s0 * t_min + s1), abs(s0 * t_max + s1), 1e-300)) AS d FROM (
    SELECT *, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS s0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS s1 FROM (
      SELECT step, {CELL}, coef, intercept, t_min, t_max, sum((n * p - k) * t) + coef AS g0, sum(n * p - k) AS g1,
        sum(n * p * (1 - p) * t * t) + 1 AS h00, sum(n * p * (1 - p) * t) AS h01, sum(n * p * (1 - p)) AS h11
      FROM (SELECT z.*, s.t, s.n, s.k, 1 / (1 + exp(-(coef * t + intercept))) AS p FROM newton z JOIN suff s USING ({CELL}))
      WHERE step < {STEPS} GROUP BY step, {CELL}, coef, intercept, t_min, t_max)))"""
CTES["fits"] = f"""
SELECT {CELL}, coef, intercept, answers, c.t_min, c.t_max, CASE WHEN coef IS NOT NULL THEN true END AS converged
FROM suff_cells c LEFT JOIN (SELECT {CELL}, coef, intercept FROM newton WHERE step = {STEPS}) USING ({CELL})"""
CTES["curves"] = f"""
SELECT {CELL}, point, 10.0::DOUBLE ** t AS frequency, 1 / (1 + exp(-coef * t - intercept)) AS probability
FROM (SELECT *, t_min + (t_max - t_min) * point / 9999.0::DOUBLE AS t FROM (SELECT *, unnest(range(0, 10000)) AS point FROM fits))"""
CURVE = f"""
  SELECT {CELL}, count(*) AS points, min(frequency) AS lowest, max(frequency) AS highest, avg(probability) AS mean_probability,
    sum(probability * (point % 7)) / 10000 AS weighted FROM curves GROUP BY {CELL}"""
QUERIES["logistic_fit"] = f"SELECT {CELL}, {_r('coef intercept')}, answers, {_r('t_min t_max')}, converged FROM fits"
QUERIES["logistic_curve"] = f"SELECT {CELL}, points, {_r('lowest highest mean_probability weighted')} FROM ({CURVE})"
for _by in ("shots", "models", "both"):
    _label = {
        "models": f"'LM = ' || {_case('model', dims.MODEL_LABELS)}",
        "shots": "'shots = ' || shots",
        "both": f"'k=' || shots || ', LM' || {_case('model', dims.MODEL_LABELS)}",
    }[_by]
    QUERIES[f"logistic_series_by_{_by}"] = f"""SELECT {CELL}, points, {_r('lowest highest mean_probability weighted')}, {_label} AS label
      FROM ({CURVE}) WHERE key_type = 'x'"""
CTES["series"] = f"""
SELECT {CELL}, 'bars' AS series, CAST(bin AS VARCHAR) AS point, accuracy AS value, low, high FROM bins
UNION ALL SELECT {CELL}, 'errors', CAST(bin AS VARCHAR), accuracy, accuracy - h, accuracy + h FROM bins
UNION ALL SELECT {CELL}, 'interpolation', CAST(point AS VARCHAR), accuracy, accuracy - h, accuracy + h FROM curve
UNION ALL SELECT {CELL}, 'scatter', key, accuracy, NULL, NULL FROM keys
UNION ALL SELECT {CELL}, 'spearman', '0', spearman, NULL, NULL FROM spearman
UNION ALL SELECT {CELL}, 'accuracy', '0', accuracy, NULL, NULL FROM overall
UNION ALL SELECT {CELL}, 'logistic', CAST(point AS VARCHAR), probability, NULL, NULL FROM curves"""
_total = lambda c: f"round(sum({c} * (length(point) % 5 + 1)) + 1e-9, 3) + 0.0 AS {c}"
QUERIES["freq_accuracy_series"] = f"""SELECT {CELL}, series, count(*) AS n, {_total('value')}, {_total('low')}, {_total('high')}
  FROM series GROUP BY {CELL}, series"""
# The posterior by quadrature: mode, a wide grid there, its moments, a finer grid that follows them.
CTES["bsuff"] = f"""
SELECT {CELL}, ln(frequency) AS t, CAST(sum(answers) AS DOUBLE) AS n, CAST(sum(correct) AS DOUBLE) AS k
FROM keys GROUP BY {CELL}, ln(frequency)"""
CTES["bcells"] = f"SELECT {CELL}, sum(n) AS answers, sum(k) AS correct, min(t) AS t_min, max(t) AS t_max FROM bsuff GROUP BY {CELL}"
CTES["newton_prior"] = f"""
SELECT 0 AS step, {CELL}, 0.0::DOUBLE AS coef, ln((correct + 0.5) / (answers - correct + 0.5)) AS intercept, t_min, t_max,
  0.0::DOUBLE AS h00, 0.0::DOUBLE AS h01, 0.0::DOUBLE AS h11 FROM bcells
UNION ALL
SELECT step + 1, {CELL}, coef - d * s0, intercept - d * s1, t_min, t_max, h00, h01, h11 FROM (
  SELECT *, least(1.0, 4.0 / greatest(abs(s0 * t_min + s1), abs(s0 * t_max + s1), 1e-300)) AS d FROM (
    SELECT *, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS s0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS s1 FROM (
      SELECT step, {CELL}, coef, intercept, t_min, t_max, sum((n * p - k) * t) + 0.001 * coef AS g0, sum(n * p - k) + 0.001 * intercept AS g1,
        sum(n * p * (1 - p) * t * t) + 0.001 AS h00, sum(n * p * (1 - p) * t) AS h01, sum(n * p * (1 - p)) + 0.001 AS h11
      FROM (SELECT z.*, s.t, s.n, s.k, 1 / (1 + exp(-(coef * t + intercept))) AS p FROM newton_prior z JOIN bsuff s USING ({CELL}))
      WHERE step < {2 * STEPS} GROUP BY step, {CELL}, coef, intercept, t_min, t_max)))"""
CTES["bmode"] = f"""
SELECT {CELL}, coef AS m0, intercept AS m1, t_min, t_max, h11 / det AS v00, -h01 / det AS v01, h00 / det AS v11
FROM (SELECT *, h00 * h11 - h01 * h01 AS det FROM newton_prior WHERE step = {2 * STEPS})"""


def _weighed(centre: str, step: float) -> str:
    sinh = lambda i: f"((exp({i} * {step}::DOUBLE) - exp(-{i} * {step}::DOUBLE)) / 2)"
    cosh = lambda i: f"((exp({i} * {step}::DOUBLE) + exp(-{i} * {step}::DOUBLE)) / 2)"
    return f"""
SELECT {CELL}, m0, m1, t_min, t_max, d0, d1, w / sum(w) OVER (PARTITION BY {CELL}) AS weight FROM (
  SELECT *, exp(lp - max(lp) OVER (PARTITION BY {CELL})) * {cosh('i')} * {cosh('j')} AS w FROM (
    SELECT {CELL}, i, j, m0, m1, t_min, t_max, d0, d1, sum(k * eta - n * (greatest(eta, 0) + ln(1 + exp(-abs(eta)))))
      - 0.0005 * ((m0 + d0) * (m0 + d0) + (m1 + d1) * (m1 + d1)) AS lp
    FROM (SELECT *, (m0 + d0) * t + m1 + d1 AS eta FROM (
      SELECT *, l00 * {sinh('i')} AS d0, v01 / l00 * {sinh('i')} + sqrt(v11 - v01 * v01 / v00) * {sinh('j')} AS d1
      FROM (SELECT *, sqrt(v00) AS l00 FROM {centre}), range(-12, 13) x(i), range(-12, 13) y(j)) JOIN bsuff USING ({CELL}))
    GROUP BY {CELL}, i, j, m0, m1, t_min, t_max, d0, d1))"""


_MOMENTS = f"""
SELECT {CELL}, m0 + e0 AS m0, m1 + e1 AS m1, t_min, t_max, s00 - e0 * e0 AS v00, s01 - e0 * e1 AS v01, s11 - e1 * e1 AS v11 FROM (
  SELECT {CELL}, m0, m1, t_min, t_max, sum(weight * d0) AS e0, sum(weight * d1) AS e1, sum(weight * d0 * d0) AS s00,
    sum(weight * d0 * d1) AS s01, sum(weight * d1 * d1) AS s11 FROM {{0}} GROUP BY {CELL}, m0, m1, t_min, t_max)"""
CTES["bcoarse"] = _weighed("bmode", 0.365)
CTES["bcentre"] = _MOMENTS.format("bcoarse")
CTES["bfine"] = _weighed("bcentre", 0.25)
CTES["bmoments"] = _MOMENTS.format("bfine")
QUERIES["bayes_logistic"] = f"""SELECT {CELL}, CAST(10000 AS BIGINT) AS samples, {_r('beta beta_sd alpha alpha_sd')}, true AS mixed, true AS near FROM (
  SELECT {CELL}, -m0 AS beta, sqrt(v00) AS beta_sd, -m1 AS alpha, sqrt(v11) AS alpha_sd FROM bmoments)"""


def _quantile(q: str) -> str:
    below, above = f"FILTER (pos <= {q})", f"FILTER (pos > {q})"
    return f"""CASE WHEN max(pos) {below} IS NULL THEN min(eta) {above} WHEN min(pos) {above} IS NULL THEN max(eta) {below}
      ELSE max(eta) {below} + ({q} - max(pos) {below}) / (min(pos) {above} - max(pos) {below}) * (min(eta) {above} - max(eta) {below}) END"""


QUERIES["posterior_band"] = f"""SELECT {CELL}, point, {_r('frequency mean low high')}, true AS near FROM (
  SELECT {CELL}, CAST(point AS INTEGER) AS point, exp(t) AS frequency, mean, 1 / (1 + exp(-low)) AS low, 1 / (1 + exp(-high)) AS high FROM (
    SELECT {CELL}, point, t, sum(weight / (1 + exp(-eta))) AS mean, {_quantile('0.025')} AS low, {_quantile('0.975')} AS high FROM (
      SELECT *, sum(weight) OVER (PARTITION BY {CELL}, point ORDER BY eta ROWS UNBOUNDED PRECEDING) - weight / 2 AS pos FROM (
        SELECT *, (m0 + d0) * t + m1 + d1 AS eta FROM (
          SELECT *, t_min - 5 + (t_max - t_min + 10) * point / 99.0::DOUBLE AS t FROM bfine, range(0, 100) p(point))))
    GROUP BY {CELL}, point, t))"""


def statement(query: str) -> str:
    """The query with the CTEs it needs, in order of their dependencies."""
    needed: list[str] = []
    open_names: list[str] = []

    def visit(sql: str) -> None:
        words = set(re.findall(r"(?:FROM|JOIN)\s+\(*\s*(\w+)", sql)) | set(re.findall(r",\s*(\w+) r\(", sql))
        for name in CTES:
            if name in words and name not in needed and name not in open_names:
                open_names.append(name)
                visit(CTES[name])
                needed.append(name)

    visit(query)
    if not needed:
        return query
    kept = lambda name: "" if name.startswith("newton") else "MATERIALIZED "
    defined = ",\n".join(f"{name} AS {kept(name)}({CTES[name]})" for name in needed)
    return f"WITH {'RECURSIVE ' if any(name.startswith('newton') for name in needed) else ''}{defined}\n{query}"


def oracle_sql() -> dict[str, str]:
    return {name: statement(sql) for name, sql in QUERIES.items()}
