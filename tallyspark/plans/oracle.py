"""The same queries in DuckDB's SQL, to compare results with."""

from __future__ import annotations

from tallyspark.functions.identity import PACK_WORDS, STOP_WORDS
from tallyspark.functions.text import FOOTERS, LABEL_WORDS, UNIT_WORDS
from tallyspark.operators.coverage import NAMED_CLAIMS, NAMED_ROWS
from tallyspark.operators.infer import CODE_WORDS, CURRENCIES, DATE_WORDS, NAME_WORDS, PRICE_WORDS, QTY_WORDS, STRONG_CODE_WORDS
from tallyspark.plans import sentences
from tallyspark.plans.sentences import filled_sql
from tallyspark.plans.settings import FUZZY_POOL, STATUSES, STORED
from tallyspark.plans.tables import CLAIMS, COSTING


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def norm(x: str) -> str:
    s = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    s = rf"regexp_replace({s}, '([0-9]+)\s*x\s*([0-9]+)(?:\s*(x)\s*([0-9]+))?(?:\s*(x)\s*([0-9]+))?', '\1x\2\3\4\5\6', 'g')"
    s = rf"regexp_replace({s}, '\b([0-9]{{1,3}}) ([0-9]{{1,3}}) ([0-9]{{1,3}})\b', '\1x\2x\3', 'g')"
    for pattern, word in (("hi lux", "hilux"), ("(frt|fr)", "front"), ("rr", "rear"), ("assy", "assembly"), ("(lh|lhs)", "left"), ("(rh|rhs)", "right"), ("hi", "hilux")):
        s = rf"regexp_replace({s}, '\b{pattern}\b', '{word}', 'g')"
    return s


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _ordered(x: str) -> str:
    """Distinct in order; ``x`` is a column."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def price_cte(name: str, source: str, columns: str) -> str:
    """``source`` with ``raw_price`` read as a typed price into ``price``."""
    return rf"""
{name}_p1 AS (SELECT *, trim(raw_price) AS t, regexp_matches(trim(raw_price), '^\(.*\)$') AS paren FROM {source}),
{name}_p2 AS (SELECT *, CASE WHEN paren THEN substr(t, 2, length(t) - 2) ELSE t END AS s1 FROM {name}_p1),
{name}_p3 AS (SELECT *, regexp_replace(s1, '[^0-9.,-]', '', 'g') AS s2,
  regexp_matches(s1, '[0-9]\s*/\s*[0-9]') OR length(s1) - length(replace(s1, '-', '')) >= 2 OR regexp_matches(s1, '[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{2,4}}') AS refused FROM {name}_p2),
{name}_p4 AS (SELECT *, paren OR s2 LIKE '%-' OR s2 LIKE '-%' AS neg, regexp_replace(regexp_replace(s2, '-$', ''), '^-', '') AS s3 FROM {name}_p3),
{name}_p5 AS (SELECT *, CASE
  WHEN contains(s3, ',') AND contains(s3, '.') THEN CASE WHEN regexp_matches(s3, ',[^.,]*$') THEN replace(replace(s3, '.', ''), ',', '.') ELSE replace(s3, ',', '') END
  WHEN contains(s3, ',') THEN CASE WHEN length(s3) - length(replace(s3, ',', '')) = 1 AND NOT regexp_matches(s3, ',[^,]{{3}}$') THEN replace(s3, ',', '.') ELSE replace(s3, ',', '') END
  WHEN length(s3) - length(replace(s3, '.', '')) >= 2 AND NOT regexp_matches(s3, '^[^.]{{0,2}}\.[^.]{{0,2}}\.([^.]{{4}}|[^.]{{0,2}})$') THEN replace(s3, '.', '')
  ELSE s3 END AS s4 FROM {name}_p4),
{name}_p6 AS (SELECT *, TRY_CAST(regexp_extract(s4, '^([0-9]*\.?[0-9]*)', 1) AS DOUBLE) AS num FROM {name}_p5),
{name} AS (SELECT {columns}, CASE WHEN t IS NULL OR t = '' OR refused OR NOT regexp_matches(s4, '[0-9]') THEN NULL WHEN neg AND num <> 0 THEN -num ELSE num END AS price FROM {name}_p6)"""


def part_code(x: str) -> str:
    c = f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"
    return f"CASE WHEN length({c}) BETWEEN 4 AND 24 AND regexp_matches({c}, '[0-9]') THEN {c} END"


def text_codes_cte(name: str, source: str) -> str:
    """``source`` (with ``raw_name``) and ``tcodes``: the codes in the text."""
    return rf"""
{name}_c1 AS (SELECT *, upper(raw_name) AS u FROM {source}),
{name}_c2 AS (SELECT *, list_concat(list_concat(regexp_extract_all(u, '\b([0-9]{{5,6}}-[A-Z0-9]{{2,10}})\b', 1), regexp_extract_all(u, '\b([A-Z]{{1,4}}[-\s][0-9]{{3,6}}[A-Z0-9]*)\b', 1)),
  list_concat(regexp_extract_all(u, '\b([A-Z]{{1,5}}[0-9]{{3,}}[A-Z0-9]*)\b', 1),
  list_filter(regexp_extract_all(u, '\b([0-9]{{2,6}}-[0-9]{{3,6}})\b', 1), lambda c: NOT regexp_matches(c, '(^|-)(19|20)[0-9]{{2}}(-|$)')))) AS found FROM {name}_c1),
{name}_c3 AS (SELECT *, list_filter(list_transform(found, lambda c: regexp_replace(c, '[^A-Z0-9]', '', 'g')), lambda c: length(c) BETWEEN 4 AND 24 AND regexp_matches(c, '[0-9]')) AS shaped FROM {name}_c2),
{name} AS (SELECT * EXCLUDE (u, found, shaped), list_filter({_ordered("shaped")}, lambda c: regexp_extract(c, '^([A-Z]*)', 1) NOT IN ({_list(PACK_WORDS)})) AS tcodes FROM {name}_c3)"""


def words(cleaned: str, codes: str) -> str:
    """Content words; ``codes`` is a column.  The descriptions here hold no sizes."""
    used = f"list_concat(list_transform({codes}, lambda c: lower(c)), flatten(list_transform({codes}, lambda c: regexp_extract_all(lower(c), '(^[a-z]+|[0-9]+[a-z0-9]*)', 1))))"
    kept = f"list_filter({tokens(cleaned)}, lambda w: w NOT IN ({_list(STOP_WORDS)}) AND NOT regexp_matches(w, '^[0-9]+(x[0-9]+)+$'))"
    return f"list_filter({kept}, lambda w: NOT list_contains({used}, w))"


def non_item(c: str) -> str:
    return rf"({c} = '' OR {c} IN ({_list(FOOTERS)}) OR NOT regexp_matches({c}, '[a-z]') OR regexp_matches({c}, '^(page|pg|p)\s*[0-9]+$') OR regexp_matches({c}, '^((grand|sub)\s+)*total(\s+[0-9][0-9,.]*)?$'))"


def leading(c: str) -> str:
    """A normalised description without its stray front; ``c`` is a column."""
    t = tokens(c)
    code = lambda s: f"(length({s}) >= 4 AND regexp_matches({s}, '^[a-z][a-z0-9]*[0-9][a-z0-9]*$') AND regexp_matches({s}, '[a-z]{{2}}'))"
    rest = lambda k: f"nullif(array_to_string(list_slice({t}, {k + 1}, 100000), ' '), '')"
    return f"""CASE WHEN len({t}) < 2 OR {t}[1] IN ({_list(UNIT_WORDS)}) THEN NULL
      WHEN len({t}) >= 3 AND NOT regexp_matches({t}[1], '[0-9]') AND {code(f"({t}[1] || {t}[2])")} THEN {rest(2)}
      WHEN {code(f"{t}[1]")} THEN {rest(1)} WHEN {t}[1] IN ({_list(LABEL_WORDS)}) THEN {rest(1)} END"""


def _split(x: str) -> str:
    return rf"string_split_regex({x}, '\s+')"


def _unwrap(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[(\[{{]+', ''), '[)\]}}]+$', '')"


def _code_like(x: str) -> str:
    return f"(NOT regexp_matches({x}, '^[0-9]+(x[0-9]+)+$') AND regexp_matches({x}, '^[A-Za-z0-9]+([-/][A-Za-z0-9]+)*$') AND regexp_matches({x}, '[0-9]'))"


def _first_like(x: str) -> str:
    return _code_like(_unwrap(x))


def _last_like(x: str) -> str:
    u = _unwrap(x)
    return f"({_code_like(u)} AND (regexp_matches({u}, '[A-Za-z]') OR length({u}) >= 5))"


def strip(x: str, mode: str) -> str:
    t = _split(x)
    tail, head = f"array_to_string(list_slice({t}, 2, 100000), ' ')", f"array_to_string(list_slice({t}, 1, len({t}) - 1), ' ')"
    out = {
        "none": x,
        "firstToken": tail,
        "lastToken": head,
        "auto": f"CASE WHEN {_first_like(f'{t}[1]')} THEN {tail} WHEN {_last_like(f'{t}[-1]')} THEN {head} ELSE {x} END",
        "regex": rf"trim(regexp_replace(regexp_replace({x}, '[A-Z]+-[0-9]+', ' '), '\s+', ' ', 'g'))",
    }[mode]
    return f"CASE WHEN len({t}) < 2 OR ({out}) = '' THEN {x} ELSE {out} END"


def grams(p: str) -> str:
    return f"list_transform(range(1, greatest(length({p}), 1)), lambda i: substr({p}, i, 2))"


def dice(a: str, b: str) -> str:
    pa, pb = f"replace({a}, ' ', '')", f"replace({b}, ' ', '')"
    shared = f"len(list_filter({grams(pb)}, lambda g: list_contains({grams(pa)}, g)))"
    return f"""CAST(CASE WHEN {pa} = '' OR {pb} = '' THEN 0 WHEN {pa} = {pb} THEN 100 WHEN length({pa}) < 2 OR length({pb}) < 2 THEN 0
      ELSE floor((2 * {shared}) / CAST(length({pa}) - 1 + length({pb}) - 1 AS DOUBLE) * 100 + 0.5) END AS INTEGER)"""


def penalty(a: str, b: str) -> str:
    ta, tb = tokens(a), tokens(b)
    apart = f"(len(list_filter({ta}, lambda x: x = t)) - len(list_filter({tb}, lambda x: x = t)))"
    every = f"list_distinct(list_concat({ta}, {tb}))"
    n = f"coalesce(list_sum(list_transform({every}, lambda t: abs{apart})), 0)"
    wordy = f"len(list_filter({every}, lambda t: {apart} <> 0 AND NOT regexp_matches(t, '[0-9]'))) > 0"
    return f"CAST(CASE WHEN {wordy} OR {n} = 0 THEN 0 ELSE least(45, 22 * {n}) END AS INTEGER)"


def engine(a: str, b: str) -> str:
    return f"CAST(CASE WHEN {dice(a, b)} = 100 THEN 100 ELSE greatest(0, {dice(a, b)} - {penalty(a, b)}) END AS INTEGER)"


def _round2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def _micro(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000 + 0.5) AS HUGEINT)"


def _total(x: str, where: str = "") -> str:
    """The exact sum of amounts in millionths."""
    return f"(CAST(sum({_micro(x)}){f' FILTER ({where})' if where else ''} AS DOUBLE) / 1000000)"


def _mean(x: str) -> str:
    return f"({_total(x)} / count({x}))"


def _quotient(value: str, units: str) -> str:
    """To cents, exact halves upwards."""
    return f"(CAST(({value} * 200 + {units} * 1000000) // ({units} * 2000000) AS DOUBLE) / 100)"


SIDES = f"claims AS ({CLAIMS.replace('{', '').replace('}', '')}), costing AS ({COSTING.replace('{', '').replace('}', '')})"

PREPARED = f"""{SIDES},
{price_cte("a_priced", "claims", "row_num, raw_name, raw_code, raw_qty")},
{text_codes_cte("a_coded", "a_priced")},
a1 AS (SELECT *, {part_code("raw_code")} AS own_code, {norm(strip("raw_name", "firstToken"))} AS cleaned, {norm("raw_name")} AS whole FROM a_coded),
a2 AS (SELECT *, CASE WHEN own_code IS NULL THEN tcodes ELSE list_concat([own_code], tcodes) END AS both_codes FROM a1),
a3 AS (SELECT *, {_ordered("both_codes")} AS codes FROM a2),
a AS (SELECT row_num AS a_id, raw_name, cleaned, price AS a_price, raw_qty AS aq, codes, own_code, {words("whole", "codes")} AS words, NOT {non_item("cleaned")} AS live FROM a3),
{price_cte("b_priced", "costing", "row_num, raw_name, raw_code, raw_qty")},
{text_codes_cte("b_coded", "b_priced")},
b1 AS (SELECT *, {part_code("raw_code")} AS own_code, {norm("raw_name")} AS cleaned FROM b_coded),
b2 AS (SELECT *, CASE WHEN own_code IS NULL THEN tcodes ELSE list_concat([own_code], tcodes) END AS both_codes FROM b1),
b3 AS (SELECT *, {_ordered("both_codes")} AS codes FROM b2),
b AS (SELECT row_num AS b_row, raw_name, raw_code, cleaned, {leading("cleaned")} AS alt, price AS b_price, raw_qty AS qty, codes, own_code, {words("cleaned", "codes")} AS words FROM b3),
keys AS (SELECT * FROM (SELECT cleaned AS key, 0 AS key_rank, b_row FROM b UNION ALL SELECT alt, 1, b_row FROM b WHERE alt IS NOT NULL AND alt <> cleaned) WHERE NOT {non_item("key")}),
first_rows AS (SELECT key, key_rank, b_row FROM keys QUALIFY row_number() OVER (PARTITION BY key ORDER BY key_rank, b_row) <= {STORED}),
a_codes AS (SELECT a_id, cleaned, words, own_code, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS code_pos FROM a WHERE live),
b_codes AS (SELECT b_row, cleaned, words, own_code, unnest(codes) AS code FROM b),
pairs AS (SELECT a_id, b_row, code_pos, x.code, x.cleaned AS ac, y.cleaned AS bc, x.words AS aw, y.words AS bw,
    coalesce(x.code = y.own_code, false) OR coalesce(x.code = x.own_code, false) AS strong
  FROM a_codes x JOIN b_codes y ON x.code = y.code QUALIFY row_number() OVER (PARTITION BY a_id, b_row ORDER BY code_pos) = 1),
hits AS (SELECT a_id, b_row, code_pos, code, CASE WHEN (CASE WHEN len(aw) = 0 OR len(bw) = 0 THEN 1.0 ELSE len(list_intersect(aw, bw)) / CAST(len(list_distinct(list_concat(aw, bw))) AS DOUBLE) END) < 0.3
    THEN 'conflict' WHEN strong THEN 'strong' ELSE 'weak' END AS kind, {engine("ac", "bc")} AS sim FROM pairs)"""

IDF = """descs AS (SELECT key, min(row(key_rank, b_row)) AS first_at FROM keys GROUP BY key),
desc_tokens AS (SELECT key, first_at, unnest(list_distinct(string_split(key, ' '))) AS token FROM descs),
idf AS (SELECT token, count(*) AS df, CAST(floor(ln(1 + (SELECT count(*) FROM descs) / CAST(count(*) AS DOUBLE)) * 1000000 + 0.5) AS BIGINT) AS idf_micro FROM desc_tokens GROUP BY token)"""


def fuzzy_cte(source: str) -> str:
    """Scores of the distinct ``cleaned`` of ``source``."""
    return f"""{IDF},
claim_keys AS (SELECT DISTINCT cleaned AS a_key FROM {source}),
key_lists AS (SELECT a_key, {tokens("a_key")} AS ts FROM claim_keys),
key_sets AS (SELECT a_key, {_ordered("ts")} AS ts FROM key_lists),
key_tokens AS (SELECT a_key, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS tok_pos FROM key_sets),
touched AS (SELECT a_key, key, sum(idf_micro) AS weight, min(tok_pos) AS touch, any_value(first_at) AS first_at FROM key_tokens JOIN idf USING (token) JOIN desc_tokens USING (token) GROUP BY a_key, key),
pool0 AS (SELECT *, row_number() OVER (PARTITION BY a_key ORDER BY weight DESC, touch, first_at) AS n, row_number() OVER (PARTITION BY a_key ORDER BY touch, first_at) AS t, count(*) OVER (PARTITION BY a_key) AS c FROM touched),
pool AS (SELECT a_key, key, CASE WHEN c > {FUZZY_POOL} THEN n ELSE t END AS pool_pos FROM pool0 WHERE n <= {FUZZY_POOL}),
scored AS (SELECT *, {engine("a_key", "key")} AS sim FROM pool),
scores AS (SELECT * FROM scored WHERE sim >= 60)"""


RESULTS = f"""{PREPARED},
open1 AS (SELECT a_id, cleaned FROM a WHERE live AND a_id NOT IN (SELECT a_id FROM hits WHERE kind <> 'weak')),
exact AS (SELECT a_id, b_row, key_rank FROM open1 JOIN first_rows ON cleaned = key),
open2 AS (SELECT a_id, cleaned FROM open1 WHERE a_id NOT IN (SELECT a_id FROM exact)),
{fuzzy_cte("open2")},
fz AS (SELECT a_key, b_row, min(row(-sim, pool_pos, key_rank, b_row)) AS p, max(sim) AS sim FROM scores JOIN first_rows USING (key) GROUP BY a_key, b_row),
fz_top AS (SELECT * FROM fz QUALIFY row_number() OVER (PARTITION BY a_key ORDER BY p) <= {STORED}),
named AS (SELECT a_id, b_row, 100 AS sim, row(0, 0, key_rank, b_row) AS o FROM exact UNION ALL SELECT a_id, b_row, sim, p FROM open2 JOIN fz_top ON cleaned = a_key),
grouped AS (
  SELECT n.a_id, n.b_row, n.sim, n.o, h.code, 0 AS grp FROM named n LEFT JOIN hits h ON h.a_id = n.a_id AND h.b_row = n.b_row AND h.kind = 'weak'
  UNION ALL
  SELECT h.a_id, h.b_row, h.sim, row(0, 0, code_pos, h.b_row), h.code, CASE kind WHEN 'strong' THEN 0 WHEN 'weak' THEN 1 ELSE 2 END FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.a_id = h.a_id AND n.b_row = h.b_row)),
cand AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY grp, sim DESC, o) AS pos FROM grouped QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY grp, sim DESC, o) <= {STORED}),
told AS (SELECT a_id, count(*) FILTER (kind = 'strong') AS n_strong, count(*) FILTER (kind = 'conflict') AS n_conflict FROM hits GROUP BY a_id),
sized AS (SELECT a_id, count(*) AS n_candidates FROM cand GROUP BY a_id),
r0 AS (SELECT a.*, coalesce(n_strong, 0) AS n_strong, coalesce(n_conflict, 0) AS n_conflict, coalesce(n_candidates, 0) AS n_candidates, t.b_row AS top_row, t.sim AS top_sim, b.b_price AS top_price, b.raw_name AS top_name, b.cleaned AS top_cleaned
  FROM a LEFT JOIN told USING (a_id) LEFT JOIN sized USING (a_id) LEFT JOIN (SELECT * FROM cand WHERE pos = 1 AND grp <= 1) t ON t.a_id = a.a_id LEFT JOIN b ON b.b_row = t.b_row),
r1 AS (SELECT *, CASE WHEN NOT live THEN 'UNMATCHED' WHEN top_row IS NULL AND n_conflict > 0 THEN 'CONFLICT' WHEN n_strong > 0 THEN 'CONFIRMED' WHEN top_row IS NULL THEN 'UNMATCHED' WHEN top_sim >= 100 THEN 'STRONG' ELSE 'PROBABLE' END AS status FROM r0),
r AS (SELECT a_id, raw_name, cleaned, a_price, aq, codes, status, n_candidates, n_conflict, live, CASE status WHEN 'CONFIRMED' THEN 'code' WHEN 'STRONG' THEN 'exact' WHEN 'PROBABLE' THEN 'fuzzy' END AS method,
  top_sim AS score, top_row AS b_row, top_price AS b_price, top_name AS b_name, top_cleaned AS b_cleaned, {_round2("top_price - a_price")} AS difference FROM r1)"""

VALUES = f"""{RESULTS},
records AS (SELECT c.a_id, b.b_price AS price, b.qty FROM cand c JOIN b USING (b_row)),
v0 AS (SELECT a_id, count(*) FILTER (price > 0) AS "count", count(*) AS n, min(price) FILTER (price > 0) AS lowest, max(price) FILTER (price > 0) AS highest,
  sum({_micro("price")} * {_micro("qty")}) FILTER (price > 0 AND qty > 0) AS pq, sum({_micro("qty")}) FILTER (price > 0 AND qty > 0) AS q, sum({_micro("price")}) FILTER (price > 0) AS p FROM records GROUP BY a_id),
v AS (SELECT a_id, "count", n - "count" AS zero_count, lowest, highest, CASE WHEN q > 0 THEN {_quotient("pq", "q")} WHEN "count" > 0 THEN {_quotient("p", 'CAST("count" AS HUGEINT)')} END AS weighted_avg FROM v0)"""


def flagged(depreciation: float) -> str:
    return f"""{VALUES},
f AS (SELECT r.*, v.* EXCLUDE (a_id), CASE WHEN coalesce("count", 0) = 0 OR a_price IS NULL THEN 'unpriced'
  WHEN a_price > highest THEN CASE WHEN {depreciation} > 0 AND (a_price - highest) / a_price * 100 <= {depreciation} THEN 'above-allowed' ELSE 'above' END
  WHEN a_price < lowest THEN 'below' ELSE 'in-range' END AS flag FROM r LEFT JOIN v ON r.a_id = v.a_id)"""


SUPPORT = f"""{RESULTS},
links AS (SELECT DISTINCT c.b_row, r.a_id, r.raw_name, r.a_price FROM cand c JOIN r USING (a_id) WHERE r.status IN ('CONFIRMED', 'STRONG'))"""

_EXT = _round2("qty * b_price")
LEDGER = f"""{SUPPORT},
s AS (SELECT b_row, list(row(a_id, raw_name, a_price) ORDER BY a_id) AS rows, min(a_id) AS first_row, first(a_price ORDER BY a_id) FILTER (a_price IS NOT NULL) AS ref FROM links GROUP BY b_row),
lines AS (SELECT b.b_row, b.raw_name AS description, coalesce(b.raw_code, '') AS part_code, fa.aq AS claimed_qty, b.qty AS assessed_qty, b.b_price AS unit_price, coalesce({_EXT}, b_price) AS total_cost,
  CASE WHEN len(rows) > {NAMED_CLAIMS} THEN ' and ' || (len(rows) - {NAMED_CLAIMS}) || ' more' ELSE '' END AS more,
  CASE WHEN s.b_row IS NULL THEN 'Unmatched' ELSE 'Paired → A' || array_to_string(list_transform(rows[:{NAMED_CLAIMS}], lambda x: CAST(x[1] AS VARCHAR)), ', A') || more END AS status,
  coalesce(array_to_string(list_transform(rows[:{NAMED_CLAIMS}], lambda x: CAST(x[1] AS VARCHAR)), ', ') || more, '') AS claim_rows,
  coalesce(array_to_string(list_transform(rows[:{NAMED_CLAIMS}], lambda x: x[2]), ' | ') || more, '') AS claim_items,
  s.b_row IS NOT NULL AS matched, CASE WHEN ref <> 0 THEN abs(b_price - ref) / ref * 100 END AS diff_pct
  FROM b LEFT JOIN s ON s.b_row = b.b_row LEFT JOIN a fa ON fa.a_id = s.first_row)"""

AUDIT = f"""SELECT a_id AS a_row, raw_name AS a_item_name, cleaned AS a_cleaned_name, array_to_string(codes, ', ') AS a_part_codes, a_price, b_row, coalesce(b_name, '') AS b_matched_name,
  coalesce(f.b_cleaned, '') AS b_cleaned_name, aq AS claimed_qty, (SELECT qty FROM b WHERE b.b_row = f.b_row) AS assessed_qty, b_price, "count" AS records, lowest, highest, weighted_avg AS wtd_avg, difference,
  {_round2("CASE WHEN a_price <> 0 THEN abs(difference) / a_price * 100 END")} AS gap_pct, score, coalesce(method, '') AS method,
  upper(substr(status, 1, 1)) || lower(substr(status, 2)) AS status FROM f"""

_REVIEW = "list_position(['CONFLICT', 'PROBABLE', 'UNMATCHED', 'STRONG', 'CONFIRMED'], status)"
_ORDERS = (
    ("row", "a_id", "DESC"), ("name", "lower(raw_name)", "ASC"), ("aPrice", "a_price", "DESC NULLS LAST"), ("bPrice", "b_price", "ASC NULLS FIRST"),
    ("diff", "difference", "ASC NULLS FIRST"), ("score", "score", "DESC NULLS LAST"), ("status", _REVIEW, "ASC"),
)
_STATUS_ROWS = "(SELECT unnest([" + ", ".join(f"'{s}'" for s in STATUSES) + "]) AS status)"
_NAMES = f"{SIDES}, names AS (SELECT row_num, raw_name FROM claims UNION ALL SELECT row_num, raw_name FROM costing)"
_NEXT = "pairs AS (SELECT x.p_partkey AS k, lower(x.p_type || ' ' || x.p_name || ' ' || x.p_size || 'mm') AS a, lower(y.p_type || ' ' || y.p_name || ' ' || y.p_size || 'mm') AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 5)"
_PAIRS = f"{RESULTS}, rp AS (SELECT r.a_id, r.raw_name AS a_name, b.raw_name AS b_name, c.b_row AS first_row, b.b_price AS first_price FROM r JOIN cand c ON c.a_id = r.a_id AND c.pos = 1 JOIN b ON b.b_row = c.b_row WHERE status IN ('PROBABLE', 'CONFLICT'))"
_DECIDE = """CASE WHEN p >= 0.8 THEN 'MATCH' WHEN p <= 0.2 THEN 'NOT_MATCH' ELSE 'UNCERTAIN' END AS verdict,
  CAST(floor((CASE WHEN p >= 0.8 THEN p WHEN p <= 0.2 THEN 1 - p ELSE greatest(p, 1 - p) END) * 100 + 0.5) AS BIGINT) AS confidence"""
# Some price cells are missing, some are whole numbers as dates are stored, some plain numbers.
_CHECKED = f"""{SIDES}, cells AS (SELECT row_num, CASE WHEN row_num % 97 = 0 THEN NULL ELSE regexp_replace(raw_name, '^[^ ]+ ', '') END AS name,
  CASE WHEN row_num % 53 = 0 THEN 'null' WHEN row_num % 41 = 0 OR row_num % 7 = 3 THEN 'num' ELSE 'str' END AS kind, raw_price AS typed,
  CASE WHEN row_num % 41 = 0 THEN 45000 + row_num % 1000 ELSE row_num / 4.0 END AS number FROM claims),
shown AS (SELECT *, CASE kind WHEN 'null' THEN NULL WHEN 'num' THEN CAST(CAST(number AS DOUBLE) AS VARCHAR) ELSE typed END AS raw_price FROM cells),
{price_cte("named", "shown", "row_num, raw_price, name, kind, number")}"""
_KEY = "ltrim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))"
_DUPS = f"{_CHECKED}, keyed AS (SELECT *, {_KEY} AS key FROM named WHERE name IS NOT NULL AND trim(name) <> ''), kept AS (SELECT * FROM keyed WHERE NOT {non_item('trim(key)')})"
_OVERLAP = f"CASE WHEN len({tokens('a')}) = 0 OR len({tokens('b')}) = 0 THEN 1.0 ELSE len(list_intersect({tokens('a')}, {tokens('b')})) / CAST(len(list_distinct(list_concat({tokens('a')}, {tokens('b')}))) AS DOUBLE) END"
_SIDE = "CAST(p_partkey * {} % 90 + 1 AS VARCHAR)"
_SHAPE = rf"^[(-]*\s*[₱$€£¥]?\s*({'|'.join(CURRENCIES)})?\s*[-+]?[0-9][0-9.,\s]*\)?$"

ORACLE_SQL: dict[str, str] = {
    "normalize_desc": f"WITH {_NAMES} SELECT row_num, {norm('raw_name')} AS cleaned FROM names",
    "normalize_folded": f"WITH {_NAMES} SELECT row_num, {norm('raw_name')} AS cleaned FROM names",
    "normalize_benchmark": f"SELECT item_id, {norm('text')} AS cleaned FROM benchmark",
    "normalize_documents": f"SELECT doc_id, {norm("coalesce(text, '')")} AS cleaned FROM documents",
    "clean_price": f"WITH {SIDES}, typed AS (SELECT row_num, raw_price FROM claims UNION ALL SELECT row_num, raw_price FROM costing), {price_cte('priced', 'typed', 'row_num, raw_price')} SELECT row_num, raw_price, price FROM priced",
    "part_code": f"WITH {SIDES} SELECT row_num, {part_code('raw_code')} AS code FROM costing",
    "text_codes": f"WITH {_NAMES}, {text_codes_cte('coded', 'names')} SELECT row_num, array_to_string(tcodes, ',') AS codes FROM coded",
    "dimensions": f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 AND false THEN '' ELSE {_SIDE.format(7)} || 'x' || {_SIDE.format(11)} || 'x' || {_SIDE.format(13)} END AS dims FROM part",
    "content_words": f"WITH {PREPARED} SELECT b_row AS row_num, array_to_string(words, ' ') AS words FROM b",
    "strip_code_modes": f"WITH {_NAMES} SELECT row_num, "
    + ", ".join(f"{strip('raw_name', m)} AS by_{m.lower()}" for m in ("none", "firstToken", "lastToken", "auto", "regex"))
    + " FROM names",
    "strip_leading_code": f"WITH {_NAMES}, cl AS (SELECT row_num, {norm('raw_name')} AS c FROM names) SELECT row_num, {leading('c')} AS alt FROM cl",
    "non_item_filter": f"WITH {SIDES}, cl AS (SELECT row_num, {norm(strip('raw_name', 'firstToken'))} AS cleaned FROM claims) SELECT row_num, cleaned FROM cl WHERE {non_item('cleaned')}",
    "code_mode_detect": f"""WITH {SIDES}, w AS (SELECT {_split("raw_name")} AS t FROM claims), s AS (SELECT t[1] AS f, t[-1] AS l FROM w WHERE len(t) >= 2),
c AS (SELECT count(*) AS total, count(*) FILTER ({_first_like("f")}) AS first_like, count(DISTINCT lower({_unwrap("f")})) FILTER ({_first_like("f")}) AS first_distinct,
  count(*) FILTER ({_last_like("l")}) AS last_like, count(DISTINCT lower({_unwrap("l")})) FILTER ({_last_like("l")}) AS last_distinct FROM s),
sc AS (SELECT *, CASE WHEN first_like / total >= 0.6 AND first_distinct / greatest(first_like, 1) >= 0.4 THEN first_like / total ELSE 0 END AS fs,
  CASE WHEN last_like / total >= 0.6 AND last_distinct / greatest(last_like, 1) >= 0.4 THEN last_like / total ELSE 0 END AS ls FROM c)
SELECT total, first_like, first_distinct, last_like, last_distinct, CASE WHEN total = 0 THEN 'none' WHEN fs > 0 AND fs >= ls THEN 'firstToken' WHEN ls > 0 THEN 'lastToken' ELSE 'none' END AS mode FROM sc""",
    "looks_numeric": f"WITH {SIDES} SELECT row_num, regexp_matches(raw_price, '[0-9]') AND regexp_matches(trim(raw_price), '{_SHAPE}', 'i') AS numeric FROM costing",
    "word_overlap": f"WITH {_NEXT} SELECT k, {_round2(_OVERLAP)} AS overlap FROM pairs",
    "dice_score": f"WITH {_NEXT} SELECT k, {dice('a', 'b')} AS dice FROM pairs",
    "sibling_penalty": f"WITH {_NEXT} SELECT k, {penalty('a', 'b')} AS penalty FROM pairs",
    "engine_score": f"WITH {_NEXT} SELECT k, {engine('a', 'b')} AS engine, CAST(CASE WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN {dice('a', 'b')} ELSE greatest(0, {dice('a', 'b')} - {penalty('a', 'b')}) END AS INTEGER) AS plain FROM pairs",
    "token_idf": f"WITH {PREPARED}, {IDF} SELECT token, df, idf_micro FROM idf",
    "code_join": f"WITH {PREPARED} SELECT a_id, b_row, code, kind, sim FROM hits",
    "code_counts": f"WITH {PREPARED} SELECT a_id, CAST(count(*) FILTER (kind = 'strong') AS BIGINT) AS n_strong, CAST(count(*) FILTER (kind = 'weak') AS BIGINT) AS n_weak, CAST(count(*) FILTER (kind = 'conflict') AS BIGINT) AS n_conflict FROM hits GROUP BY a_id",
    "exact_stored": f"WITH {PREPARED} SELECT a_id, b_row, key_rank FROM a JOIN first_rows ON cleaned = key WHERE live",
    "exact_join": f"WITH {PREPARED} SELECT a_id, b_row, key_rank FROM a JOIN keys ON cleaned = key WHERE live",
    "fuzzy_topk": f"WITH {PREPARED}, wanted AS (SELECT cleaned FROM a WHERE live), {fuzzy_cte('wanted')} SELECT a_key, key, pool_pos, sim FROM scores",
    "fuzzy_topk_open": f"""WITH {PREPARED},
open1 AS (SELECT a_id, cleaned FROM a WHERE live AND a_id NOT IN (SELECT a_id FROM hits WHERE kind <> 'weak')),
wanted AS (SELECT cleaned FROM open1 WHERE cleaned NOT IN (SELECT key FROM keys)), {fuzzy_cte('wanted')} SELECT a_key, key, pool_pos, sim FROM scores""",
    "match_status": f"WITH {RESULTS} SELECT a_id, cleaned AS a_cleaned, a_price, status, method, score, b_row, b_price, difference, n_candidates FROM r",
    "status_counts": f"WITH {RESULTS} SELECT s.status, count(r.a_id) AS items FROM {_STATUS_ROWS} s LEFT JOIN r ON r.status = s.status GROUP BY s.status",
    "candidate_ranking": f"WITH {RESULTS} SELECT a_id, pos, b_row, sim AS similarity, code AS matched_code FROM cand",
    "match_notes": f"""WITH {RESULTS},
noted AS (SELECT h.*, b.raw_name, row_number() OVER (PARTITION BY h.a_id ORDER BY code_pos, h.b_row) AS k, count(*) OVER (PARTITION BY h.a_id) AS n FROM hits h JOIN b USING (b_row) WHERE kind = 'conflict'),
hit_notes AS (SELECT a_id, string_agg({filled_sql(sentences.CODE_CONFLICT, code="code", row="b_row", name="raw_name")}, ' | ' ORDER BY k)
  || CASE WHEN any_value(n) > {STORED} THEN ' | ' || {filled_sql(sentences.MORE_NOTES, n=f"(any_value(n) - {STORED})")} ELSE '' END AS t FROM noted WHERE k <= {STORED} GROUP BY a_id)
SELECT r.a_id, concat_ws(' | ',
  CASE WHEN status = 'CONFIRMED' THEN {filled_sql(sentences.BY_CODE, codes="array_to_string(codes, ', ')")} END,
  CASE WHEN NOT live THEN '{sentences.NO_ITEM}' END,
  hit_notes.t,
  CASE WHEN status = 'CONFLICT' THEN CASE WHEN n_conflict = 1 THEN {filled_sql(sentences.ONE_CONFLICT, n="n_conflict")} ELSE {filled_sql(sentences.CONFLICTS, n="n_conflict")} END END,
  CASE WHEN status = 'CONFIRMED' AND n_conflict > 0 THEN CASE WHEN n_conflict = 1 THEN {filled_sql(sentences.ONE_MORE_CONFLICT, n="n_conflict")} ELSE {filled_sql(sentences.MORE_CONFLICTS, n="n_conflict")} END END,
  CASE WHEN status = 'PROBABLE' THEN {filled_sql(sentences.FUZZY_ONLY, score="score")} END) AS notes
FROM r LEFT JOIN hit_notes ON hit_notes.a_id = r.a_id""",
    "valuation_range": f"WITH {VALUES} SELECT * FROM v",
    "valuation_flag": f"WITH {flagged(0)} SELECT a_id, flag FROM f",
    "exposure": f"WITH {flagged(0)} SELECT count(*) AS \"count\", {_round2('coalesce(' + _total('a_price - highest') + ', 0)')} AS amount FROM f WHERE flag = 'above'",
    "depreciation_exposure": f"WITH {flagged(45)} SELECT count(*) AS \"count\", {_round2('coalesce(' + _total('a_price - highest') + ', 0)')} AS amount FROM f WHERE flag = 'above'",
    "unmatched_costing": f"WITH {SUPPORT} SELECT b_row, raw_name AS name, b_price AS price, qty, {_EXT} AS extended FROM b WHERE b_row NOT IN (SELECT b_row FROM links)",
    "ledger": f"WITH {LEDGER} SELECT b_row, description, part_code, claimed_qty, assessed_qty, unit_price, total_cost, status, claim_rows, claim_items FROM lines",
    "a_duplicates": f"WITH {SIDES}, cl AS (SELECT row_num, {norm(strip('raw_name', 'firstToken'))} AS cleaned FROM claims) SELECT cleaned, string_agg(CAST(row_num AS VARCHAR), ',' ORDER BY row_num) AS rows FROM cl WHERE cleaned <> '' GROUP BY cleaned HAVING count(*) > 1",
    "costing_duplicates": f"WITH {SIDES}, cl AS (SELECT row_num, {norm('raw_name')} AS cleaned FROM costing) SELECT cleaned, CAST(count(*) AS INTEGER) AS n, min(row_num) AS first_row, max(row_num) AS last_row FROM cl WHERE cleaned <> '' GROUP BY cleaned HAVING count(*) > 1",
    "b_coverage": f"WITH {SUPPORT}, u AS (SELECT DISTINCT b_row FROM links) SELECT count(*) AS total, count(u.b_row) AS paired, count(*) - count(u.b_row) AS unmatched FROM b LEFT JOIN u ON u.b_row = b.b_row",
    "reverse_search": f"WITH {PREPARED}, t AS (SELECT a_id, cleaned AS a, {norm(chr(39) + 'SMALL small ring 11mm' + chr(39))} AS b FROM a) SELECT a_id, greatest(0, greatest(CASE WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN {dice('a', 'b')} ELSE greatest(0, {dice('a', 'b')} - {penalty('a', 'b')}) END, CASE WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN {dice('b', 'a')} ELSE greatest(0, {dice('b', 'a')} - {penalty('b', 'a')}) END) - {penalty('a', 'b')}) AS sim FROM t ORDER BY sim DESC, a_id LIMIT 8",
    "price_summary": f"""WITH {flagged(0)}, g AS (SELECT *, CASE WHEN a_price <> 0 THEN abs(difference) / a_price * 100 END AS gap FROM f)
SELECT {_round2(_total("a_price"))} AS total_a, {_round2(_total("b_price"))} AS total_b, {_round2("coalesce(" + _total("b_price") + ", 0) - coalesce(" + _total("a_price") + ", 0)")} AS net_difference, {_round2(_total("abs(difference)"))} AS total_abs_difference,
 {_round2(_mean("gap"))} AS avg_gap_pct, {_round2("max(gap)")} AS max_gap_pct, count(*) FILTER (flag = 'in-range') AS in_range, count(*) FILTER (flag = 'above') AS above,
 {_round2(_total("a_price - highest", "flag = 'above'"))} AS above_amount, count(*) FILTER (flag = 'above-allowed') AS above_allowed, count(*) FILTER (flag = 'below') AS below, count(*) FILTER (flag = 'unpriced') AS unpriced FROM g""",
    "status_money": f"WITH {RESULTS} SELECT s.status, count(r.a_id) AS items, {_round2(_total('a_price'))} AS sum_a, {_round2(_total('b_price'))} AS sum_b, {_round2(_total('difference'))} AS sum_diff FROM {_STATUS_ROWS} s LEFT JOIN r ON r.status = s.status GROUP BY s.status",
    "screen_summary": f"""WITH {flagged(0)}, g AS (SELECT *, CASE WHEN a_price IS NOT NULL AND b_price IS NOT NULL THEN coalesce(difference, 0) END AS d FROM f)
SELECT count(a_price) AS rows_with_a, {_round2("coalesce(" + _total("a_price") + ", 0)")} AS total_a, count(d) AS rows_with_both, {_round2("coalesce(" + _total("d") + ", 0)")} AS net_diff, {_round2("coalesce(" + _total("abs(d)") + ", 0)")} AS abs_diff,
 {_round2("coalesce(" + _mean("abs(d) / CASE WHEN a_price = 0 THEN 1 ELSE a_price END * 100") + ", 0)")} AS avg_abs_diff_pct, count(*) FILTER (d > 0) AS higher, {_round2("coalesce(" + _total("d", "d > 0") + ", 0)")} AS higher_amount,
 count(*) FILTER (d < 0) AS lower, {_round2("coalesce(" + _total("-d", "d < 0") + ", 0)")} AS lower_amount, count(*) FILTER (d = 0) AS equal,
 {_round2("CASE WHEN count(*) FILTER (flag <> 'unpriced') > 0 THEN count(*) FILTER (flag = 'in-range') / CAST(count(*) FILTER (flag <> 'unpriced') AS DOUBLE) * 100 ELSE 100 END")} AS in_range_pct FROM g""",
    "qty_check": f"WITH {RESULTS}, q AS (SELECT aq, (SELECT qty FROM b WHERE b.b_row = r.b_row) AS bq FROM r WHERE b_row IS NOT NULL) SELECT count(*) AS rows, coalesce(sum(aq), 0) AS claimed_units, coalesce(sum(bq), 0) AS verified_units, count(*) FILTER (aq IS DISTINCT FROM bq) AS mismatches FROM q WHERE aq IS NOT NULL OR bq IS NOT NULL",
    "extended_amounts": f"WITH {RESULTS}, q AS (SELECT aq, a_price, b_price, (SELECT qty FROM b WHERE b.b_row = r.b_row) AS bq FROM r WHERE b_row IS NOT NULL) SELECT {_round2(_total(_round2('aq * a_price')))} AS claimed, {_round2(_total(_round2('coalesce(bq, aq) * b_price')))} AS verified FROM q",
    "inventory_variance": f"""WITH {PREPARED}, x AS (SELECT coalesce({_total(f'coalesce({_round2("aq * a_price")}, a_price)')}, 0) AS claimed FROM a), y AS (SELECT coalesce({_total(f'coalesce({_EXT}, b_price)')}, 0) AS adjuster FROM b)
SELECT {_round2("claimed")} AS claimed, {_round2("adjuster")} AS adjuster, {_round2("adjuster - claimed")} AS variance FROM x, y""",
    "unmatched_value": f"WITH {SUPPORT} SELECT count(*) AS rows, {_round2('coalesce(' + _total(f'coalesce({_EXT}, b_price)') + ', 0)')} AS value FROM b WHERE b_row NOT IN (SELECT b_row FROM links)",
    "full_audit": f"WITH {flagged(0)} {AUDIT}",
    "action_list": f"WITH {flagged(0)} {AUDIT} WHERE status NOT IN ('CONFIRMED', 'STRONG')",
    "audit_filter_sort": f"WITH {RESULTS} SELECT a_id, raw_name AS a_raw_name, difference FROM r WHERE (contains(lower(raw_name), 'gear') OR contains(lower(coalesce(b_name, '')), 'gear')) AND CASE WHEN a_price <> 0 THEN abs(difference) / a_price * 100 END > 50 ORDER BY difference DESC NULLS LAST, a_id LIMIT 25 OFFSET 25",
    "ledger_filter": f"WITH {LEDGER} SELECT b_row, description, {_round2('diff_pct')} AS diff_pct FROM lines WHERE matched AND coalesce(diff_pct > 5, true) AND (contains(lower(description), 'gizmo') OR contains(lower(part_code), 'gizmo'))",
    "review_pairs": f"WITH {_PAIRS} SELECT a_id, a_name, b_name FROM rp",
    "jev_verdict_map": f"WITH {SIDES}, d AS (SELECT row_num AS a_id, (row_num * 37 % 101) / CAST(100 AS DOUBLE) AS p FROM claims) SELECT a_id, {_DECIDE} FROM d",
    "apply_decisions": f"""WITH {_PAIRS}, d AS (SELECT *, (a_id * 37 % 101) / CAST(100 AS DOUBLE) AS p FROM rp), e AS (SELECT *, {_DECIDE} FROM d),
j AS (SELECT r.*, e.verdict, e.confidence, coalesce(r.b_row, e.first_row) AS m_row, coalesce(r.b_price, CASE WHEN r.b_row IS NULL THEN e.first_price END) AS m_price FROM r LEFT JOIN e ON e.a_id = r.a_id)
SELECT a_id, CASE verdict WHEN 'MATCH' THEN 'CONFIRMED' WHEN 'NOT_MATCH' THEN 'UNMATCHED' ELSE status END AS status, CASE verdict WHEN 'MATCH' THEN 'jev' WHEN 'NOT_MATCH' THEN NULL ELSE method END AS method,
 CASE WHEN verdict = 'NOT_MATCH' THEN NULL ELSE score END AS score, CASE verdict WHEN 'MATCH' THEN m_row WHEN 'NOT_MATCH' THEN NULL ELSE b_row END AS b_row,
 CASE verdict WHEN 'MATCH' THEN m_price WHEN 'NOT_MATCH' THEN NULL ELSE b_price END AS b_price,
 CASE verdict WHEN 'MATCH' THEN {_round2("m_price - a_price")} WHEN 'NOT_MATCH' THEN NULL ELSE difference END AS difference, verdict AS jev_verdict, CAST(confidence AS DOUBLE) AS jev_confidence FROM j""",
    "apply_picks": f"""WITH {RESULTS}, k AS (SELECT c.a_id, c.b_row, c.sim, b.b_price AS price FROM cand c JOIN b ON b.b_row = c.b_row WHERE c.pos = 2)
SELECT r.a_id, CASE WHEN p THEN 'CONFIRMED' ELSE status END AS status, CASE WHEN p THEN 'manual' ELSE method END AS method, CASE WHEN p THEN k.sim ELSE score END AS score, CASE WHEN p THEN k.b_row ELSE r.b_row END AS b_row,
 CASE WHEN p THEN k.price ELSE r.b_price END AS b_price, CASE WHEN p THEN {_round2("k.price - a_price")} ELSE difference END AS difference, n_candidates
FROM (SELECT *, status = 'PROBABLE' AND n_candidates >= 2 AS p FROM r) r LEFT JOIN k ON k.a_id = r.a_id""",
    "header_detect": f"""WITH {SIDES}, cells AS (SELECT row_num, unnest([raw_name, raw_price, raw_code]) AS s, 'str' AS kind FROM claims WHERE row_num <= 20 UNION ALL SELECT row_num, CAST(CAST(raw_qty AS BIGINT) AS VARCHAR), 'num' FROM claims WHERE row_num <= 20 AND raw_qty IS NOT NULL
  UNION ALL SELECT 1, unnest(['Item Name', 'Unit Price', 'Part No.', 'Qty']), 'str'), filled AS (SELECT *, s AS raw_price FROM cells WHERE s IS NOT NULL AND trim(s) <> ''), {price_cte("cp", "filled", "row_num, s, kind")}
SELECT CAST(row_num AS INTEGER) AS row_num, count(*) AS filled, count(*) FILTER (kind = 'str') AS strings, count(*) FILTER (price IS NOT NULL AND regexp_matches(trim(s), '^[0-9(£$€¥₱\\s.,-]+$')) AS numbers FROM cp GROUP BY row_num""",
    "column_profile": f"""WITH {SIDES}, cells AS (SELECT row_num, 0 AS pos, raw_name AS s, 'str' AS kind FROM claims UNION ALL SELECT row_num, 1, raw_price, 'str' FROM claims UNION ALL SELECT row_num, 2, raw_code, 'str' FROM claims UNION ALL SELECT row_num, 3, CAST(CAST(raw_qty AS BIGINT) AS VARCHAR), 'num' FROM claims),
filled AS (SELECT *, kind = 'num' OR (regexp_matches(s, '[0-9]') AND regexp_matches(trim(s), '{_SHAPE}', 'i')) AS numeric FROM cells WHERE s IS NOT NULL AND trim(s) <> '' AND row_num BETWEEN 2 AND 301)
SELECT CAST(pos AS INTEGER) AS pos, count(*) AS filled, count(*) FILTER (NOT numeric) AS strings, count(*) FILTER (numeric) AS numbers, array_to_string(list_slice(list(trim(s) ORDER BY row_num), 1, 3), '|') AS samples FROM filled GROUP BY pos""",
    "file_health": f"""{"WITH " + _DUPS}, dup AS (SELECT count(*) AS duplicates FROM (SELECT key FROM kept GROUP BY key HAVING count(*) > 1)),
c AS (SELECT count(*) FILTER (name IS NOT NULL) AS rows, count(*) FILTER (name IS NULL) AS blank_names, count(*) FILTER (name IS NOT NULL AND price IS NOT NULL) AS readable,
 count(*) FILTER (name IS NOT NULL AND kind <> 'null' AND price IS NULL) AS unreadable, count(*) FILTER (name IS NOT NULL AND kind = 'null') AS missing,
 count(*) FILTER (name IS NOT NULL AND kind = 'num' AND number = floor(number) AND number BETWEEN 20000 AND 60000) AS dates, count(*) FILTER (name IS NOT NULL AND kind = 'str' AND price IS NOT NULL) AS text_price, count(*) FILTER (name IS NOT NULL AND price = 0) AS zero, count(*) FILTER (name IS NOT NULL AND price < 0) AS negative FROM named),
d AS (SELECT *, CASE WHEN rows > 0 THEN floor(readable / CAST(rows AS DOUBLE) * 1000 + 0.5) / 10 ELSE 0 END AS readable_pct, CASE WHEN dates >= 3 THEN dates ELSE 0 END AS date_like FROM c, dup),
e AS (SELECT *, CAST(blank_names > 0 AS INTEGER) + CAST(unreadable > 0 AS INTEGER) + CAST(duplicates > 0 AS INTEGER) + CAST(zero > 0 AS INTEGER) + CAST(negative > 0 AS INTEGER) + CAST(date_like > 0 AS INTEGER) AS issues FROM d)
SELECT rows, blank_names, duplicates, readable, readable_pct, unreadable, missing, zero, negative, date_like, text_price, issues, CASE WHEN rows = 0 OR readable_pct < 80 OR date_like > 0.5 * greatest(readable, 1) THEN 'problems' WHEN issues > 0 THEN 'warnings' ELSE 'looks good' END AS verdict FROM e""",
    "duplicate_names": f"WITH {_DUPS} SELECT key, count(*) AS n, first(name ORDER BY row_num) AS name, array_to_string(list_slice(list(CAST(row_num AS VARCHAR) ORDER BY row_num), 1, 3), ',') AS first_rows FROM kept GROUP BY key HAVING count(*) > 1",
    "duplicate_value": f"""WITH {SIDES}, {price_cte("priced", "claims", "row_num, raw_price, raw_name")}, cl AS (SELECT price, {norm(strip('raw_name', 'firstToken'))} AS cleaned FROM priced),
d AS (SELECT price, count(*) OVER (PARTITION BY cleaned) AS n FROM cl WHERE cleaned <> '') SELECT count(*) AS rows, {_round2("coalesce(" + _total("price") + ", 0)")} AS value FROM d WHERE n > 1""",
    "screening_cells": f"""WITH {SIDES}, d AS (SELECT row_num, CASE WHEN row_num % 7 = 0 THEN NULL WHEN row_num % 2 = 0 THEN 'MATCH' ELSE 'NOT_MATCH' END AS verdict,
 CASE WHEN row_num % 5 = 0 THEN NULL WHEN row_num % 3 = 0 THEN (row_num % 101) / CAST(100 AS DOUBLE) ELSE CAST(row_num % 90 + 11 AS DOUBLE) END AS c FROM claims)
SELECT row_num, CASE WHEN verdict IS NULL THEN '' WHEN c IS NULL THEN verdict ELSE verdict || ' · ' || CAST(CAST(least(100, floor(CASE WHEN c <= 1 THEN c * 100 ELSE c END + 0.5)) AS BIGINT) AS VARCHAR) || '%' END AS cell FROM d""",
    "detail_view": f"""WITH {RESULTS} SELECT a_id, status IN ('PROBABLE', 'CONFLICT') OR (status = 'UNMATCHED' AND n_candidates > 0) AS pickable, coalesce(r.cleaned = r.b_cleaned, false) AS same_name,
 aq AS claimed_qty, b.qty AS assessed_qty, coalesce(aq <> b.qty, false) AS qty_differs FROM r LEFT JOIN b ON b.b_row = r.b_row""",
    "sort_orders": f"WITH {RESULTS}, o AS (" + " UNION ALL ".join(f"SELECT '{k}' AS sort_key, a_id, row_number() OVER (ORDER BY {c} {o}, a_id) AS pos FROM r" for k, c, o in _ORDERS) + ") SELECT sort_key, CAST(pos AS INTEGER) AS pos, a_id FROM o WHERE pos <= 50",
    "sheet_preview": f"WITH {SIDES} SELECT CAST(row_num AS INTEGER) AS row_num, raw_name AS \"A\", raw_price AS \"B\", raw_code AS \"C\" FROM claims WHERE row_num BETWEEN 2 AND 9",
    "size_notes": f"WITH s AS (SELECT p_partkey AS k, p_partkey % 40 + 5 AS x, p_partkey % 7 + 2 AS y FROM part) SELECT k, CASE WHEN k % 3 = 0 THEN x || 'x' || (x + 9) || 'x' || y ELSE x || 'x' || (x + 9) || 'x' || (y + k % 2) END AS dims, k % 3 <> 0 AND k % 2 = 1 AS differ FROM s",
    "ledger_order": f"WITH {LEDGER} SELECT b_row, status FROM lines ORDER BY matched, b_row LIMIT 100",
    "health_samples": f"""{"WITH " + _DUPS}, flags AS (SELECT row_num, name, raw_price, unnest(['blank_names', 'unreadable', 'zero', 'negative', 'date_like']) AS flag,
 unnest([name IS NULL AND kind <> 'null', name IS NOT NULL AND kind <> 'null' AND price IS NULL, name IS NOT NULL AND price = 0, name IS NOT NULL AND price < 0,
  name IS NOT NULL AND kind = 'num' AND number = floor(number) AND number BETWEEN 20000 AND 60000]) AS holds FROM named)
SELECT flag, row_num, raw_price AS raw FROM flags WHERE holds QUALIFY row_number() OVER (PARTITION BY flag ORDER BY row_num) <= 5""",
}

_HINTS = [(c, sentences.HINTS[c].replace("'", "''")) for c in ("blank_names", "unreadable", "date_like", "duplicates", "zero", "negative")]
_SNIP = "CASE WHEN length({0}) > 48 THEN substr({0}, 1, 47) || '…' ELSE {0} END AS {0}"

ORACLE_SQL["health_hints"] = f"""WITH h AS ({ORACLE_SQL["file_health"]}), x AS (SELECT unnest([{", ".join(f"{c} > 0" for c, _ in _HINTS)}]) AS holds, unnest([{", ".join(f"'{t}'" for _, t in _HINTS)}]) AS hint, unnest(range({len(_HINTS)})) AS i FROM h)
SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS pos, hint FROM x WHERE holds"""
ORACLE_SQL["code_pattern"] = f"""WITH m AS ({ORACLE_SQL["code_mode_detect"]}), {SIDES},
n AS (SELECT row_num, mode, trim(raw_name) AS raw, CASE mode WHEN 'firstToken' THEN {strip("trim(raw_name)", "firstToken")} WHEN 'lastToken' THEN {strip("trim(raw_name)", "lastToken")} ELSE trim(raw_name) END AS stripped FROM claims, m WHERE trim(raw_name) <> '')
SELECT mode, 'codes: ' || CASE mode WHEN 'firstToken' THEN 'first token' ELSE 'last token' END AS label, {_SNIP.format("raw")}, {_SNIP.format("stripped")} FROM n WHERE stripped <> raw AND stripped <> '' ORDER BY row_num LIMIT 1"""

_Q = lambda c: f"coalesce({c}, '')"
#: The claims' files as cells: the layouts of ``tables.BOOKS``, row by row.
_CELLS = f"""{SIDES},
rows AS (SELECT *, (row_num - 2) // 500 AS book, row_number() OVER (PARTITION BY (row_num - 2) // 500 ORDER BY row_num) AS n, CAST(CAST(raw_qty AS INTEGER) AS VARCHAR) AS qty,
  CAST(46000 + (row_num - 2) % 900 AS VARCHAR) AS serial, CASE (row_num - 2) % 3 WHEN 0 THEN 'seen,' || chr(10) || 'the "old" rack' WHEN 1 THEN 'ok' ELSE '' END AS remark FROM claims),
heads AS (SELECT DISTINCT book, unnest(CASE book % 3 WHEN 0 THEN [1] WHEN 1 THEN [1, 2, 3] ELSE [1] END) AS row_num FROM rows),
sheet AS (SELECT book, n + CASE book % 3 WHEN 1 THEN 3 ELSE 1 END AS row_num, CASE book % 3 WHEN 0 THEN [raw_name, {_Q("raw_price")}, {_Q("raw_code")}, {_Q("qty")}, remark]
    WHEN 1 THEN [{_Q("raw_code")}, {_Q("qty")}, raw_name, {_Q("raw_price")}, remark] ELSE [remark, serial, {_Q("raw_price")}, raw_name, {_Q("raw_code")}] END AS cells FROM rows
  UNION ALL SELECT book, row_num, CASE WHEN book % 3 = 0 THEN ['Item Name', 'Unit Price', 'Part No.', 'Qty', 'Remarks'] WHEN book % 3 = 2 THEN ['Remarks', 'Fecha', 'Precio', 'Descripci\u00f3n', 'C\u00f3digo']
    WHEN row_num = 1 THEN ['Stock of yard seven', '', '', '', ''] WHEN row_num = 2 THEN [] ELSE ['SKU', 'Pcs', 'Descripci\u00f3n', 'Cost (USD)', 'Seen'] END FROM heads),
cells AS (SELECT book, row_num, unnest(cells) AS s, generate_subscripts(cells, 1) - 1 AS pos FROM sheet),
kinds AS (SELECT book, row_num, pos, nullif(s, '') AS s, CASE WHEN s = '' THEN 'null' WHEN regexp_full_match(s, '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN 'num' ELSE 'str' END AS kind FROM cells)"""
ORACLE_SQL["sheet_cells"] = f"WITH {_CELLS} SELECT CAST(book AS INTEGER) AS book, CAST(row_num AS INTEGER) AS row_num, CAST(pos AS INTEGER) AS pos, kind, s FROM kinds"

_HAS = lambda words, x="label": f"CAST(regexp_matches({x}, '{words}') AS INTEGER)"
def _roles_sql(cells: str, width: int, columns: str) -> str:
    """``cells`` ends in ``kinds``: ``book, row_num, pos, s, kind``."""
    return f"""WITH {cells},
filled AS (SELECT *, strip_accents(lower(trim(s))) AS label, s AS raw_price FROM kinds WHERE kind <> 'null' AND trim(s) <> ''),
{price_cte("priced", "(SELECT * FROM filled WHERE row_num <= 20)", "book, row_num, kind, label, s")},
scores AS (SELECT book, row_num, count(*) FILTER (kind = 'str') + 3 * count(*) FILTER (kind = 'str' AND (regexp_matches(label, '{NAME_WORDS.pattern}') OR regexp_matches(label, '{PRICE_WORDS.pattern}')))
  - 2 * count(*) FILTER (price IS NOT NULL AND regexp_matches(trim(s), '^[0-9(£$€¥₱\\s.,-]+$')) AS score FROM priced GROUP BY book, row_num HAVING count(*) >= 2),
header AS (SELECT book, arg_max(row_num, row(score, -row_num)) AS h FROM scores GROUP BY book),
width AS (SELECT book, h, unnest(range({width})) AS pos FROM header),
profile AS (SELECT f.book, pos, count(*) AS n, count(*) FILTER (kind = 'num' OR (regexp_matches(s, '[0-9]') AND regexp_matches(trim(s), '{_SHAPE}', 'i'))) AS numbers,
  list(length(trim(s)) ORDER BY row_num)[1:3] AS long FROM filled f JOIN header USING (book) WHERE row_num > h AND row_num <= h + 300 GROUP BY f.book, pos),
col AS (SELECT w.book, w.h, w.pos, coalesce(f.label, '') AS label, coalesce(numbers / CAST(n AS DOUBLE), 0) AS num, coalesce((n - numbers) / CAST(n AS DOUBLE), 0) AS str, coalesce(list_avg(long), 0) AS long
  FROM width w LEFT JOIN filled f ON f.book = w.book AND f.pos = w.pos AND f.row_num = w.h LEFT JOIN profile p ON p.book = w.book AND p.pos = w.pos),
a AS (SELECT book, any_value(h) AS h, arg_max(pos, row(3 * str + 5 * {_HAS(NAME_WORDS.pattern)} + least(long, 40) / 20, -pos)) FILTER (str >= 0.4) AS name_col,
  min(pos) FILTER (regexp_matches(label, '{QTY_WORDS.pattern}')) AS qty_col FROM col GROUP BY book),
c AS (SELECT col.book, arg_max(pos, row(2 * greatest(str, num) + 3 * {_HAS(STRONG_CODE_WORDS.pattern)}, -pos)) FILTER (pos <> name_col AND str + num > 0 AND regexp_matches(label, '{CODE_WORDS.pattern}')) AS code_col
  FROM col JOIN a USING (book) GROUP BY col.book),
p AS (SELECT col.book, arg_max(pos, row(3 * num + 5 * {_HAS(PRICE_WORDS.pattern)} - 6 * {_HAS(DATE_WORDS.pattern)}, -pos)) FILTER (num >= 0.3 AND pos <> name_col AND pos <> coalesce(code_col, -1)) AS price_col
  FROM col JOIN a USING (book) JOIN c USING (book) GROUP BY col.book),
d AS (SELECT a.book, count(*) AS data_rows FROM a JOIN filled f ON f.book = a.book AND f.pos = a.name_col AND f.row_num > a.h GROUP BY a.book)
SELECT {columns} FROM a JOIN c USING (book) JOIN p USING (book) JOIN d USING (book)"""


_ROLES = ", ".join(f"CAST({c} AS INTEGER) AS {n}" for c, n in (("h - 1", "header_row"), ("name_col", "name_col"), ("price_col", "price_col"), ("code_col", "code_col"), ("qty_col", "qty_col")))
_RUNNABLE = "data_rows, name_col <> price_col AND data_rows > 0 AS runnable"
ORACLE_SQL["sheet_roles"] = _roles_sql(_CELLS, 5, f"CAST(book AS INTEGER) AS book, {_ROLES}, {_RUNNABLE}")
#: The claims as one sheet: a header on row 1, one row a claim.
_SHEET = f"""{SIDES}, kinds AS (SELECT 0 AS book, row_num, pos, s, CASE WHEN s IS NULL THEN 'null' WHEN pos = 3 AND row_num > 1 THEN 'num' ELSE 'str' END AS kind FROM (
  SELECT row_num, unnest(range(4)) AS pos, unnest([raw_name, raw_price, raw_code, CAST(CAST(raw_qty AS BIGINT) AS VARCHAR)]) AS s FROM claims
  UNION ALL SELECT 1, unnest(range(4)), unnest(['Item Name', 'Unit Price', 'Part No.', 'Qty'])))"""
ORACLE_SQL["column_roles"] = _roles_sql(_SHEET, 4, _ROLES)
ORACLE_SQL["run_gate"] = _roles_sql(_SHEET, 4, _RUNNABLE)
ORACLE_SQL["run_from_files"] = f"WITH {RESULTS} SELECT raw_name AS a_raw_name, a_price, status, method, score, b_row FROM r"

ORACLE_SQL["duplicate_members"] = f"""WITH {SIDES}, cl AS (SELECT row_num AS row, {norm('raw_name')} AS cleaned FROM costing)
SELECT cleaned, row, row_number() OVER (PARTITION BY cleaned ORDER BY row) AS place, count(*) OVER (PARTITION BY cleaned) AS n FROM cl WHERE cleaned <> '' QUALIFY count(*) OVER (PARTITION BY cleaned) > 1"""
_GRAMS = "unnest(list_transform(range(1, length(replace({0}, ' ', ''))), lambda i: substr(replace({0}, ' ', ''), i, 2)))"
_PLAIN = f"list_sort(list_filter({tokens('{0}')}, lambda w: NOT regexp_matches(w, '[0-9]')))"
#: Likeness in both directions from shared bigrams; numbers are compared where all other words are the same.
ORACLE_SQL["reverse_search_all"] = f"""WITH {SUPPORT},
lines AS (SELECT DISTINCT cleaned AS line FROM b WHERE b_row NOT IN (SELECT b_row FROM links)),
lg AS (SELECT line, gram, count(*) AS n FROM (SELECT line, {_GRAMS.format("line")} AS gram FROM lines) GROUP BY ALL),
ag AS (SELECT a_id, gram, count(*) AS n FROM (SELECT a_id, {_GRAMS.format("cleaned")} AS gram FROM a) GROUP BY ALL),
shared AS (SELECT line, a_id, greatest(sum(lg.n), sum(ag.n)) AS shared FROM lg JOIN ag USING (gram) GROUP BY line, a_id),
base AS (SELECT line, a_id, cleaned, replace(line, ' ', '') = replace(cleaned, ' ', '') AS same, CASE WHEN replace(line, ' ', '') = replace(cleaned, ' ', '') THEN 100
  ELSE floor(2 * coalesce(shared, 0) / CAST(length(replace(line, ' ', '')) + length(replace(cleaned, ' ', '')) - 2 AS DOUBLE) * 100 + 0.5) END AS dice
  FROM lines CROSS JOIN a LEFT JOIN shared USING (line, a_id)),
lost AS (SELECT line, a_id, same, dice, CASE WHEN {_PLAIN.format("line")} = {_PLAIN.format("cleaned")} THEN {penalty("line", "cleaned")} ELSE 0 END AS p FROM base),
sims AS (SELECT line, a_id, CAST(greatest(0, CASE WHEN same THEN 100 - p ELSE greatest(0, dice - p) - p END) AS INTEGER) AS sim FROM lost)
SELECT line, CAST(row_number() OVER (PARTITION BY line ORDER BY sim DESC, a_id) AS INTEGER) AS pos, a_id, sim FROM sims QUALIFY row_number() OVER (PARTITION BY line ORDER BY sim DESC, a_id) <= 8"""
ORACLE_SQL["late_pages"] = f"""WITH {RESULTS}, n AS (SELECT greatest(1, (count(*) + 6) // 7) AS size FROM r)
SELECT CAST((row_number() OVER (ORDER BY difference DESC NULLS LAST, a_id) - 1) // size AS INTEGER) AS page, a_id FROM r, n"""
ORACLE_SQL["audit_options"] = f"""WITH {_PAIRS}, d AS (SELECT *, (a_id * 37 % 101) / CAST(100 AS DOUBLE) AS p FROM rp), e AS (SELECT *, {_DECIDE} FROM d),
names AS (SELECT row_num, {norm(strip("raw_name", "firstToken"))} AS cleaned FROM claims),
same AS (SELECT x.row_num, y.row_num AS other, row_number() OVER (PARTITION BY x.row_num ORDER BY y.row_num) AS k, count(*) OVER (PARTITION BY x.row_num) AS n FROM names x JOIN names y ON x.cleaned = y.cleaned AND x.row_num <> y.row_num WHERE x.cleaned <> ''),
dups AS (SELECT row_num, string_agg(CAST(other AS VARCHAR), ', ' ORDER BY k) || CASE WHEN any_value(n) > {NAMED_ROWS} THEN ' and ' || (any_value(n) - {NAMED_ROWS}) || ' more' ELSE '' END AS rows FROM same WHERE k <= {NAMED_ROWS} GROUP BY row_num),
st AS (SELECT r.a_id, CASE e.verdict WHEN 'MATCH' THEN 'CONFIRMED' WHEN 'NOT_MATCH' THEN 'UNMATCHED' ELSE r.status END AS status, e.verdict, e.confidence FROM r LEFT JOIN e ON e.a_id = r.a_id)
SELECT a_id AS a_row, upper(substr(status, 1, 1)) || lower(substr(status, 2)) AS status, coalesce(dups.rows, '') AS duplicate_rows,
  CASE WHEN verdict IS NULL THEN '' ELSE verdict || ' · ' || CAST(confidence AS VARCHAR) || '%' END AS screening FROM st LEFT JOIN dups ON dups.row_num = st.a_id"""
ORACLE_SQL["report_summary"] = f"""WITH {RESULTS}, n AS (SELECT count(*) AS total, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES)} FROM r)
SELECT unnest(['File A items', 'Confirmed matches', 'Strong matches', 'Probable matches', 'Conflicts', 'Unmatched', 'Review floor (fuzzy kept as Probable)', 'Reference gap tolerance (%)', 'Code stripping (name comparison only)']) AS key,
  unnest([CAST(total AS VARCHAR), CAST(CONFIRMED AS VARCHAR), CAST(STRONG AS VARCHAR), CAST(PROBABLE AS VARCHAR), CAST(CONFLICT AS VARCHAR), CAST(UNMATCHED AS VARCHAR), '60', '0', 'auto → firstToken']) AS value FROM n"""
