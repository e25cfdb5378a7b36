"""Version tokens, comparators and ranges.

Tokens are an array of structs (k: 0 number or 1 word, n: number, s: word), whose order is that of versions where
kinds agree. That two versions cannot be ordered is null, never zero.
"""

from __future__ import annotations

from fenwatch.functions.dialect import Dialect, operator
from fenwatch.functions.text import collapse

# Patterns of a version, and of an operator with a version.
TOKEN = r"[a-z]*[0-9][0-9a-z._\-]*"
OPERATION = r"(<=|>=|==|<|>|=)\s*([a-z][0-9a-z._\-]*[0-9][0-9a-z._\-]*|[0-9][0-9a-z._\-]*)"
# Phrases of a range, in the order in which they are tried.
BELOW = ["up to but not including", "all versions prior to", "all versions before", "all versions earlier than", "versions prior to", "versions before", "earlier than", "older than", "prior to", "before"]
UP_TO = ["up to and including", "through", "up to"]
AND_EARLIER = ["and all prior versions", "and prior versions", "and earlier versions", "and prior", "and earlier", "and below", "and older", "or earlier", "or below", "or older"]
ABOVE = ["all versions after", "versions after", "later than", "newer than", "after"]
AND_LATER = ["and later versions", "and newer versions", "and subsequent versions", "and later", "and above", "and newer", "and subsequent", "or later", "or above", "or newer"]
BETWEEN = [" to ", " through ", " until ", " and ", " - ", "-"]


def tokens(d: Dialect, x: str) -> str:
    """The runs of digits and of letters; none if a number is beyond 64 bits."""
    bare = d.replace_all(f"trim({d.replace_all(f'trim(lower({x}))', '^version ', '')})", "^v([0-9])", d.group(1))
    found = d.extract_all(bare, "[0-9]+|[a-z]+")
    number = "coalesce(try_cast(v AS bigint), CAST(-1 AS bigint))"
    token = d.struct(k=f"CASE WHEN {d.matches('v', '^[0-9]')} THEN 0 ELSE 1 END", n=f"CASE WHEN {d.matches('v', '^[0-9]')} THEN {number} ELSE CAST(0 AS bigint) END", s=f"CASE WHEN {d.matches('v', '^[0-9]')} THEN '' ELSE v END")
    made = d.map(found, "v", token)
    return f"CASE WHEN {d.size(d.keep(made, 't', 't.n < 0'))} > 0 THEN {d.keep(made, 't', 'false')} ELSE {made} END"


def differs_at(d: Dialect, a: str, b: str) -> str:
    """The first position, from 1, where two token arrays differ; null if none does within the shorter."""
    shorter = f"least({d.size(a)}, {d.size(b)})"
    at = d.get(d.keep(d.count_to(shorter), "i", f"{d.get(a, 'i - 1')} <> {d.get(b, 'i - 1')}"), 0)
    return f"CASE WHEN {shorter} > 0 THEN {at} END"


def order_of(d: Dialect, a: str, b: str, at: str) -> str:
    """-1, 0 or 1 for token arrays that first differ at `at`; null if they cannot be ordered."""
    x, y = d.get(a, f"{at} - 1"), d.get(b, f"{at} - 1")
    return f"CASE WHEN {d.size(a)} = 0 OR {d.size(b)} = 0 THEN NULL WHEN {at} IS NULL THEN CAST(sign({d.size(a)} - {d.size(b)}) AS int) WHEN {x}.k <> {y}.k THEN NULL WHEN {x} < {y} THEN -1 ELSE 1 END"


def spaced(d: Dialect, t: str) -> str:
    """Each token between spaces of its own."""
    words = d.map(t, "t", "' ' || CASE WHEN t.k = 0 THEN CAST(t.n AS string) ELSE t.s END || ' '")
    return d.join(words, "")


def abb(d: Dialect, words: str) -> str:
    """(release, revision, patch) of `[r]N[rev][pcN]`; null otherwise."""
    shape = "^( r )?( [0-9]+ )( [a-z]+ )?( pc  [0-9]+ )?$"
    part = lambda g: f"trim({d.extract(words, shape, g)})"
    made = d.struct(a=f"try_cast({part(2)} AS bigint)", b=part(3), c=f"coalesce(try_cast(trim(replace({part(4)}, 'pc', '')) AS bigint), CAST(0 AS bigint))")
    return f"CASE WHEN {d.matches(words, shape)} AND {part(3)} <> 'pc' AND ({part(1)} <> '' OR {part(3)} <> '') THEN {made} END"


def siemens(d: Dialect, words: str) -> str:
    """(leading numbers, service pack, update); null without a leading number."""
    lead = f"trim({d.replace_all(d.extract(words, '^(?: [0-9]+ )+'), ' +', ' ')})"
    numbers = d.map(d.split(lead, " "), "v", "try_cast(v AS bigint)")

    def counter(labels: str) -> str:
        found = d.extract_all(words, f" (?:{labels}) ( [0-9]+ )?", 1)
        return f"coalesce(try_cast(trim({d.get(found, f'{d.size(found)} - 1')}) AS bigint), CAST(0 AS bigint))"

    return f"CASE WHEN {lead} <> '' THEN {d.struct(a=numbers, b=counter('sp|servicepack'), c=counter('update|upd'))} END"


def by_scheme(d: Dialect, scheme: str, generic: str, a: str, b: str) -> str:
    """The order under a vendor's scheme, over columns {a}_abb, {a}_siemens and so on; other schemes compare tokens."""
    one = lambda s: f"WHEN {scheme} = '{s}' AND {a}_{s} IS NOT NULL AND {b}_{s} IS NOT NULL THEN CASE WHEN {a}_{s} < {b}_{s} THEN -1 WHEN {a}_{s} > {b}_{s} THEN 1 ELSE 0 END"
    return f"CASE {one('abb')} {one('siemens')} ELSE {generic} END"


@operator("pairs")
def compare_versions(d: Dialect) -> str:
    """pairs (id, scheme, a, b) with result: -1, 0 or 1, or null where the versions cannot be ordered."""
    return f"""
WITH t AS (SELECT id, scheme, a, b, {tokens(d, 'a')} AS ta, {tokens(d, 'b')} AS tb FROM «pairs»),
w AS (SELECT *, {differs_at(d, 'ta', 'tb')} AS place, {spaced(d, 'ta')} AS wa, {spaced(d, 'tb')} AS wb FROM t),
s AS (SELECT *, {order_of(d, 'ta', 'tb', 'place')} AS generic, {abb(d, 'wa')} AS a_abb, {abb(d, 'wb')} AS b_abb, {siemens(d, 'wa')} AS a_siemens, {siemens(d, 'wb')} AS b_siemens FROM w)
SELECT id, scheme, a, b, CAST({by_scheme(d, 'scheme', 'generic', 'a', 'b')} AS int) AS result FROM s"""


def _first(d: Dialect, phrases: list[str], found: str) -> str:
    """What `found` gives for the first phrase p that occurs in the text and for which it gives something."""
    made = d.map(d.array(*map(d.lit, phrases)), "p", f"CASE WHEN contains(text, p) THEN {found} END")
    return d.get(d.keep(made, "x", "x IS NOT NULL"), 0)


def _after(d: Dialect, phrases: list[str]) -> str:
    """The first version after a phrase."""
    return _first(d, phrases, f"nullif({d.extract(f'substring(text, {d.find('text', 'p')} + length(p))', TOKEN)}, '')")


def _before(d: Dialect, phrases: list[str]) -> str:
    """The last version before a phrase."""
    found = d.extract_all(f"substring(text, 1, {d.find('text', 'p')} - 1)", TOKEN)
    return _first(d, phrases, d.get(found, f"{d.size(found)} - 1"))


@operator("ranges")
def parse_ranges(d: Dialect) -> str:
    """ranges (raw) with kind, lower, lower_inclusive, upper, upper_inclusive and prefix.

    The cascade: VERS, operators, wildcard, all versions, interval, exclusive upper, exclusive lower, inclusive upper,
    inclusive lower, a bare version, else unknown. Absent bounds are null. Distinct spellings are parsed once.
    """
    seps = d.array(*(d.struct(pos=str(k), sep=d.lit(s)) for k, s in enumerate(BETWEEN)))
    part = lambda i: f"trim({d.get('parts', i)})"
    op = lambda i: f"CASE WHEN {d.matches(part(i), '^(<=|>=|!=|<|>|=)')} THEN {d.extract(part(i), '^(<=|>=|!=|<|>|=)', 1)} ELSE '=' END"
    version = lambda i: f"trim({d.replace_all(part(i), '^(<=|>=|!=|<|>|=)', '')})"
    last = lambda a: d.get(a, f"{d.size(a)} - 1")
    tokens_before = d.extract_all("substring(trimmed, 1, place - 1)", TOKEN)
    picked = lambda ops: d.get(d.keep("pairs", "p", f"p.op IN ({ops})"), f"{d.size(d.keep('pairs', 'p', f'p.op IN ({ops})'))} - 1")
    ops, versions = d.extract_all("text", OPERATION, 1), d.extract_all("text", OPERATION, 2)
    return f"""
WITH t AS (
  SELECT raw, {collapse(d, 'lower(raw)')} AS text FROM (SELECT DISTINCT coalesce(raw, '') AS raw FROM «ranges»)),
v AS (
  SELECT raw, text, text LIKE 'vers:%' AS is_vers,
    trim({d.extract('text', '^vers:[^/]*/(.*)$', 1)}) AS body, {d.extract_all('text', TOKEN)} AS found, {ops} AS ops, {versions} AS versions,
    {d.replace_all("CASE WHEN text LIKE '%.x' OR text LIKE '%.*' THEN substring(text, 1, length(text) - 2) WHEN text LIKE '%x' OR text LIKE '%*' THEN substring(text, 1, length(text) - 1) ELSE '' END", '[.]$', '')} AS head,
    {d.replace_all('text', '^between ', '')} AS trimmed
  FROM t),
w AS (
  SELECT *, {d.split('body', '|')} AS parts,
    CASE WHEN {d.size('ops')} > 0 THEN {d.map(d.count_to(d.size('ops')), 'i', d.struct(op=d.get('ops', 'i - 1'), version=d.get('versions', 'i - 1')))} END AS pairs
  FROM v),
s AS (
  SELECT raw, text, trimmed, x.pos AS pos, x.sep AS sep, {d.find('trimmed', 'x.sep')} AS place FROM {d.unnest('w', seps, 'x')} WHERE NOT is_vers AND contains(trimmed, x.sep)),
e AS (
  SELECT raw, pos, {last(tokens_before)} AS l, nullif({d.extract('substring(trimmed, place + length(sep))', TOKEN)}, '') AS r FROM s),
o AS (
  SELECT raw, pos, l, r, {tokens(d, 'l')} AS tl, {tokens(d, 'r')} AS tr FROM e WHERE l IS NOT NULL AND r IS NOT NULL AND l <> r),
o2 AS (SELECT *, {differs_at(d, 'tl', 'tr')} AS place FROM o),
interval_of AS (SELECT raw, {d.first_by('l', 'pos')} AS l, {d.first_by('r', 'pos')} AS r FROM o2 WHERE {order_of(d, 'tl', 'tr', 'place')} = -1 GROUP BY raw),
p AS (
  SELECT w.*, i.l AS i_l, i.r AS i_r,
    {op(0)} AS op0, {version(0)} AS v0, {op(1)} AS op1, {version(1)} AS v1,
    {picked("'<', '<=', '=', '=='")} AS up, {picked("'>', '>=', '=', '=='")} AS low,
    {_after(d, BELOW)} AS below, {_after(d, ABOVE)} AS above, {_after(d, UP_TO)} AS up_to,
    {_before(d, AND_EARLIER)} AS earlier, {_before(d, AND_LATER)} AS later
  FROM w LEFT JOIN interval_of i ON w.raw = i.raw),
k AS (
  SELECT *, CASE
    WHEN text = '' THEN 'unknown'
    WHEN is_vers THEN CASE
      WHEN body = '' THEN 'unknown' WHEN body = '*' THEN 'all'
      WHEN {d.size('parts')} = 1 THEN CASE WHEN v0 IN ('', '*') THEN 'unknown' WHEN op0 = '=' THEN 'eq' WHEN op0 = '<' THEN 'lt' WHEN op0 = '<=' THEN 'lte' WHEN op0 = '>' THEN 'gt' WHEN op0 = '>=' THEN 'gte' ELSE 'unknown' END
      WHEN {d.size('parts')} = 2 AND v0 <> '' AND v1 <> '' AND ((op0 IN ('<', '<=') AND op1 IN ('>', '>=')) OR (op1 IN ('<', '<=') AND op0 IN ('>', '>='))) THEN 'between'
      ELSE 'unknown' END
    WHEN pairs IS NOT NULL THEN CASE
      WHEN low.version = up.version AND low.op IN ('>=', '=', '==') AND up.op IN ('<=', '=', '==') THEN 'eq'
      WHEN low.version IS NOT NULL AND up.version IS NOT NULL THEN 'between'
      WHEN up.version IS NOT NULL THEN CASE WHEN up.op = '<' THEN 'lt' ELSE 'lte' END
      WHEN low.op = '>' THEN 'gt' ELSE 'gte' END
    WHEN head <> '' AND {d.matches('head', '[0-9]')} AND NOT contains(head, ' ') THEN 'prefix'
    WHEN {d.size('found')} = 0 THEN CASE WHEN contains(text, 'all versions') OR text IN ('all', 'any', '*') THEN 'all' ELSE 'unknown' END
    WHEN i_l IS NOT NULL THEN 'interval'
    WHEN below IS NOT NULL THEN 'below' WHEN above IS NOT NULL THEN 'above' WHEN up_to IS NOT NULL THEN 'up_to'
    WHEN earlier IS NOT NULL THEN 'earlier' WHEN later IS NOT NULL THEN 'later'
    WHEN {d.size('found')} = 1 AND {d.get('found', 0)} = text THEN 'bare' ELSE 'unknown' END AS via
  FROM p),
b AS (
  SELECT *,
    CASE WHEN is_vers AND via IN ('eq', 'gt', 'gte') THEN v0 WHEN is_vers AND via = 'between' THEN CASE WHEN op0 IN ('>', '>=') THEN v0 ELSE v1 END
      WHEN pairs IS NOT NULL AND NOT is_vers THEN low.version WHEN via = 'interval' THEN i_l WHEN via = 'above' THEN above WHEN via = 'later' THEN later WHEN via = 'bare' THEN text END AS lower,
    CASE WHEN is_vers AND via IN ('eq', 'lt', 'lte') THEN v0 WHEN is_vers AND via = 'between' THEN CASE WHEN op0 IN ('<', '<=') THEN v0 ELSE v1 END
      WHEN pairs IS NOT NULL AND NOT is_vers THEN up.version WHEN via = 'interval' THEN i_r WHEN via = 'below' THEN below WHEN via = 'up_to' THEN up_to WHEN via = 'earlier' THEN earlier WHEN via = 'bare' THEN text END AS upper
  FROM k)
SELECT raw,
  CASE via WHEN 'interval' THEN 'between' WHEN 'below' THEN 'lt' WHEN 'above' THEN 'gt' WHEN 'up_to' THEN 'lte' WHEN 'earlier' THEN 'lte' WHEN 'later' THEN 'gte' WHEN 'bare' THEN 'eq' ELSE via END AS kind,
  lower, lower IS NOT NULL AND coalesce(CASE WHEN is_vers THEN CASE WHEN via = 'between' THEN CASE WHEN op0 IN ('>', '>=') THEN op0 ELSE op1 END ELSE op0 END WHEN pairs IS NOT NULL THEN low.op WHEN via = 'above' THEN '>' ELSE '=' END, '=') <> '>' AS lower_inclusive,
  upper, upper IS NOT NULL AND coalesce(CASE WHEN is_vers THEN CASE WHEN via = 'between' THEN CASE WHEN op0 IN ('<', '<=') THEN op0 ELSE op1 END ELSE op0 END WHEN pairs IS NOT NULL THEN up.op WHEN via = 'below' THEN '<' ELSE '=' END, '=') <> '<' AS upper_inclusive,
  CASE WHEN via = 'prefix' THEN head END AS prefix
FROM b"""


def describe_range(d: Dialect) -> str:
    """A range in words."""
    lower, upper = "CASE WHEN lower_inclusive THEN '[' ELSE '(' END", "CASE WHEN upper_inclusive THEN ']' ELSE ')' END"
    return f"""CASE kind WHEN 'all' THEN 'all versions' WHEN 'eq' THEN 'exactly ' || lower WHEN 'prefix' THEN 'the ' || prefix || ' release line' WHEN 'lt' THEN 'versions below ' || upper WHEN 'lte' THEN 'versions up to and including ' || upper
    WHEN 'gt' THEN 'versions above ' || lower WHEN 'gte' THEN 'versions from ' || lower || ' onward' WHEN 'between' THEN 'versions in ' || {lower} || lower || ', ' || upper || {upper} ELSE 'an unparsed range' END"""


@operator("checks")
def evaluate_ranges(d: Dialect) -> str:
    """checks (id, version, scheme, kind, lower, lower_inclusive, upper, upper_inclusive, prefix) with result: affected, not_affected or indeterminate, comparator, and why in words."""
    t = lambda c: f"{tokens(d, c)} AS t_{c}"
    words = lambda c: f"{abb(d, f'w_{c}')} AS {c}_abb, {siemens(d, f'w_{c}')} AS {c}_siemens"
    reading = f"'components ' || {d.join(d.map('t_version', 'x', "CASE WHEN x.k = 0 THEN CAST(x.n AS string) ELSE x.s END"), '.')}"
    return f"""
WITH t AS (
  SELECT *, {t('version')}, {t('lower')}, {t('upper')}, {t('prefix')} FROM «checks»),
w AS (
  SELECT *, {differs_at(d, 't_version', 't_lower')} AS place_lower, {differs_at(d, 't_version', 't_upper')} AS place_upper, {differs_at(d, 't_version', 't_prefix')} AS place_prefix,
    {spaced(d, 't_version')} AS w_version, {spaced(d, 't_lower')} AS w_lower, {spaced(d, 't_upper')} AS w_upper FROM t),
s AS (
  SELECT *, {order_of(d, 't_version', 't_lower', 'place_lower')} AS g_lower, {order_of(d, 't_version', 't_upper', 'place_upper')} AS g_upper, {words('version')}, {words('lower')}, {words('upper')} FROM w),
c AS (
  SELECT *, {by_scheme(d, 'scheme', 'g_lower', 'version', 'lower')} AS c_lower, {by_scheme(d, 'scheme', 'g_upper', 'version', 'upper')} AS c_upper,
    CASE WHEN scheme IN ('abb', 'siemens', 'rockwell') THEN scheme ELSE 'generic' END AS comparator FROM s),
v AS (
  SELECT *, CASE
    WHEN kind = 'all' THEN 'all'
    WHEN trim(coalesce(version, '')) = '' THEN 'no_version'
    WHEN coalesce(kind, 'unknown') = 'unknown' THEN 'no_range'
    WHEN kind = 'prefix' THEN CASE WHEN {d.size('t_prefix')} > 0 AND {d.size('t_version')} >= {d.size('t_prefix')} AND place_prefix IS NULL THEN 'in_line' ELSE 'off_line' END
    WHEN lower IS NOT NULL AND c_lower IS NULL THEN 'lower_unordered'
    WHEN lower IS NOT NULL AND (c_lower < 0 OR (c_lower = 0 AND NOT lower_inclusive)) THEN 'below'
    WHEN upper IS NOT NULL AND c_upper IS NULL THEN 'upper_unordered'
    WHEN upper IS NOT NULL AND (c_upper > 0 OR (c_upper = 0 AND NOT upper_inclusive)) THEN 'above'
    ELSE 'inside' END AS why FROM c)
SELECT id, version, CASE WHEN why IN ('all', 'in_line', 'inside') THEN 'affected' WHEN why IN ('off_line', 'below', 'above') THEN 'not_affected' ELSE 'indeterminate' END AS result, comparator,
  CASE why WHEN 'all' THEN 'the advisory names no version, so every version is affected'
    WHEN 'no_version' THEN 'the device did not report a firmware version, so the range could not be checked'
    WHEN 'no_range' THEN 'the advisory range could not be parsed'
    WHEN 'in_line' THEN version || ' is in the ' || prefix || ' release line'
    WHEN 'off_line' THEN version || ' is not in the ' || prefix || ' release line'
    WHEN 'lower_unordered' THEN version || ' could not be ordered against ' || lower || ' using the ' || comparator || ' comparator'
    WHEN 'upper_unordered' THEN version || ' could not be ordered against ' || upper || ' using the ' || comparator || ' comparator'
    WHEN 'below' THEN version || ' (' || {reading} || ') is below the affected range starting at ' || lower
    WHEN 'above' THEN version || ' (' || {reading} || ') is above the affected range ending at ' || upper
    ELSE version || ' (' || {reading} || ') falls inside ' || {describe_range(d)} END AS explanation
FROM v"""
