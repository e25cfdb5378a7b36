"""Vendor, product-family and order-code resolution, each over distinct strings and joined back by equality.

Lookup tables are inputs: vendors (entry, id, display, scheme, alias) and families (entry, id, vendor, display, name,
is_model), a row per name, and parsers (vendor, parser, place), which order codes' parsers a vendor is restricted to.
`builtin` gives the small ones of this package, `read_vendors` and `read_families` those of JSON files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.functions import tables as L
from fenwatch.functions import text as X
from fenwatch.functions.dialect import Dialect, Operator, operator
from fenwatch.plans.graph import written

VENDOR_ROWS = [(k, i, d, s, a) for k, (i, d, s, names) in enumerate(L.VENDORS) for a in [d, *names]]
FAMILY_ROWS = [(k, i, v, d, n, m) for k, (i, v, d, names, models) in enumerate(L.FAMILIES) for n, m in [(d, 0), *((a, 0) for a in names), *((a, 1) for a in models)]]
PARSER_ROWS = [(v, p, k) for v, names in L.VENDOR_PARSERS for k, p in enumerate(names)]


def _table(names: str, rows: list[tuple]) -> Operator:
    return Operator(lambda d: f"SELECT * FROM {d.values(names, rows)}", ())


#: The small tables that are built in, as operators without inputs.
BUILTIN_VENDORS = _table("t(entry, id, display, scheme, alias)", VENDOR_ROWS)
BUILTIN_FAMILIES = _table("t(entry, id, vendor, display, name, is_model)", FAMILY_ROWS)
BUILTIN_PARSERS = _table("t(vendor, parser, place)", PARSER_ROWS)


def read_vendors(spark: SparkSession, path: str) -> DataFrame:
    """A vendor table from JSON files: entries with id, display, version_scheme and aliases. A faulty table is an error."""
    rows = spark.read.schema("id string, display string, version_scheme string, aliases array<string>").option("multiLine", "true").json(path)
    names = F.array_union(F.array("display"), F.coalesce("aliases", F.array().cast("array<string>")))
    out = rows.withColumn("entry", F.monotonically_increasing_id()).select("entry", "id", "display", F.coalesce("version_scheme", F.lit("")).alias("scheme"), F.explode_outer(names).alias("alias"))
    return _sound(out, vendor_faults(out))


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """A family table from JSON files: entries with id, vendor, display, aliases and models. A faulty table is an error."""
    rows = spark.read.schema("id string, vendor string, display string, aliases array<string>, models array<string>").option("multiLine", "true").json(path)
    one = lambda c, m: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(x.alias("name"), F.lit(m).alias("is_model")))
    names = F.concat(one(F.array("display"), 0), one(F.col("aliases"), 0), one(F.col("models"), 1))
    out = rows.withColumn("entry", F.monotonically_increasing_id()).select("entry", "id", "vendor", "display", F.explode_outer(names).alias("n")).select("entry", "id", "vendor", "display", "n.*")
    return _sound(out, family_faults(out))


def _sound(table: DataFrame, faults: DataFrame) -> DataFrame:
    found = faults.limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r['fault']}: {r['what']}" for r in found))
    return table


@operator("vendors")
def vendor_faults(d: Dialect) -> str:
    """What is wrong with a vendor table (fault, what): missing ids or display names, ids of several entries, names that several vendors claim."""
    return f"""
SELECT DISTINCT 'no id' AS fault, coalesce(display, '') AS what FROM «vendors» WHERE trim(coalesce(id, '')) = ''
UNION ALL SELECT DISTINCT 'no display name', id FROM «vendors» WHERE trim(coalesce(display, '')) = '' AND trim(coalesce(id, '')) <> ''
UNION ALL SELECT 'repeated id', id FROM «vendors» WHERE trim(coalesce(id, '')) <> '' GROUP BY id HAVING count(DISTINCT entry) > 1
UNION ALL SELECT 'name of several vendors', key FROM (SELECT id, {X.vendor_key(d, "coalesce(alias, '')")} AS key FROM «vendors») x WHERE key <> '' GROUP BY key HAVING count(DISTINCT id) > 1"""


@operator("families")
def family_faults(d: Dialect) -> str:
    """What is wrong with a family table (fault, what): missing ids, vendors or display names, ids of several entries."""
    blank = lambda c: f"trim(coalesce({c}, '')) = ''"
    return f"""
SELECT DISTINCT 'no id' AS fault, coalesce(display, '') AS what FROM «families» WHERE {blank('id')}
UNION ALL SELECT DISTINCT 'no vendor', id FROM «families» WHERE {blank('vendor')} AND NOT {blank('id')}
UNION ALL SELECT DISTINCT 'no display name', id FROM «families» WHERE {blank('display')} AND NOT {blank('id')}
UNION ALL SELECT 'repeated id', id FROM «families» WHERE NOT {blank('id')} GROUP BY id HAVING count(DISTINCT entry) > 1"""


def vendor_rows(d: Dialect) -> str:
    """A vendor table by key: vendor, display, scheme, key."""
    return f"SELECT DISTINCT id AS vendor, display, scheme, {X.vendor_key(d, 'alias')} AS key FROM «vendors»"


def family_rows(d: Dialect) -> str:
    """A family table by key: place, family, vendor, display, key, compact, is_model."""
    return f"SELECT DISTINCT entry AS place, id AS family, vendor, display, {X.product_key(d, 'name')} AS key, {X.compact_key(X.product_key(d, 'name'))} AS compact, is_model FROM «families»"


@operator("names")
def vendor_keys(d: Dialect) -> str:
    """names (name) with key, and key without its legal form."""
    return f"SELECT name, key, {X.without_legal_form(d, 'key')} AS bare FROM (SELECT DISTINCT name, {X.vendor_key(d, 'name')} AS key FROM «names»)"


def _within(d: Dialect, keys: str, known: str, least: int) -> str:
    """(key, run): which known keys of `least` letters or more occur as whole words within keys. Runs of words are no longer than the longest known key, a table of one row, and meet by equality."""
    longest = f"(SELECT coalesce(max({d.size(d.split('key', ' '))}), 0) AS longest FROM {known}) o"
    runs = d.unnest(f"(SELECT DISTINCT k.key, o.longest FROM {keys} k CROSS JOIN {longest} WHERE k.key <> '' AND o.longest > 0) y", d.word_runs("key", "longest"), "run")
    return f"SELECT DISTINCT r.key, r.run FROM (SELECT key, run FROM {runs}) r JOIN (SELECT DISTINCT key FROM {known} WHERE length(key) >= {least}) v ON r.run = v.key"


@operator("names", "vendors")
def lookup_vendors(d: Dialect) -> str:
    """names (name) with vendor, matched and method: by key, by key without legal form, or by the longest known key of four letters or more within it (ties by key)."""
    return f"""
WITH n AS (SELECT name, key, {X.without_legal_form(d, 'key')} AS bare FROM (SELECT DISTINCT name, {X.vendor_key(d, 'name')} AS key FROM «names») WHERE key <> ''),
v AS ({vendor_rows(d)}),
hits AS (
  SELECT name, vendor, n.key AS matched, 'exact' AS method, 0 AS place FROM n JOIN v ON n.key = v.key
  UNION ALL SELECT name, vendor, bare, 'suffix_trimmed', 1 FROM n JOIN v ON bare = v.key WHERE bare <> n.key
  UNION ALL SELECT n.name, v.vendor, v.key, 'token_subset', 2 FROM n JOIN ({_within(d, 'n', 'v', 4)}) w ON n.key = w.key JOIN v ON w.run = v.key),
best AS (SELECT name, {d.first_by(d.struct(vendor='vendor', matched='matched', method='method'), d.struct(a='place', b='-length(matched)', c='matched'))} AS b FROM hits GROUP BY name)
SELECT a.name, b.vendor AS vendor, b.matched AS matched, coalesce(b.method, 'none') AS method FROM (SELECT DISTINCT name FROM «names») a LEFT JOIN best ON a.name = best.name"""


@operator("names", "families")
def lookup_families(d: Dialect) -> str:
    """names (vendor, name) with family, display, its vendor (of_vendor), matched, method and via_model.

    The whole key is tried first, then the known keys of three letters or more within it, longest first. Each is looked
    up as a model, an alias, a compact model and a compact alias; with a vendor only its families count, without one
    only an unambiguous key.
    """
    vendor = "coalesce(n.vendor, '')"
    return f"""
WITH f AS ({family_rows(d)}),
n AS (SELECT DISTINCT vendor, name, {X.product_key(d, 'name')} AS key FROM «names»),
t AS (
  SELECT vendor, name, key AS try, 'exact' AS method, 0 AS len FROM n WHERE key <> ''
  UNION ALL SELECT n.vendor, n.name, w.run, 'token_subset', -length(w.run) FROM n JOIN ({_within(d, 'n', 'f', 3)}) w ON n.key = w.key),
hits AS (
  SELECT n.vendor, n.name, n.try, n.method, n.len, f.family, f.display, f.vendor AS of_vendor, f.place, f.is_model, CASE WHEN f.key = n.try THEN 1 - f.is_model ELSE 3 - f.is_model END AS step
  FROM t n JOIN f ON f.compact = {X.compact_key('n.try')} WHERE {vendor} = '' OR f.vendor = {vendor}),
picked AS (
  SELECT vendor, name, try, method, len, step, count(DISTINCT family) AS families, {d.first_by('family', 'place')} AS family, {d.first_by('display', 'place')} AS display, {d.first_by('of_vendor', 'place')} AS of_vendor, max(is_model) AS is_model
  FROM hits GROUP BY vendor, name, try, method, len, step),
best AS (
  SELECT vendor, name, {d.first_by(d.struct(family='family', display='display', of_vendor='of_vendor', matched='try', method='method', via_model='is_model = 1'), d.struct(a="CASE WHEN method = 'exact' THEN 0 ELSE 1 END", b='len', c='try', d='step'))} AS b
  FROM picked WHERE coalesce(vendor, '') <> '' OR families = 1 GROUP BY vendor, name)
SELECT n.vendor, n.name, b.family AS family, b.display AS display, b.of_vendor AS of_vendor, b.matched AS matched, coalesce(b.method, 'none') AS method, coalesce(b.via_model, false) AS via_model
FROM n LEFT JOIN best ON n.name = best.name AND coalesce(n.vendor, '') = coalesce(best.vendor, '')"""


def _parsed(d: Dialect) -> str:
    """CTEs of every parser's reading of «codes»; the last is `every` (code, vendor, family, model, normalized, confidence, parser)."""
    e = lambda p, g: d.extract("key", p, g)
    mlfb, rockwell = "^([0-9][A-Z]{2}[0-9]?)([0-9A-Z]{4,})$", "^([125][0-9]{3})([A-Z]?)([0-9A-Z]{2,})$"
    # Shapes of order codes.
    fx, cpu = "^FX([0-9])([A-Z]+)", "^([RQLF])([0-9]{2,3})([A-Z]*)CPU"
    return f"""k AS (SELECT DISTINCT code, {X.catalog_key(d, "coalesce(code, '')")} AS key FROM «codes»),
s AS (
  SELECT code, {e(mlfb, 1)} AS g, {e(mlfb, 2)} AS rest FROM k WHERE length(key) >= 8),
siemens AS (
  SELECT code, CASE WHEN g = '6GK6' THEN 'ruggedcom' ELSE 'siemens' END AS vendor, CASE WHEN g = '6ES7' THEN coalesce(tf, line) ELSE line END AS family,
    CASE WHEN g = '6ES7' THEN nullif(tm, '') END AS model, CASE WHEN length(rest) < 11 THEN g || rest ELSE g || ' ' || substring(rest, 1, 3) || '-' || substring(rest, 4, 5) || '-' || substring(rest, 9) END AS normalized,
    CASE WHEN g = '6ES7' AND tf IS NOT NULL THEN 90 ELSE 60 END AS confidence, 'siemens-mlfb' AS parser
  FROM (SELECT *, {d.lookup('g', L.SIEMENS_GROUPS)} AS line, {d.lookup('substring(rest, 1, 3)', [(a, b) for a, b, _ in L.SIEMENS_TYPES])} AS tf, {d.lookup('substring(rest, 1, 3)', [(a, c) for a, _, c in L.SIEMENS_TYPES])} AS tm FROM s) x WHERE line IS NOT NULL),
r AS (
  SELECT code, {e(rockwell, 1)} AS p, {e(rockwell, 2)} AS l, {e(rockwell, 3)} AS rest FROM k WHERE length(key) >= 6),
r2 AS (
  SELECT code, CASE WHEN long_line IS NOT NULL THEN p || l ELSE p END AS platform, CASE WHEN long_line IS NOT NULL THEN rest ELSE l || rest END AS suffix, coalesce(long_line, line) AS line
  FROM (SELECT *, {d.lookup('p || l', L.ROCKWELL_PLATFORMS)} AS long_line, {d.lookup('p', L.ROCKWELL_PLATFORMS)} AS line FROM r) x),
rockwell AS (
  SELECT code, 'rockwell-automation' AS vendor, line AS family, CASE WHEN suffix LIKE 'L%' THEN suffix END AS model, platform || '-' || suffix AS normalized,
    CASE WHEN {d.lookup("platform || substring(suffix, 1, 2)", [(a + b, c) for a, b, c in L.ROCKWELL_SERIES])} IS NOT NULL THEN 90 ELSE 70 END AS confidence, 'rockwell-catalog' AS parser
  FROM r2 WHERE line IS NOT NULL),
melsec AS (
  SELECT code, 'mitsubishi-electric' AS vendor, CASE WHEN f1 = '5' THEN 'MELSEC iQ-F' WHEN f1 <> '' THEN 'MELSEC-F' ELSE {d.lookup('c1', L.MELSEC_SERIES)} END AS family,
    CASE WHEN f1 <> '' THEN 'FX' || f1 || f2 ELSE c1 || c2 || c3 || 'CPU' END AS model, CASE WHEN f1 <> '' THEN 'FX' || f1 || f2 ELSE c1 || c2 || c3 || 'CPU' END AS normalized, 85 AS confidence, 'mitsubishi-catalog' AS parser
  FROM (SELECT code, {e(fx, 1)} AS f1, {e(fx, 2)} AS f2, {e(cpu, 1)} AS c1, {e(cpu, 2)} AS c2, {e(cpu, 3)} AS c3 FROM k WHERE length(key) >= 4) x WHERE f1 <> '' OR c1 <> ''),
every AS (SELECT * FROM siemens UNION ALL SELECT * FROM rockwell UNION ALL SELECT * FROM melsec)"""


def sniffed(texts: DataFrame, vendor_table: DataFrame, parsers: DataFrame) -> DataFrame:
    """texts (id, text) with vendor and code, by sniff_texts and the lookups that it needs."""
    texts = written(texts.select("id", "text"))
    named = written(lookup_vendors(texts.select(F.col("text").alias("name")), vendor_table))
    candidates = written(code_candidates(texts))
    of_text = texts.join(named.select(F.col("name").alias("text"), F.col("vendor").alias("for_vendor")), "text", "left").select("id", "for_vendor")
    codes = written(parse_codes_for_vendor(candidates.join(of_text, "id").select("code", "for_vendor"), parsers))
    return sniff_texts(texts, named, candidates, codes)


FIELDS = ["vendor", "family", "model", "normalized", "confidence", "parser"]


def _best(d: Dialect, table: str, keys: str, order: str) -> str:
    return f"SELECT {keys}, {d.first_by(d.struct(**{c: c for c in FIELDS}), order)} AS b FROM {table} GROUP BY {keys}"


@operator("codes")
def parse_order_codes(d: Dialect) -> str:
    """codes (code) with vendor, family, model, normalized, confidence and parser of the most confident parser (ties by parser's name)."""
    return f"""
WITH {_parsed(d)},
best AS ({_best(d, 'every', 'code', d.struct(a='-confidence', b='parser'))})
SELECT k.code, {', '.join(f'b.{c} AS {c}' if c != 'confidence' else 'CAST(b.confidence AS double) / 100 AS confidence' for c in FIELDS)} FROM k LEFT JOIN best ON k.code = best.code"""


@operator("codes", "parsers")
def parse_codes_for_vendor(d: Dialect) -> str:
    """codes (code, for_vendor) as parse_order_codes, by the vendor's parsers alone, the first that reads the code; vendors without any, and no vendor, take all."""
    return f"""
WITH {_parsed(d)},
asked AS (SELECT DISTINCT code, for_vendor FROM «codes»),
own AS (SELECT DISTINCT vendor FROM «parsers»),
tried AS (
  SELECT a.code, a.for_vendor, {', '.join(f'e.{c}' for c in FIELDS)}, p.place AS place FROM asked a JOIN «parsers» p ON a.for_vendor = p.vendor JOIN every e ON a.code = e.code AND p.parser = e.parser
  UNION ALL SELECT a.code, a.for_vendor, {', '.join(f'e.{c}' for c in FIELDS)}, -e.confidence FROM asked a JOIN every e ON a.code = e.code LEFT JOIN own ON a.for_vendor = own.vendor WHERE own.vendor IS NULL),
best AS ({_best(d, 'tried', 'code, for_vendor', d.struct(a='place', b='parser'))})
SELECT a.code, a.for_vendor, {', '.join(f'b.{c} AS {c}' if c != 'confidence' else 'CAST(b.confidence AS double) / 100 AS confidence' for c in FIELDS)} FROM asked a LEFT JOIN best ON a.code = best.code AND a.for_vendor IS NOT DISTINCT FROM best.for_vendor"""


#: A token in parentheses that may be an order code.
IN_PARENTHESES = "[(]([0-9A-Za-z][0-9A-Za-z ./-]{5,})[)]"


@operator("names")
def bracketed_codes(d: Dialect) -> str:
    """names (id, place, name) with tokens in parentheses of six characters or more: id, at (place and order) and code."""
    found = d.extract_all("coalesce(name, '')", IN_PARENTHESES, 1)
    return f"SELECT id, place, x.at AS at, trim(x.code) AS code FROM {d.unnest(f'(SELECT id, place, {found} AS found FROM «names») y', _placed(d, 'found'), 'x')}"


def _placed(d: Dialect, a: str) -> str:
    """An array's elements with their places, from 1."""
    return f"CASE WHEN {d.size(a)} > 0 THEN {d.map(d.count_to(f'greatest({d.size(a)}, 1)'), 'i', d.struct(at='i', code=d.get(a, 'i - 1')))} END"


@operator("bracketed", "codes")
def order_codes_in_names(d: Dialect) -> str:
    """The first token in parentheses of a thing's names that a parser reads (id, code). codes: what parse_order_codes gives for them."""
    return f"SELECT b.id, {d.first_by('b.code', d.struct(a='b.place', b='b.at'))} AS code FROM «bracketed» b JOIN «codes» c ON b.code = c.code WHERE c.vendor IS NOT NULL GROUP BY b.id"


@operator("texts")
def code_candidates(d: Dialect) -> str:
    """texts (id, text) with what might be an order code in them (id, code): words of six characters or more and pairs of neighbours within a clause, without marks around them."""
    mark = r"^[.:\x22\x27]+|[.:\x22\x27]+$"
    bare = lambda x: d.replace_all(x, mark, "")
    clauses = d.split(d.replace_all("coalesce(text, '')", "[;\n\r()]", ","), ",")
    words = d.keep(d.split(d.replace_all("clause", "[ \t\f]+", " "), " "), "w", "w <> ''")
    bares = d.map("words", "w", bare("w"))
    single = f"SELECT id, w AS code FROM {d.unnest('b', 'bares', 'w')} WHERE length(w) >= 6"
    pairs = d.map(d.numbers("1", f"greatest({d.size('bares')} - 1, 1)"), "i", f"CASE WHEN {d.get('bares', 'i - 1')} <> '' AND {d.get('bares', 'i')} <> '' THEN {d.get('bares', 'i - 1')} || ' ' || {d.get('bares', 'i')} END")
    return f"""
WITH c AS (SELECT id, clause FROM {d.unnest('«texts»', clauses, 'clause')}),
w AS (SELECT id, {words} AS words FROM c),
b AS (SELECT id, {bares} AS bares FROM w WHERE {d.size('words')} > 0)
SELECT DISTINCT id, code FROM ({single} UNION ALL SELECT id, p AS code FROM {d.unnest('b', pairs, 'p')} WHERE p IS NOT NULL) x"""


@operator("texts", "vendors", "candidates", "codes")
def sniff_texts(d: Dialect) -> str:
    """texts (id, text) with the vendor that they name, its display name, and the order code in them.

    vendors: lookup_vendors of the texts with display; candidates: code_candidates; codes: parse_codes_for_vendor of
    (code, vendor of the text). A code must agree with the vendor; without one its reading must be sure (0.8 or more).
    The surest reading counts, then the shortest candidate.
    """
    return f"""
WITH t AS (SELECT t.id, v.vendor FROM «texts» t LEFT JOIN «vendors» v ON t.text = v.name),
k AS (
  SELECT t.id, {d.first_by('c.code', d.struct(a='-p.confidence', b='length(c.code)', c='c.code'))} AS code
  FROM t JOIN «candidates» c ON t.id = c.id JOIN «codes» p ON c.code = p.code AND t.vendor IS NOT DISTINCT FROM p.for_vendor
  WHERE p.confidence IS NOT NULL AND CASE WHEN t.vendor IS NULL THEN p.confidence >= 0.8 ELSE coalesce(p.vendor, '') IN ('', t.vendor) END GROUP BY t.id)
SELECT t.id, t.vendor, k.code FROM t LEFT JOIN k ON t.id = k.id"""


@operator("identities", "codes", "vendors", "families")
def normalize_identities(d: Dialect) -> str:
    """identities (id, vendor_raw, vendor, product_raw, product, family, model, catalog_number, firmware) made canonical, with the steps taken and a note.

    The order code comes first; the vendor is the first resolved of the code's vendor, vendor_raw, vendor and
    product_raw, else empty; family and model fill up from the code; the family is the first resolved of product_raw,
    product, model and family, and may name the vendor; the version is cleaned. codes, vendors and families are the
    lookups' results for the strings that occur. steps: an array (field, was, now, method).
    """
    spots = [("a", "product_raw"), ("b", "product"), ("c", "model"), ("d", "family")]
    family = lambda a, c: d.struct(display=f"{a}.display", vendor=f"{a}.of_vendor", method=f"{a}.method", was=f"v.{c}")
    places = [("code_vendor", "code_vendor", "'exact'"), ("a.vendor", "i.vendor_raw", "a.method"), ("b.vendor", "i.own_vendor", "b.method"), ("p.vendor", "i.product_raw", "p.method")]
    found = d.get(d.keep(d.array(*(d.struct(vendor=v, was=w, method=m) for v, w, m in places)), "x", "x.vendor IS NOT NULL"), 0)
    step = lambda field, was, now, method: d.struct(field=f"'{field}'", was=was, now=now, method=method)
    clean = X.clean_version(d, "firmware")
    steps = d.array(
        f"CASE WHEN code_vendor IS NOT NULL THEN {step('catalog_number', 'code', 'catalog_number', "'exact'")} END",
        f"CASE WHEN of.vendor IS NOT NULL THEN {step('vendor', 'of.was', 'of.vendor', 'of.method')} WHEN got.vendor IS NOT NULL THEN {step('vendor', 'got.was', 'got.vendor', 'got.method')} END",
        f"CASE WHEN got.display IS NOT NULL THEN {step('family', 'got.was', 'got.display', 'got.method')} END",
        f"CASE WHEN {clean} <> firmware THEN {step('firmware', 'firmware', clean, "'exact'")} END",
    )
    return f"""
WITH i AS (
  SELECT i.id, nullif(trim(i.catalog_number), '') AS code, coalesce(nullif(i.vendor_raw, ''), i.vendor) AS vendor_raw, i.vendor AS own_vendor, coalesce(nullif(i.product_raw, ''), i.product) AS product_raw, nullif(i.product, '') AS product,
    coalesce(nullif(i.family, ''), c.family) AS family, coalesce(nullif(i.model, ''), c.model) AS model, coalesce(c.normalized, i.catalog_number) AS catalog_number, c.vendor AS code_vendor, i.firmware
  FROM «identities» i LEFT JOIN «codes» c ON trim(i.catalog_number) = c.code),
v AS (
  SELECT i.*, {found} AS of FROM i
  LEFT JOIN «vendors» a ON i.vendor_raw = a.name LEFT JOIN «vendors» b ON i.own_vendor = b.name LEFT JOIN «vendors» p ON i.product_raw = p.name),
f AS (
  SELECT v.*, {d.get(d.keep(d.array(*(family(a, c) for a, c in spots)), 'x', 'x.display IS NOT NULL'), 0)} AS got FROM v
  {" ".join(f"LEFT JOIN «families» {a} ON v.{c} = {a}.name AND coalesce(v.of.vendor, '') = coalesce({a}.vendor, '')" for a, c in spots)})
SELECT id, coalesce(of.vendor, got.vendor) AS vendor, vendor_raw, coalesce(product, got.display) AS product, product_raw, coalesce(got.display, family) AS family, model, catalog_number, {clean} AS firmware,
  {d.keep(steps, 's', 's IS NOT NULL')} AS steps, CASE WHEN of.vendor IS NULL AND got.vendor IS NULL AND coalesce(vendor_raw, '') <> '' THEN 'vendor "' || vendor_raw || '" has no entry in the table' END AS note FROM f"""
