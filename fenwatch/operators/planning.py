"""Planning of probes and review of their audit: expansion of targets, plans, deny rules, estimates and the rule that ends a run. Nothing here opens a connection."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.functions.dialect import Dialect, Operator, operator


def _number(d: Dialect, ip: str) -> str:
    part = lambda i: f"CAST({d.get(d.split(ip, '.'), i)} AS bigint)"
    return f"({part(0)} * 16777216 + {part(1)} * 65536 + {part(2)} * 256 + {part(3)})"


def _address(n: str) -> str:
    step = lambda k: f"CAST(CAST(floor({n} / {k}) AS bigint) % 256 AS string)"
    return f"{step(16777216)} || '.' || {step(65536)} || '.' || {step(256)} || '.' || {step(1)}"


#: Addresses that one run may cover. A wider block is a mistyped digit rather than a wish.
MOST_TARGETS = 4096
OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _bounds(d: Dialect) -> str:
    """«specs» (spec) with kind, and for IPv4 the first and last number; fault says why one is refused."""
    quad = OCTET + "([.]" + OCTET + "){3}"
    part = lambda sep, i: f"trim(coalesce({d.get(d.split('spec', sep), i)}, ''))"
    bits = f"try_cast({part('/', 1)} AS int)"
    power = f"CAST(power(2, 32 - coalesce({bits}, 32)) AS bigint)"
    base, low, high = _number(d, part("/", 0)), _number(d, part("-", 0)), _number(d, part("-", 1))
    is_quad = lambda x: d.matches(x, f"^{quad}$")
    return f"""
k AS (
  SELECT spec, CASE WHEN contains(spec, ':') THEN 'ipv6' WHEN contains(spec, '/') THEN 'block' WHEN contains(spec, '-') THEN 'range' ELSE 'address' END AS kind FROM (SELECT DISTINCT trim(spec) AS spec FROM «specs» WHERE trim(spec) <> '') x),
v AS (
  SELECT *, CASE kind WHEN 'ipv6' THEN true WHEN 'block' THEN {is_quad(part('/', 0))} AND coalesce({bits} BETWEEN 0 AND 32, false) WHEN 'range' THEN {is_quad(part('-', 0))} AND {is_quad(part('-', 1))} ELSE {is_quad('spec')} END AS valid FROM k),
b AS (
  SELECT *, CASE WHEN NOT valid OR kind = 'ipv6' THEN NULL WHEN kind = 'block' THEN CAST(floor({base} / {power}) AS bigint) * {power} + CASE WHEN {bits} <= 30 THEN 1 ELSE 0 END WHEN kind = 'range' THEN {low} ELSE {_number(d, 'spec')} END AS lo,
    CASE WHEN NOT valid OR kind = 'ipv6' THEN NULL WHEN kind = 'block' THEN (CAST(floor({base} / {power}) AS bigint) + 1) * {power} - 1 - CASE WHEN {bits} <= 30 THEN 1 ELSE 0 END WHEN kind = 'range' THEN {high} ELSE {_number(d, 'spec')} END AS hi FROM v)"""


@operator("specs")
def target_faults(d: Dialect) -> str:
    """Why specs are refused (spec, fault): no address, block or range; a range that ends before it starts; or more addresses than a run may cover."""
    return f"""
WITH {_bounds(d)}
SELECT spec, CASE WHEN NOT valid THEN 'not an address, a block or a range' WHEN hi < lo THEN 'ends before it starts' ELSE 'covers more than {MOST_TARGETS} addresses' END AS fault
FROM b WHERE NOT valid OR hi < lo OR hi - lo + 1 > {MOST_TARGETS}"""


@operator("specs")
def expand_specs(d: Dialect) -> str:
    """specs (spec: an IPv4 address, a CIDR block or a range a-b) as distinct addresses with their number; blocks of four or more lose their first and last address. Every spec is expanded whole."""
    return f"""
WITH {_bounds(d)},
n AS (SELECT DISTINCT lo + x - 1 AS n FROM {d.unnest('(SELECT * FROM b WHERE hi >= lo) c', d.count_to('hi - lo + 1'), 'x')})
SELECT n, {_address('n')} AS address FROM n"""


def expand_targets(specs: DataFrame) -> DataFrame:
    """specs (spec) as distinct addresses (address, n: its number, null for IPv6); a spec that is refused, or more than MOST_TARGETS addresses in all, is an error, and nothing is left out.

    IPv6 addresses, blocks and ranges are expanded on the executors.
    """
    faults = target_faults(specs).limit(20).collect()
    if faults:
        raise ValueError("; ".join(f"{r['spec']} {r['fault']}" for r in faults))

    def six(batches):
        for batch in batches:
            out, wrong = [], []
            for spec in batch.column("spec").to_pylist():
                try:
                    if "-" in spec:
                        lo, hi = (int(ipaddress.IPv6Address(x.strip())) for x in spec.split("-", 1))
                    else:
                        net = ipaddress.IPv6Network(spec, strict=False)
                        lo, hi = int(net.network_address), int(net.broadcast_address)
                    if not 0 <= hi - lo < MOST_TARGETS:
                        raise ValueError(spec)
                    out += [str(ipaddress.IPv6Address(x)) for x in range(lo, hi + 1)]
                except ValueError:
                    wrong.append(spec)
            yield pa.RecordBatch.from_arrays([pa.array([*out, *wrong], pa.string()), pa.array([False] * len(out) + [True] * len(wrong))], names=["address", "wrong"])

    more = specs.select(F.trim("spec").alias("spec")).where("contains(spec, ':')").mapInArrow(six, "address string, wrong boolean")
    bad = more.where("wrong").limit(20).collect()
    if bad:
        raise ValueError(f"{', '.join(r['address'] for r in bad)}: not an address, a block or a range, or too many addresses")
    out = expand_specs(specs).select("address", "n").unionByName(more.select("address", F.lit(None).cast("bigint").alias("n")).distinct())
    if out.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"the targets cover more than {MOST_TARGETS} addresses")
    return out


@operator("targets", "templates", "services")
def plan_probes(d: Dialect) -> str:
    """targets x templates where the inventory shows the template's port open, as an equality join over services (asset_id, port, transport)."""
    return "SELECT DISTINCT t.asset_id, p.template, p.protocol, p.port, p.packets FROM «targets» t JOIN «services» s ON t.asset_id = s.asset_id JOIN «templates» p ON s.port = p.port AND s.transport = p.transport"


@operator("rules")
def deny_rule_faults(d: Dialect) -> str:
    """Why deny rules (place: their order, id, reason, vendor, family, product) are refused (place, id, fault: the first of a rule).

    A rule has an id that no rule before it has and a reason, or what it skips could not be looked up; and it names a
    vendor, family or product, or it would deny everything. Nulls are empty.
    """
    return """
WITH r AS (SELECT place, coalesce(id, '') AS id, trim(coalesce(reason, '')) AS reason, coalesce(vendor, '') || coalesce(family, '') || coalesce(product, '') AS named FROM «rules»),
f AS (SELECT id, min(place) AS first FROM r WHERE trim(id) <> '' GROUP BY id)
SELECT r.place, r.id, CASE WHEN trim(r.id) = '' THEN 'no id' WHEN r.place > f.first THEN 'an earlier rule has the id' WHEN reason = '' THEN 'no reason' ELSE 'names no vendor, family or product' END AS fault
FROM r LEFT JOIN f ON r.id = f.id WHERE trim(r.id) = '' OR r.place > f.first OR reason = '' OR named = ''"""


def checked_rules(rules: DataFrame) -> DataFrame:
    """Deny rules as they are; a rule that is refused is an error."""
    faults = deny_rule_faults(rules).orderBy("place").limit(20).collect()
    if faults:
        raise ValueError("; ".join(f"rule {r['place']} ({r['id']}): {r['fault']}" for r in faults))
    return rules


@operator("plan", "identities", "rules")
def deny_probes(d: Dialect) -> str:
    """plan rows (asset_id, template, protocol, packets) with the first deny rule (place, vendor, family, product, template, protocol) that fits.

    A rule's vendor is equal, whatever the case; its family and product are within the asset's; where it names a template
    or protocol the plan's is one of them, a row each. What a rule leaves empty fits all. Assets without identity fit none.
    Rules are a table that people write, so each asset's rules are found by vendor, or among those without one.
    """
    has = lambda rule, *own: f"(coalesce({rule}, '') = '' OR {' OR '.join(f"contains(lower(coalesce({c}, '')), lower({rule}))" for c in own)})"
    fits = f"""{has('r.family', 'i.family')} AND {has('r.product', 'i.product', 'i.product_raw')}
    AND ((coalesce(r.template, '') = '' AND coalesce(r.protocol, '') = '') OR r.template = p.template OR r.protocol = p.protocol)"""
    known = "coalesce(i.vendor, '') || coalesce(i.family, '') || coalesce(i.product, '') || coalesce(i.product_raw, '') <> ''"
    return f"""
WITH r AS (SELECT *, lower(coalesce(vendor, '')) AS of_vendor FROM «rules»),
i AS (SELECT asset_id, lower(coalesce(vendor, '')) AS of_vendor, vendor, family, product, product_raw FROM «identities»),
w AS (
  SELECT p.asset_id, p.template, r.place FROM «plan» p JOIN i ON p.asset_id = i.asset_id JOIN r ON i.of_vendor = r.of_vendor WHERE r.of_vendor <> '' AND {known} AND {fits}
  UNION ALL SELECT p.asset_id, p.template, r.place FROM «plan» p JOIN i ON p.asset_id = i.asset_id CROSS JOIN (SELECT * FROM r WHERE of_vendor = '') r WHERE {known} AND {fits}),
h AS (SELECT asset_id, template, min(place) AS rule FROM w GROUP BY asset_id, template)
SELECT p.asset_id, p.template, p.packets, h.rule IS NULL AS allowed, h.rule FROM «plan» p LEFT JOIN h ON p.asset_id = h.asset_id AND p.template = h.template"""


# Ratings of risk in their order, and the bounds of a policy as (setting, least, most, default).
RISKS = [("safe", 0), ("caution", 1), ("lab-only", 2)]
POLICY = [("delay_s", 0.05, 10.0, 0.25), ("packets_per_s", 0.1, 4.0, 4.0), ("connect_s", 0.25, 30.0, 3.0), ("read_s", 0.25, 30.0, 3.0), ("abort_rate", 0.01, 0.2, 0.2), ("least_attempts", 1.0, None, 5.0)]


def rated_at_most(plan: DataFrame, allowed: str) -> DataFrame:
    """plan rows (risk) whose rating is at most the allowed one; unknown ratings never pass."""
    ranks = dict(RISKS)
    if allowed not in ranks:
        raise ValueError(f"{allowed} is not one of {', '.join(ranks)}")
    return plan.where(F.col("risk").isin([r for r, k in ranks.items() if k <= ranks[allowed]]))


def policy_faults(policies: DataFrame) -> DataFrame:
    """Every setting of policies (id, settings: map of numbers, risk) beyond its bounds (id, setting, fault); settings that are not given have their default."""
    checks = []
    for name, least, most, default in POLICY:
        x = F.coalesce(F.col("settings")[name], F.lit(default))
        checks.append(F.when(x < least, F.struct(F.lit(name).alias("setting"), F.format_string(f"%s is below {least}", x).alias("fault"))))
        if most is not None:
            checks.append(F.when(x > most, F.struct(F.lit(name).alias("setting"), F.format_string(f"%s is above {most}", x).alias("fault"))))
    checks.append(F.when(~F.coalesce(F.col("risk"), F.lit("safe")).isin([r for r, _ in RISKS]), F.struct(F.lit("risk").alias("setting"), F.lit("unknown rating").alias("fault"))))
    return policies.select("id", F.explode(F.array_compact(F.array(*checks))).alias("f")).select("id", "f.*")


def template_faults(templates: DataFrame, protocols: list[str]) -> DataFrame:
    """What is wrong with probe templates (id, summary, protocol, port, transport, risk, risk_note, steps: array of struct with purpose and request), a row per fault (id, fault)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    faults = [
        F.when(~F.coalesce(F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "the id is not small words joined by hyphens"),
        F.when(blank(F.col("summary")), "no summary"),
        F.when(~F.coalesce(F.col("protocol").isin(protocols), F.lit(False)), "the protocol has no decoder"),
        F.when(~F.coalesce(F.col("port").between(1, 65535), F.lit(False)), "no such port"),
        F.when(~F.coalesce(F.col("transport").isin("tcp", "udp"), F.lit(False)), "neither tcp nor udp"),
        F.when(~F.coalesce(F.col("risk").isin([r for r, _ in RISKS]), F.lit(False)), "unknown rating"),
        F.when((F.col("risk") != "safe") & blank(F.col("risk_note")), "a rating without a reason"),
        F.when(F.coalesce(F.size("steps"), F.lit(0)) < 1, "no steps"),
        F.when(F.exists("steps", lambda s: blank(s["purpose"])), "a step without a purpose"),
    ]
    return templates.select("id", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def select_templates(templates: DataFrame, ids: list[str]) -> DataFrame:
    """Templates of some ids, all where none are given; an id without a template is an error."""
    if not ids:
        return templates
    found = templates.where(F.col("id").isin(ids))
    missing = sorted(set(ids) - {r["id"] for r in found.select("id").collect()})  # at most as many as were asked for
    if missing:
        raise ValueError(f"no template named {', '.join(missing)}")
    return found


def estimate_plan(plan: DataFrame, packets_per_s: float = 4.0, delay_s: float = 0.25, allowed: str = "safe") -> DataFrame:
    """Probes, packets and seconds of the plan's rows (packets, risk) whose risk is allowed: all packets but the first wait for the longer of the delay and the rate's gap."""
    rows = rated_at_most(plan, allowed) if "risk" in plan.columns else plan
    gap = max(delay_s, 1 / packets_per_s if packets_per_s > 0 else 0.0)
    total = F.coalesce(F.sum("packets"), F.lit(0)).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("probes"), total.alias("packets")).withColumn("seconds", F.round(F.greatest(F.col("packets") - 1, F.lit(0)) * gap).cast("bigint"))


# ---- the audit of a run

AUDIT = "timestamp timestamp, kind string, target string, transport string, template_id string, protocol string, risk string, step int, steps int, purpose string, outcome string, request string, response string, duration_ms long, detail string"
SENT, FAILED = ("answered", "no-answer", "unreachable"), ("no-answer", "unreachable")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Records of runs' audits in JSON lines (run: the file; place: the line's order by time, then by where it stands), without headers and summaries; bytes as binary."""
    rows = spark.read.schema(AUDIT).json(path).withColumn("run", F.col("_metadata.file_path")).where("outcome IS NOT NULL")
    raw = lambda c: F.try_to_binary(F.replace(F.col(c), F.lit(" "), F.lit("")), F.lit("hex"))
    return rows.withColumn("request", raw("request")).withColumn("response", raw("response")).withColumn("place", F.struct("timestamp", F.monotonically_increasing_id().alias("at")))


def audit_outcomes(audit: DataFrame) -> DataFrame:
    """What was sent (run, place, failed), for abort_points."""
    return audit.where(F.col("outcome").isin(*SENT)).select("run", "place", F.col("outcome").isin(*FAILED).alias("failed"))


def audit_totals(audit: DataFrame) -> DataFrame:
    """Per run: sent, answered, failed and skipped."""
    return audit.groupBy("run").agg(*(F.count_if(c).alias(n) for n, c in (("sent", F.col("outcome").isin(*SENT)), ("answered", F.col("outcome") == "answered"), ("failed", F.col("outcome").isin(*FAILED)), ("skipped", F.col("outcome").startswith("skipped")))))


def abort_rule(attempts: int = 5, share: float = 0.2) -> Operator:
    """outcomes (run, place, failed) by run: how many were sent, failed, and the first place where over `share` had failed after `attempts` or more."""
    return Operator(
        lambda d: f"""
WITH r AS (
  SELECT run, place, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY place ROWS UNBOUNDED PRECEDING) AS f, row_number() OVER (PARTITION BY run ORDER BY place) AS n FROM «outcomes»)
SELECT run, count(*) AS sent, CAST(max(f) AS bigint) AS failed, min(CASE WHEN n >= {int(attempts)} AND CAST(f AS double) / n > {float(share)!r} THEN place END) AS abort_at FROM r GROUP BY run""",
        ("outcomes",),
    )


#: By the usual policy.
abort_points = abort_rule()


@operator("exchanges")
def group_by_host(d: Dialect) -> str:
    """exchanges (place, host) with the order in which hosts first appear, and places within a host."""
    return "SELECT place, host, min(place) OVER (PARTITION BY host) AS host_first, row_number() OVER (PARTITION BY host ORDER BY place) AS step FROM «exchanges»"
