"""Keys and clean-ups of names, versions and order codes, as expressions of a dialect."""

from __future__ import annotations

from fenwatch.functions.dialect import Dialect

# Letters that become two letters, and letters that become one.
EXPANDED = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("æ", "ae")]
ACCENTED, PLAIN = "åøàáâãèéêëìíîïñòóôõùúûýÿçćčşšžł", "aoaaaaeeeeiiiinoooouuuyycccssz" + "l"
# Legal forms at the end of a company name.
LEGAL_FORMS = "inc incorporated corp corporation co company ltd limited llc lp llp gmbh mbh ag sa se bv nv oy oyj ab as asa spa srl plc kg kgaa pty pte holdings holding".split()
# Labels before a version, in the order in which they are tried.
VERSION_LABELS = ["firmware version", "firmware rev", "firmware", "fw version", "fw rev", "fw", "version", "ver.", "ver", "rev.", "rev", "release"]
# Words that name no product.
GENERIC_WORDS = "all control controller controllers cpu device devices family firmware gateway gateways hardware hmi module modules plc product products router routers series server servers software switch switches system systems unit units version versions".split()


def collapse(d: Dialect, x: str) -> str:
    """Trimmed, with single spaces."""
    return f"trim({d.replace_all(x, '[ \\t\\r\\n\\f]+', ' ')})"


def vendor_key(d: Dialect, x: str) -> str:
    """Small letters, digits, & and + between single spaces; accents folded."""
    out = f"lower({x})"
    for a, b in EXPANDED:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({d.replace_all(f"translate({out}, '{ACCENTED}', '{PLAIN}')", '[^a-z0-9&+]+', ' ')})"


def without_legal_form(d: Dialect, key: str) -> str:
    """A vendor key without legal forms at its end, and then without a last & or `and`; one word always stays."""
    if d.spark:  # Java's matcher recurses once a word from the start, so a long text needs the form that begins at its tail; a key begins with a word, which stays
        tail = "(?: (?:{}))+$"
        return d.replace_all(d.replace_all(key, tail.format("|".join(LEGAL_FORMS)), ""), tail.format("&|and"), "")
    shape = "^([^ ]+(?: [^ ]+)*?)(?: (?:{}))+$"
    once = d.replace_all(key, shape.format("|".join(LEGAL_FORMS)), d.group(1))
    return d.replace_all(once, shape.format("&|and"), d.group(1))


def product_key(d: Dialect, x: str) -> str:
    return f"trim({d.replace_all(f'lower({x})', '[^a-z0-9+!]+', ' ')})"


def compact_key(key: str) -> str:
    return f"replace({key}, ' ', '')"


def catalog_key(d: Dialect, x: str) -> str:
    return d.replace_all(f"upper({x})", "[^A-Z0-9]+", "")


def clean_version(d: Dialect, x: str) -> str:
    """A version without one label before it and without marks around it."""
    labels = "|".join(v.replace(".", "[.]") for v in VERSION_LABELS)
    bare = d.replace_all(f"trim({x})", f"^(?i:{labels})", "")
    return collapse(d, d.replace_all(bare, "^[ \\t:=,;()\\[\\]]+|[ \\t:=,;()\\[\\]]+$", ""))


def phrase_in(text: str, phrase: str) -> str:
    """Whether a key holds another key as whole words."""
    return f"contains(concat(' ', {text}, ' '), concat(' ', {phrase}, ' '))"


def informative(d: Dialect, key: str) -> str:
    """Whether a key has a word that names something."""
    words = ", ".join(f"'{w}'" for w in GENERIC_WORDS)
    return f"({d.size(d.keep(d.split(key, ' '), 'w', f"w <> '' AND w NOT IN ({words})"))} > 0)"


def asset_id(d: Dialect, ipv4: str, ipv6: str, mac: str) -> str:
    """16 hex digits over an asset's addresses; host names don't count."""
    parts = " || '|' || ".join(f"coalesce({x}, '')" for x in (ipv4, ipv6, mac))
    return f"substring({d.sha256(f'lower({parts})')}, 1, 16)"


def mac_text(d: Dialect, x: str) -> str:
    """Twelve hex digits as small letters with colons; null otherwise."""
    digits = d.replace_all(f"lower({x})", "[^0-9a-f]", "")
    pairs = d.replace_all(digits, "([0-9a-f][0-9a-f])", d.group(1) + ":")
    return f"CASE WHEN length({digits}) = 12 THEN substring({pairs}, 1, 17) END"


def identity_label(vendor: str = "vendor", vendor_raw: str = "vendor_raw", product: str = "product", product_raw: str = "product_raw", family: str = "family", firmware: str = "firmware") -> str:
    """Vendor, product and firmware of an identity in one line."""
    first = lambda *x: f"coalesce({', '.join(f"nullif({c}, '')" for c in x)})"
    return f"coalesce(nullif(concat_ws(' ', {first(vendor, vendor_raw)}, {first(product, product_raw, family)}, nullif({firmware}, '')), ''), 'unknown')"


def product_label(d: Dialect, name: str, vendor: str, version: str, other: str) -> str:
    """Vendor, name and version of an advisory's product; what the name begins or ends with is not said twice. `other` where all are empty."""
    begins = f"substring(lower({name}), 1, length({vendor})) = lower({vendor})"
    ends = f"substring(lower({name}), greatest(length({name}) - length({version}) + 1, 1), length({name})) = lower({version})"
    return f"coalesce(nullif(concat_ws(' ', CASE WHEN NOT coalesce({begins}, false) THEN nullif({vendor}, '') END, nullif({name}, ''), CASE WHEN NOT coalesce({ends}, false) THEN nullif({version}, '') END), ''), {other})"


def ipv4_key(d: Dialect, x: str) -> str:
    """A dotted quad as a number; null if it is none."""
    part = lambda i: f"CAST({d.get(d.split(x, '.'), i)} AS bigint)"
    quad = "^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
    return f"CASE WHEN {d.matches(f"coalesce({x}, '')", quad)} THEN {part(0)} * 16777216 + {part(1)} * 65536 + {part(2)} * 256 + {part(3)} END"


def usable_port(x: str) -> str:
    """A port's text as a number from 1 to 65535; null otherwise."""
    return f"CASE WHEN try_cast(trim({x}) AS int) BETWEEN 1 AND 65535 THEN try_cast(trim({x}) AS int) END"


def file_name(d: Dialect, x: str) -> str:
    """A safe file name for an id: small letters, digits, dots and hyphens; with eight digits of the id's digest where it had to change."""
    bare = d.replace_all(d.replace_all(f"lower({x})", "[^a-z0-9.-]", "-"), "^[.-]+|[.-]+$", "")
    name = f"coalesce(nullif({bare}, ''), 'source')"
    return f"CASE WHEN {name} = {x} THEN {x} ELSE {name} || '-' || substring({d.sha256(x)}, 1, 8) END"


# Where advisories of an agency stand, by how their ids begin.
ADVISORY_PAGES = [("icsma-", "https://www.cisa.gov/news-events/ics-medical-advisories/"), ("icsa-", "https://www.cisa.gov/news-events/ics-advisories/"), ("icsv-", "https://www.cisa.gov/news-events/ics-advisories/")]


def advisory_url(x: str) -> str:
    """The page of an advisory by its id; null if the id's kind has none."""
    key = f"lower(trim({x}))"
    return f"CASE {' '.join(f"WHEN {key} LIKE '{a}%' THEN '{b}' || {key}" for a, b in ADVISORY_PAGES)} END"


# What tiers and levels mean; others are Unclassified and Unplaced.
TIER_TEXTS = [("confirmed", "Vendor, product and version matched, and the version is inside an affected range"), ("likely", "Vendor and product matched, but the version could not be compared"), ("possible", "Only the vendor and a product family matched")]
LEVEL_TEXTS = [
    ("L0", "Process: sensors and actuators"), ("L1", "Basic control: PLC, RTU, IED"), ("L2", "Area supervisory: HMI and local SCADA"), ("L3", "Site operations: historian, engineering workstation"),
    ("L3.5", "Industrial DMZ: brokers and jump hosts"), ("L4", "Enterprise network"), ("L5", "Internet and external services"),
]


def described(d: Dialect, x: str, texts: list[tuple], other: str) -> str:
    return f"coalesce({d.lookup(f"coalesce({x}, '')", texts)}, '{other}')"
