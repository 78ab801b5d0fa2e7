"""PII: format-preserving Feistel pseudonyms, in Spark SQL expressions only.

Validated values are replaced by other valid values of the same format: card numbers
(Luhn), IBANs (mod 97), social security numbers, IPv4 addresses, calendar dates, telephone
numbers, e-mail addresses, and secrets (access keys, password or token assignments). A value
that fails its check stays as it is.

A value becomes a list of symbols with radices (digits 10, letters 26, octets 256, the parts
of a day number within its century, ...). Ten Feistel rounds alternate between its two halves
and add, modulo each radix, a keyed SHA-512 of the other half. That is a permutation of the
format, so equal values get equal pseudonyms in every document, different values different
ones, and the key holder can undo it. Check digits are computed anew. Separators, the first
digit of a card, the country of an IBAN, a phone's country code and an e-mail's domain stay.

The key is the caller's secret: whoever has it can undo the pseudonyms.

Nulls and edges: a null text stays null with no findings, an empty one stays empty; texts of
any length are processed whole; where patterns overlap, the one that begins first counts, of equal
beginnings the first in order of trial; repeated rows get equal pseudonyms; an empty table returns no
rows; every column except text (and n_chars, when present) passes through untouched, whatever its
name, but one called like a result (count, kinds) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import fresh

ROUNDS = 10
NAMES = "password|passwd|token|secret|api[_-]?key"
#: All values, in order of trial. Possessive repeats and boundaries keep the scan linear, and its stack flat.
PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
        rf'(?<![A-Za-z0-9])(?i:{NAMES})[ \t]*+[=:][ \t]*+"?+[A-Za-z0-9_\-]{{8,}}+',
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])",
        r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
        r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
        r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    )
)
KINDS = ("email", "key", "secret", "iban", "phone", "ip", "ssn", "date", "card")


def _q(text: str) -> str:
    return "r'" + text.replace("'", "\\'") + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """`value` computed once, under `name` in `body`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _feistel(values: str, radices: str, kind: str, key: str) -> str:
    """SQL for the permuted list of symbols."""

    def moved(half: str, radix: str, other: str) -> str:
        word = f"sha2(concat_ws('|', {_q(key)}, '{kind}', cast(i as string), array_join({other}, ',')), 512)"
        step = f"cast(conv(substr(h, 1 + 4 * (j % 32), 4), 16, 10) as int)"
        return _let("h", word, f"transform({half}, (v, j) -> cast(pmod(v + {step}, {radix}[j]) as int))")

    turn = f"if(i % 2 = 0, named_struct('l', {moved('s.l', 'rl', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 'rr', 's.l')}))"
    start = "named_struct('l', slice(vs, 1, n), 'r', slice(vs, n + 1, size(vs) + 1))"
    run = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> {turn}, s -> concat(s.l, s.r))"
    inner = _let("rl", "slice(rs, 1, n)", _let("rr", "slice(rs, n + 1, size(rs) + 1)", run))
    return _let("vs", f"transform({values}, x -> cast(x as int))", _let("rs", f"transform({radices}, x -> cast(x as int))", _let("n", "cast(ceil(size(vs) / 2) as int)", inner)))


HEX, LOW, UP = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _permuted_symbols(body: str, kind: str, key: str) -> str:
    """SQL: the letters and digits of `body`, permuted within their classes (within hexadecimal if all are)."""
    of = "(case when c between '0' and '9' then '0123456789' when c between 'a' and 'z' then '" + LOW + "' else '" + UP + "' end)"
    alphabet = f"if(hx, '{HEX}', {of})"
    values = f"transform(cs, c -> instr({alphabet}, c) - 1)"
    radices = f"transform(cs, c -> length({alphabet}))"
    back = f"array_join(transform(cs, (c, k) -> substr({alphabet}, 1 + p[k], 1)), '')"
    chars = f"filter(split(regexp_replace({body}, '[^0-9A-Za-z]', ''), ''), c -> c <> '')"
    permuted = _let("p", _feistel(values, radices, kind, key), back)
    return _let("cs", chars, _let("hx", "forall(cs, c -> c between '0' and '9' or c between 'a' and 'f') and exists(cs, c -> c >= 'a')", permuted))


def _put_back(template: str, symbols: str) -> str:
    """SQL: `template` with its letters and digits replaced, in turn, by `symbols`."""
    return f"array_join(zip_with(split({template}, '[0-9A-Za-z]', -1), filter(split({symbols}, ''), c -> c <> ''), (g, c) -> concat(g, coalesce(c, ''))), '')"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a digit string whose last digit is the check digit."""
    double = "if(length(d0) % 2 = k % 2, if(2 * cast(c as int) > 9, 2 * cast(c as int) - 9, 2 * cast(c as int)), cast(c as int))"
    listed = "filter(split(d0, ''), c -> c <> '')"
    return _let("d0", digits, f"aggregate(transform({listed}, (c, k) -> {double}), 0, (a, x) -> a + x)")


def _mod97(text: str) -> str:
    listed = f"filter(split({text}, ''), c -> c <> '')"
    return f"aggregate({listed}, 0, (a, c) -> cast(if(c between '0' and '9', (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 55) % 97) as int))"


def _card(key: str) -> str:
    inner = _permuted_symbols("substr(d, 2, length(d) - 2)", "card", key)
    new = _let("b", f"concat(substr(d, 1, 1), {inner})", f"concat(b, cast((10 - {_luhn("concat(b, '0')")} % 10) % 10 as string))")
    return _let("d", "regexp_replace(m, '[^0-9]', '')", f"if({_luhn('d')} % 10 = 0 and d rlike '[1-9]', {_put_back('m', new)}, m)")


def _iban(key: str) -> str:
    check = _let("b", _permuted_symbols("substr(a, 5)", "iban", key), f"concat(substr(a, 1, 2), lpad(cast(98 - {_mod97("concat(b, substr(a, 1, 2), '00')")} as string), 2, '0'), b)")
    return _let("a", "regexp_replace(m, ' ', '')", f"if(length(a) between 15 and 34 and {_mod97('concat(substr(a, 5), substr(a, 1, 4))')} = 1, {_put_back('m', check)}, m)")


def _ssn(key: str) -> str:
    values = "array(g[0] - 1 - if(g[0] > 666, 1, 0), g[1] - 1, g[2] - 1)"
    moved = _feistel(values, "array(898, 99, 9999)", "ssn", key)
    area = "(p[0] + 1 + if(p[0] >= 665, 1, 0))"
    new = _let("p", moved, f"concat_ws('-', lpad(cast({area} as string), 3, '0'), lpad(cast(p[1] + 1 as string), 2, '0'), lpad(cast(p[2] + 1 as string), 4, '0'))")
    valid = "g[0] between 1 and 899 and g[0] <> 666 and g[1] > 0 and g[2] > 0"
    return _let("g", "transform(split(m, '-'), x -> cast(x as int))", f"if({valid}, {new}, m)")


def _ip(key: str) -> str:
    moved = f"array_join({_feistel('g', 'array(256, 256, 256, 256)', 'ip', key)}, '.')"
    return _let("g", "transform(split(m, '[.]'), x -> cast(x as int))", f"if(forall(g, x -> x <= 255), {moved}, m)")


def _date(key: str) -> str:
    """A century's days are a product of two radices exactly: 36524 = 92 * 397, 36525 = 75 * 487."""
    shape = "case when m rlike '^[0-9]{4}-' then 'yyyy-MM-dd' when m rlike '^[0-9]{4}/' then 'yyyy/MM/dd' when m like '%/%' then 'dd/MM/yyyy' else 'dd.MM.yyyy' end"
    first = "make_date(cast(floor(year(x) / 100) * 100 as int), 1, 1)"
    last = "make_date(cast(floor(year(x) / 100) * 100 + 100 as int), 1, 1)"
    parts = "if(w = 36525, array(75, 487), array(92, 397))"
    moved = _feistel("array(cast(floor(o / q[1]) as int), o % q[1])", "q", "date", key)
    new = _let("p", moved, "date_format(date_add(f, p[0] * q[1] + p[1]), z)")
    body = _let("f", first, _let("w", f"datediff({last}, f)", _let("o", "datediff(x, f)", _let("q", parts, new))))
    return _let("z", shape, _let("x", "cast(try_to_timestamp(m, z) as date)", f"if(x is null or year(x) not between 1000 and 9899, m, {body})"))


def _whole(kind: str, key: str) -> str:
    """E-mail, key, secret, phone: a head that stays, symbols, a tail that stays."""
    head = {"email": "''", "key": "'AKIA'", "phone": "regexp_extract(m, '^[+][0-9]{1,3}', 0)", "secret": f"regexp_extract(m, {_q(rf'^(?i)(?:{NAMES})[ \t]*[=:][ \t]*"?')}, 0)"}[kind]
    tail = "concat('@', substring_index(m, '@', -1))" if kind == "email" else "''"
    body = "substr(m, length(hd) + 1, length(m) - length(hd) - length(tl))"
    return _let("hd", head, _let("tl", tail, _let("bd", body, f"concat(hd, {_put_back('bd', _permuted_symbols('bd', kind, key))}, tl)")))


def kind_sql(m: str = "m") -> str:
    tests = {
        "email": f"{m} like '%@%'",
        "key": f"{m} rlike '^AKIA[A-Z0-9]{{16}}$'",
        "secret": f"{m} rlike {_q(rf'^(?i)(?:{NAMES})[ \t]*[=:]')}",
        "phone": f"{m} rlike '^[+]'",
        "ip": f"{m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$'",
        "ssn": f"{m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'",
        "date": f"{m} rlike '^([0-9]{{4}}[-/][0-9]{{2}}[-/]|[0-9]{{2}}[./][0-9]{{2}}[./])[0-9]+$'",
        "iban": f"{m} rlike '^[A-Z]'",
    }
    return "case " + " ".join(f"when {t} then '{k}'" for k, t in tests.items()) + " else 'card' end"


def pseudonym_sql(key: str) -> str:
    """SQL for the pseudonym of the value `m`."""
    made = {k: _whole(k, key) for k in ("email", "key", "secret", "phone")} | {"ip": _ip(key), "ssn": _ssn(key), "date": _date(key), "iban": _iban(key), "card": _card(key)}
    return _let("kd", kind_sql(), "case kd " + " ".join(f"when '{k}' then {made[k]}" for k in KINDS) + " end")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_private", kinds: str | None = "private_kinds") -> DataFrame:
    """docs with every private value of `text` replaced under the secret `key`; optionally how many, and which kinds (sorted, comma-joined)."""
    found, swapped = fresh("_found", docs.columns), fresh("_swapped", docs.columns)
    matches = F.when(F.col(text).rlike("[0-9@=:]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    new = F.expr(f"transform({found}, m -> named_struct('m', m, 'kind', {kind_sql()}, 'new', {pseudonym_sql(key)}))")
    gaps = F.split(text, PATTERN, -1)
    whole = F.array_join(F.zip_with(gaps, F.col(f"{swapped}.new"), lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    out = docs.withColumn(found, matches).withColumn(swapped, F.when(F.size(found) > 0, new))
    changed = F.filter(F.col(swapped), lambda x: x["m"] != x["new"])
    made = {text: F.when(F.col(swapped).isNotNull(), whole).otherwise(F.col(text))}
    if count:
        made[count] = F.coalesce(F.size(changed), F.lit(0)).cast("long")
    if kinds:
        made[kinds] = F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(changed, lambda x: x["kind"]))), ","), F.lit(""))
    out = out.withColumns(made).drop(found, swapped)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out
