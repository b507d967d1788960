"""Format-preserving pseudonyms for personal data.

Values that pass their kind's check (card numbers by their check digit and issuer range, IBANs by their remainder,
calendar dates, IPv4 octets, IPv6 groups, telephone numbers, social security numbers, e-mail addresses, secrets in hex)
are permuted by a keyed Feistel network within their own format. The permutation depends on the key, the kind and the
format only, so a value has the same pseudonym in every document and different values have different ones; numbers that
fail the check stay. Pseudonyms pass the check of their kind, so with the key they can be turned back. It works row by row:
nothing is shuffled and nothing is remembered, and the time is in proportion to a text's length.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import ship

ROUNDS = 10
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 ... size - 1, or its inverse: a Feistel network over two nearly equal parts, walked until
    it lands inside."""
    if size < 2:
        return value
    width = max(2, (size - 1).bit_length())
    left_bits = width // 2
    right_bits = width - left_bits
    bits = (left_bits, right_bits)

    def mask(r: int, x: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{size}|{r}|{x}".encode(), key=key, digest_size=16).digest()
        return int.from_bytes(h, "big") & (1 << bits[r % 2]) - 1

    while True:  # an even number of rounds leaves the parts in their places
        a, b = value >> right_bits, value & (1 << right_bits) - 1
        if back:
            for r in reversed(range(ROUNDS)):
                a, b = b ^ mask(r, a), a
        else:
            for r in range(ROUNDS):
                a, b = b, a ^ mask(r, b)
        value = a << right_bits | b
        if value < size:
            return value


#: permute() with a key and a direction: (value, size, tweak) to the permuted value.
Permutation = Callable[[int, int, str], int]


def keyed(key: bytes, back: bool = False) -> Permutation:
    return lambda value, size, tweak: permute(value, size, key, tweak, back)


def _spread(text: str, new: str) -> str:
    """text with its digits replaced by those of new, in order; what stands between stays."""
    digits = iter(new)
    return "".join(next(digits) if c.isdigit() else c for c in text)


def _luhn(digits: str) -> int:
    """The check digit that follows digits."""
    total = sum((2 * int(c) - 9 * (c > "4")) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _card(m: str, perm: Permutation) -> str | None:
    d = re.sub(r"\D", "", m)
    low, high = (int(d[0]), int(d[0])) if d[0] in "3456" else (2221, 2720)  # what issuers' numbers begin with
    k = len(str(low))
    if not 13 <= len(d) <= 19 or not low <= int(d[:k]) <= high or len(set(d)) == 1 or _luhn(d[:-1]) != int(d[-1]):
        return None
    rest, body, first = len(d) - 1 - k, d[:-1], d[0]
    while True:  # the beginning stays within its range, and the check digit follows from the rest
        v = perm((int(body[:k]) - low) * 10**rest + int(body[k:]), (high - low + 1) * 10**rest, "card" + first)
        body = str(low + v // 10**rest) + str(v % 10**rest).zfill(rest)
        new = body + str(_luhn(body))
        if len(set(new)) > 1:
            return _spread(m, new)


def _phone(m: str, perm: Permutation) -> str | None:
    country = re.match(r"\+\d{1,3}|0\d", m)  # what says that it is a telephone number stays
    head = country.group() if country else ""
    d = re.sub(r"\D", "", m[len(head) :])
    if not 7 <= len(d) <= 12:
        return None
    return head + _spread(m[len(head) :], str(perm(int(d), 10 ** len(d), "phone")).zfill(len(d)))


_AREAS = [str(x).zfill(3) for x in range(1, 900) if x != 666]


def _ssn(m: str, perm: Permutation) -> str | None:
    area, group, serial = m.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    v = perm((_AREAS.index(area) * 99 + int(group) - 1) * 9999 + int(serial) - 1, len(_AREAS) * 99 * 9999, "ssn")
    return f"{_AREAS[v // 9999 // 99]}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"


def _ip(m: str, perm: Permutation) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    v = perm(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _hex(m: str, perm: Permutation, tweak: str) -> str | None:
    """Hex digits permuted together where they stand; letters of both cases are no secret's."""
    if m.lower() != m and m.upper() != m:
        return None
    digits = re.sub("[^0-9a-fA-F]", "", m)
    new = iter(format(perm(int(digits, 16), 16 ** len(digits), tweak), "x").zfill(len(digits)))
    out = "".join(next(new) if c in "0123456789abcdefABCDEF" else c for c in m)
    return out if m.lower() == m else out.upper()


def _ipv6(m: str, perm: Permutation) -> str | None:
    """Groups keep their widths and the gap its place; `::` with a letter or two around it is no address."""
    groups = [g for g in m.split(":") if g]
    if len(groups) < 3 or not any(c.isdigit() for c in m):
        return None
    try:
        ipaddress.IPv6Address(m)
    except ValueError:
        return None
    return _hex(m, perm, "ipv6" + re.sub("[0-9a-fA-F]", "x", m))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(m: str, perm: Permutation) -> str | None:
    bare = m.replace(" ", "")
    check = lambda body: f"{98 - _iban_rest(body + bare[:2] + '00'):02d}"
    if not 15 <= len(bare) <= 34 or check(bare[4:]) != bare[2:4]:
        return None
    body = "".join(_by_kind(bare[4:], perm, "iban"))
    chars = iter(bare[:2] + check(body) + body)
    return "".join(c if c == " " else next(chars) for c in m)


def _by_kind(text: str, perm: Permutation, tweak: str) -> str:
    """text with its small letters, capitals and digits permuted, each kind among its own places."""
    out = list(text)
    for name, alphabet in (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789")):
        at = [k for k, c in enumerate(text) if c in alphabet]
        if at:
            n, v = len(alphabet), 0
            for k in at:
                v = v * n + alphabet.index(text[k])
            v = perm(v, n ** len(at), tweak + name + ",".join(map(str, at)))
            for k in reversed(at):
                v, rest = divmod(v, n)
                out[k] = alphabet[rest]
    return "".join(out)


def _email(m: str, perm: Permutation) -> str | None:
    local, _, domain = m.rpartition("@")
    return _by_kind(local, perm, "email") + "@" + domain


def _secret(m: str, perm: Permutation) -> str | None:
    return _hex(m, perm, "hex")


#: Months as they are written in the languages of the corpus (fixed values), and short English ones. May is a full name.
_MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "short": "Jan Feb Mar Apr - Jun Jul Aug Sep Oct Nov Dec".split(),
}
_NAMED = "|".join(sorted({x for names in _MONTHS.values() for x in names if x != "-"}, key=lambda x: (-len(x), x)))


@functools.cache
def _dates(day_width: int, month_width: int, after: int, months: tuple[int, ...] = tuple(range(1, 13))) -> list[int]:
    """Days of 1900 to 2099, as ordinals, that are written with so many digits, from the day after `after` of a month on."""
    all_days = ((k, datetime.date.fromordinal(k)) for k in range(_FIRST, _LAST + 1))
    return [k for k, d in all_days if (day_width == 2 or d.day < 10) and (month_width == 2 or d.month < 10) and d.day > after and d.month in months]


@functools.cache
def _two_digit_days(months: tuple[int, ...]) -> list[int]:
    return [k for k in _dates(2, 2, 0, months) if datetime.date.fromordinal(k).day >= 10]


def _date(m: str, perm: Permutation) -> str | None:
    a, mark, b, c = re.fullmatch(r"(\d+)([-./])(\d+)[-./](\d+)", m).groups()
    orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy") if mark == "/" else ("dmy",)
    for order in orders:
        part = dict(zip(order, (a, b, c), strict=True))
        try:
            day = datetime.date(*(int(part[x]) for x in "ymd")).toordinal()
        except ValueError:
            continue
        if not _FIRST <= day <= _LAST:
            return None
        # month first is read only where the day is over 12, and such dates stay among themselves
        among = _dates(len(part["d"]), len(part["m"]), 12 if order == "mdy" else 0)
        tweak = "date" if len(part["d"]) == len(part["m"]) == 2 and order != "mdy" else f"date{order}{len(part['d'])}{len(part['m'])}"
        new = datetime.date.fromordinal(among[perm(bisect.bisect_left(among, day), len(among), tweak)])
        text = {"y": f"{new.year:04d}", "m": str(new.month).zfill(len(part["m"])), "d": str(new.day).zfill(len(part["d"]))}
        return mark.join(text[x] for x in order)
    return None


@functools.cache
def _months(lang: str) -> tuple[int, ...]:
    """Months whose names tell the language: what two share belongs to the first."""
    before = {x for k in list(_MONTHS)[: list(_MONTHS).index(lang)] for x in _MONTHS[k]}
    return tuple(k + 1 for k, x in enumerate(_MONTHS[lang]) if x != "-" and x not in before)


def _suffix(day: int) -> str:
    return "th" if 10 < day < 20 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _written_date(m: str, perm: Permutation) -> str | None:
    """A day with its month's name: language, order and endings stay, and a day below 10 stays one."""
    name = re.search(_NAMED, m).group()
    lang = next(k for k, names in _MONTHS.items() if name in names)
    day, year = re.search(r"\d{1,2}(?!\d)", m), re.search(r"\d{4}", m)
    try:
        old = datetime.date(int(year.group()), _MONTHS[lang].index(name) + 1, int(day.group()))
    except ValueError:
        return None
    if not _FIRST <= old.toordinal() <= _LAST:
        return None
    among = _dates(1, 2, 0, _months(lang)) if old.day < 10 else _two_digit_days(_months(lang))
    new = datetime.date.fromordinal(among[perm(bisect.bisect_left(among, old.toordinal()), len(among), f"date {lang} {old.day < 10}")])
    out = re.sub(r"(?<!\d)\d{1,2}(st|nd|rd|th)?(?!\d)", lambda x: str(new.day).zfill(len(day.group())) + (_suffix(new.day) if x[1] else ""), m, count=1)
    return re.sub(r"\d{4}", f"{new.year:04d}", re.sub(_NAMED, _MONTHS[lang][new.month - 1], out, count=1))


#: Kinds in the order in which they are tried where more than one could begin. E-mail addresses are found from their @.
KINDS: dict[str, tuple[str, Callable[[str, Permutation], str | None]]] = {
    "secret": (r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])", _secret),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    "ipv6": (r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:(?=:))(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)", _ipv6),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _ip),
    "date": (r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])", _date),
    "written_date": (
        rf"(?<!\w)(?:(?:{_NAMED})\.? \d{{1,2}}(?:st|nd|rd|th)?(?:,| |, )\d{{4}}|\d{{1,2}}(?:st|nd|rd|th|er|\.)? (?:de )?(?:{_NAMED})\.?,?(?: de)? \d{{4}})(?!\w)", _written_date
    ),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "phone": (r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ -]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
        r"|(?<![\w+./-])0\d(?:[ .]\d{2}){4}(?![\d.,]\d|\d)|(?<![\w+./-])0[1-9]\d{1,3}[ /-]\d{5,8}(?![\d.,/-]\d|\d)", _phone),
    "card": (r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)", _card),
}
_PATTERN = lambda kinds: re.compile("|".join(f"(?P<{k}>{KINDS[k][0]})" for k in kinds))
_ANY, _MOST = _PATTERN(KINDS), _PATTERN([k for k in KINDS if k not in ("ipv6", "written_date")])
#: Without one of these a text holds no kind that _MOST hasn't.
_RARE = re.compile(r"[ ,](?:19|20)\d\d(?!\w)|:[0-9A-Fa-f]{0,4}:")
#: An address from the beginning of its run of characters on, each of which is looked at once.
_EMAIL = re.compile(r"(?<![\w.+-])([\w.+-]++)@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}")
#: Numbers and words that spaces or hyphens join: what a card number or an IBAN may be part of.
_RUN = re.compile(r"[A-Z0-9]+(?:[ -][A-Z0-9]+)*")
_CARD, _IBAN = (re.compile(KINDS[k][0]) for k in ("card", "iban"))
#: Characters of an IBAN by country.
_IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
    "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 "
    "LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
#: Without one of these a text can hold none of KINDS.
_HINT = re.compile(r"\d|@|[a-fA-F]{32}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """First and last place of the addresses of a text; they begin with a letter or digit."""
    for m in _EMAIL.finditer(text) if "@" in text else ():
        local = re.search(r"[^\W_]", m[1])
        if local:
            yield m.start() + local.start(), m.end()


#: How card numbers of 16 and 15 digits are written (fixed values).
_GROUPS = {(16,), (4, 4, 4, 4), (15,), (4, 6, 5)}


def _within(text: str, start: int, end: int, since: int, perm: Permutation) -> tuple[int, int, str, str] | None:
    """Start, end, kind and pseudonym of the card number or IBAN that begins at a separator's border in start ... end of
    text, not before `since`, and ends at another, if need be after end: card numbers in their usual groups first, then 16
    digits (15 from 34 or 37 on) before other lengths, then the first, then the longest."""
    run = _RUN.match(text, start, end + 50).group()
    tokens = [(x.start(), x.end(), x.group().isdigit()) for x in re.finditer(r"[A-Z0-9]+", run)]
    best = []
    for k, (a, _, _) in enumerate(tokens):
        if start + a >= end:
            break
        if start + a < since:
            continue
        wanted, n, digits = _IBAN_LENGTHS.get(run[a : a + 2]), 0, True
        for x, b, number in tokens[k:]:
            n, digits = n + b - x, digits and number
            if n > (wanted or 19):
                break
            value = run[a:b]
            if digits and 13 <= n and run[a] in "23456" and _CARD.fullmatch(value):
                usual = tuple(map(len, re.split("[ -]", value))) in _GROUPS and (n == 15) == bool(re.match("3[47]", value))
                best.append((2 * (not usual) + (n != (15 if re.match("3[ -]?[47]", value) else 16)), a, -b, "card", value))
            elif n == wanted and _IBAN.fullmatch(value):
                best.append((0, a, -b, "iban", value))
    for _, a, b, kind, value in sorted(best):
        new = KINDS[kind][1](value, perm)
        if new is not None:
            return start + a, start - b, kind, new
    return None


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, or with pseudonyms turned back, and how many of each kind."""
    found: dict[str, int] = {}
    if not _HINT.search(text):
        return text, found
    return _replace(text, keyed(key, back), found), found


def _replace(text: str, perm: Permutation, found: dict[str, int]) -> str:
    def put(kind: str, value: str) -> str | None:
        new = _email(value, perm) if kind == "email" else KINDS[kind][1](value, perm)
        if new is not None:
            found[kind] = found.get(kind, 0) + 1
        return new

    search = (_ANY if _RARE.search(text) else _MOST).search
    out, at, emails, m = [], 0, _emails(text), search(text)
    email, barren = next(emails, None), 0  # barren: up to there no card number or IBAN begins
    while m or email:
        if email and (m is None or email[0] <= m.start() or email[0] < at):
            (start, end), email = email, next(emails, None)
            if start >= at:
                out += [text[at:start], put("email", text[start:end])]
                at = end
                m = search(text, at) if m and m.start() < at else m
            continue
        kind, value, start, end = m.lastgroup, m.group(), m.start(), m.end()
        # digits behind a card number, or before it, may read as the number of a longer one: 16 come first
        new = None if kind == "card" and re.search("[ -]", value) else put(kind, value)
        if new is None and kind in ("card", "iban"):  # neighbours that a space joins may be numbers of their own
            inner = _within(text, start, end, barren, perm)
            if inner is None:
                barren = max(barren, end)
                end = start + re.match(r"[A-Z0-9]+", value).end()
                value = text[start:end]
            else:
                a, end, inner_kind, new = inner
                new = _replace(text[start:a], perm, found) + new
                found[inner_kind] = found.get(inner_kind, 0) + 1
        while new is None and kind == "phone" and (k := max(map(value.rfind, " .-"))) > 0:  # what follows a number may look like its end
            value, end = value[:k], start + k
            new = put(kind, value)
        out += [text[at:start], value if new is None else new]
        at = end
        m = search(text, at)
    return "".join([*out, text[at:]])


def _rows(key: bytes, back: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = functools.lru_cache(maxsize=1 << 12)(lambda t: pseudonymise(t, key, back))
        for b in batches:
            done = [(None, {}) if x is None else once(x) if len(x) < 4096 else pseudonymise(x, key, back) for x in b.column(1).to_pylist()]
            counts = pa.array([list(c.items()) for _, c in done], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([sum(c.values()) for _, c in done], pa.int64()), counts], ["doc_id", "text", "n_replaced", "kinds"])

    return run


def pseudonyms(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced and kinds (a count of each) of each row of docs (doc_id, text).

    A null text stays null and has no replacements; empty texts stay empty; a row in is a row out, whatever its doc_id.
    key: up to 64 secret bytes; the same key gives the same pseudonyms in every run. With back, pseudonyms made with that
    key become the values again. (Where a pseudonym and its neighbours happen to read as another value of some kind, that
    place isn't turned back.)
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_rows(key, back), "doc_id long, text string, n_replaced long, kinds map<string,int>")
