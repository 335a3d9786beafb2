"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs,
schemes, plus signs, digits and identifier cues; deterministic local parsers
expand each anchor to the boundaries of an email, address or account and
validate it.

Kinds, in this order: email, ip, card, phone (the base, leftmost and not
overlapping within a kind), then what the method adds: url (a scheme with user
data), iban (length of its country and mod 97, with or without a cue), ssn (cue
or shape 3-2-4 with valid areas) and account (an identifier cue followed by a
number of 6 to 20 characters).  Added spans never replace base spans, and one
that lies inside a base span is left out.

Defined results: null and empty texts have no spans; whole texts are read,
however long, in linear time; repeated rows give repeated results; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order of the contract, then the added ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = ("account", "acct", "iban", "ssn", "social security", "passport", "customer id", "member id")
IBAN_LENGTH = {code: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
    33: "RU"}.items() for code in codes.split()}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_CODE = re.compile(r"[A-Z]{2}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?: ?(?i:number|no\.?|id|#))?[ :#=]{1,3}([A-Z]{0,3}[0-9][A-Z0-9-]{5,19})(?![A-Za-z0-9])")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def automaton():
    """Anchors and what each calls for, to be run over ``_lower`` of a text."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", "at")
    a.add_word("+", "plus")
    for d in "0123456789":
        a.add_word(d, "digit")
    for s in SCHEMES:
        a.add_word(s, "scheme")
    for c in CUES:
        a.add_word(c, "cue")
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """ASCII letters in lower case, every code point in its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Local part back from the at-sign, not beyond ``floor``; labels after."""
    start = at
    while start > floor and text[start - 1] in _LOCAL_CHARS:
        start -= 1
    m = _DOMAIN.match(text, at + 1)
    return (start, m.end()) if start < at and m else None


def _ips(text: str, run: re.Match) -> Iterator[tuple[int, int]]:
    """Four numbers each, left to right; a part above 255 drops the four."""
    parts, at = run.group().split("."), run.start()
    for k in range(0, len(parts) - 3, 4):
        four = parts[k:k + 4]
        end = at + sum(map(len, four)) + 3
        # compared as text first: a part may have any number of digits
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            yield at, end
        at = end + 1


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban(text: str, start: int, cued: bool) -> int | None:
    """End of the account number at ``start``, as long as its country has it.
    Without a cue in front it must stand alone.  Behind a cue, a country that is
    not listed ends where a token does, the longest valid one."""
    m = _IBAN.match(text, start)
    if not m:
        return None
    n = IBAN_LENGTH.get(text[start:start + 2])
    ends = [i + 1 for i in range(start, m.end()) if text[i] != " "]
    if n:
        ends = ends[n - 1:n]
    else:
        ends = [e for e in reversed(ends) if text[e:e + 1] == " " or e == m.end()] if cued else []
    if not cued and (text[start - 1:start] in _ALNUM or ends and text[ends[0]:ends[0] + 1] in _ALNUM):
        return None
    return next((e for e in ends if _iban_valid(text[start:e])), None)


def find_spans(text: str, anchors) -> list[tuple[int, int, int]]:
    """Spans ``(start, kind index, end)`` sorted; code points, end exclusive."""
    spans: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = 0
    extra: list[tuple[int, int, int]] = []
    ssn = cued = False
    for last, what in anchors.iter(_lower(text)):
        if what == "digit":
            code = text[last - 2:last]
            if code in IBAN_LENGTH or cued and _CODE.fullmatch(code):
                end = _iban(text, last - 2, cued)
                if end:
                    extra.append((last - 2, 5, end))
            if last >= ip_end:
                m = _DOTTED.match(text, last)
                ip_end = m.end()
                spans += [(a, 1, b) for a, b in _ips(text, m)]
            if last >= card_end:
                m = _DIGITS.match(text, last)
                if m:
                    card_end = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append((last, 2, card_end))
                    ssn = ssn or "-" in m.group()
        elif what == "at":
            if last >= email_end:
                found = _email(text, last, email_end)
                if found:
                    email_end = found[1]
                    spans.append((found[0], 0, found[1]))
        elif what == "plus":
            if last >= phone_end:
                m = _PHONE.match(text, last)
                if m:
                    phone_end = m.end()
                    if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                        spans.append((last, 3, phone_end))
        elif what == "scheme":
            m = _URL.match(text, last + 1)
            if m:
                extra.append((last + 1, 4, m.end()))
        else:
            cued = True
            m = _ACCOUNT.match(text, last + 1)
            if m:
                extra.append((m.start(1), 7, m.end(1)))
    if ssn:
        extra += [(m.start(), 6, m.end()) for m in _SSN.finditer(text)
                  if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    spans.sort()
    if extra:
        spans = _merge(spans, sorted(set(extra)))
    return spans


def _merge(base: list[tuple[int, int, int]], extra: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Adds the extra spans that lie in no base span and overlap no earlier extra one."""
    kept, k, base_end, last = [], 0, 0, 0
    for span in extra:
        while k < len(base) and base[k][0] <= span[0]:
            base_end = max(base_end, base[k][2])
            k += 1
        if span[2] > base_end and span[0] >= last:
            kept.append(span)
            last = span[2]
    return sorted(base + kept)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base
    spans and all spans joined; ``n_added`` counts what the method adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = find_spans(text.as_py() or "", anchors)
                base = [s for s in spans if s[1] < len(BASE)]
                rows.append((*[sum(s[1] == k for s in base) for k in range(len(BASE))],
                             hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                             len(spans) - len(base)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=t) for c, t in zip(cols, kinds)]],
                names=[id_col, *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col("text").cast("string").alias("_text")).mapInArrow(
        run, f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
             "spans string, n_added long")
