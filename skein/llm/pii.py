"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
``://`` and identifier cues. At each anchor a small deterministic parser expands to
the left and right, checks the boundaries and validates what it found. Kinds are
independent of each other: spans of different kinds may overlap, spans of one kind never.

Kinds, in the order used for sorting: email, ip, card, phone (the base kinds), then
url (with a host), iban (check digits hold), account (an identifier of at least five
digits after a cue such as ``account``, ``account no.``) and secret (a value of at least eight characters,
of any length, parts joined by dots included, after ``token``, ``password`` and the like). Words in capitals that follow an IBAN are not part of it: the length of its
country decides, else the longest expansion whose check digits hold. Spans are in code points, end exclusive.

A null text counts as empty and gives no spans, a null doc_id stays null, repeated rows
get equal results, other columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import by_row, id_text, public_id

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")

ACCOUNT_CUES = ("account", "acct", "ssn", "passport", "kontonummer", "compte", "cuenta")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"[0-9]+(?:\.[0-9]+){3}").match
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_url_rest = re.compile(r"[^\s<>\"'`{}|\\^]+").match
_break = re.compile(r"\x20").finditer
_iban = re.compile(r"[\x20:=#]{1,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])").match
_account = re.compile(
    r"(?:[\x20_-]?(?i:numbers?|num[eé]ro|número|num|nos?|nrs?|n[°º]))?"
    r"[\x20:=#.]{1,4}[\"']?([A-Z]{0,2}[0-9][0-9-]{3,}[0-9])(?![A-Za-z0-9])"
).match
_secret = re.compile(r"\x20{0,2}[:=]\x20{0,2}[\"']?([A-Za-z0-9_+/=-]+(?:\.[A-Za-z0-9_+/=-]+)*)").match
SECRET = 8  # characters of a secret at least


# Lengths of the IBAN registry.
IBAN_LENGTHS = {
    code: int(n)
    for n, codes in (
        x.split(":")
        for x in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
            "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
            "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV "
            "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for code in codes.split(",")
}


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark, kind in (("@", "email"), ("+", "phone"), ("://", "url")):
        found.add_word(mark, (kind, len(mark)))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for kind, cues in (("iban", ("iban",)), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_holds(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_end(found: str) -> int:
    """Where the IBAN that ``found`` starts with ends; 0 if there is none."""
    ends = [m.start() for m in _break(found)] + [len(found)]
    held = [e for e in ends if iban_holds(found[:e].replace(" ", ""))]
    own = [e for e in held if len(found[:e].replace(" ", "")) == IBAN_LENGTHS.get(found[:2])]
    return max(own or held, default=0)


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then in the order of KINDS."""
    found = anchors()
    out: list[tuple[int, int, int]] = []
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may start
    digit_run = -1  # last position of the digit run in hand
    for last, (kind, size) in found.iter(text):
        if kind == "digit":
            if last <= digit_run:
                continue
            digit_run = last
            while text[digit_run + 1 : digit_run + 2] in DIGITS:
                digit_run += 1
            if last >= free["ip"] and (m := _ip(text, last)):
                free["ip"] = m.end()
                if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                    out.append((last, 1, m.end()))
            if last >= free["card"] and (m := _card(text, last)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((last, 2, m.end()))
        elif kind == "email":
            start, least = last, free["email"]
            while start > least and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := _domain(text, last + 1)):
                free["email"] = m.end()
                out.append((start, 0, m.end()))
        elif kind == "phone":
            if last >= free["phone"] and (m := _phone(text, last)):
                free["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((last, 3, m.end()))
        elif kind == "url":
            colon = last - size + 1
            start, least = colon, free["url"]
            while start > least and text[start - 1] in SCHEME:
                start -= 1
            while start < colon and not text[start].isalpha():
                start += 1
            if start < colon and (m := _url_rest(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                if end > last + 1 and text[last + 1].isalnum():
                    free["url"] = end
                    out.append((start, 4, end))
        else:
            begin = last - size + 1
            if begin and text[begin - 1].isalnum() or begin < free[kind]:
                continue
            m = {"iban": _iban, "account": _account, "secret": _secret}[kind](text, last + 1)
            if not m or kind == "account" and sum(c in DIGITS for c in m[1]) < 5:
                continue
            if kind == "secret" and len(m[1]) < SECRET:
                continue
            size = iban_end(m[1]) if kind == "iban" else len(m[1])
            if size:
                free[kind] = m.start(1) + size
                out.append((m.start(1), KINDS.index(kind), free[kind]))
    return [(KINDS[k], start, end) for start, k, end in sorted(out)]


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end), one row per row of ``docs``."""
    schema = "did long, spans array<struct<kind:string,start:long,end:long>>"
    found = by_row(id_text(docs), _pairs, ["did", "text"], schema)
    return found.select(public_id(), "spans")


def _pairs():
    names = ("kind", "start", "end")
    return lambda did, text: (did, [dict(zip(names, s)) for s in spans(text)])


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find``'s spans."""

    def listed(array):
        return F.array_join(
            F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
