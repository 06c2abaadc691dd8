"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, schemes, identifier cues
and the two-digit beginnings of numbers. Deterministic parsers grow each anchor to the span it
belongs to and check it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import slices, text_of

#: Kinds in the order in which spans of one start are listed; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account", "secret")

# fixed values: the base patterns
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_REST = r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Cues of account numbers and of secrets; what follows a cue is parsed.
ACCOUNT_CUES = ("iban", "IBAN", "Iban", "account", "Account", "acct", "Acct")
SECRET_CUES = ("password", "Password", "passwd", "token", "Token", "secret", "Secret", "api_key", "API_KEY", "apikey")
KEY_CUES = ("AKIA", "ASIA", "ghp_")

_DIGITS = "0123456789"
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"


def anchors() -> ahocorasick.Automaton:
    """Anchors and what each may begin or belong to."""
    found: dict[str, set[str]] = {"@": {"email"}, "://": {"login"}}
    for a in _DIGITS:
        found.setdefault("+" + a, set()).add("phone")
        for b in _DIGITS:
            found.setdefault(f"{a}.{b}", set()).add("ip")
            for between in ("", " ", "-"):
                found.setdefault(a + between + b, set()).add("card")
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("key", KEY_CUES)):
        for cue in cues:
            found.setdefault(cue, set()).add(kind)
    automaton = ahocorasick.Automaton()
    for word, kinds in found.items():
        automaton.add_word(word, (len(word), *sorted(kinds)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    text = text.replace(" ", "")
    return (15 <= len(text) <= 34
            and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1)


def finder() -> Callable[[str], list[tuple[str, int, int]]]:
    """A function that lists ``(kind, start, end)`` in code points, by start and then kind."""
    automaton = anchors()
    email_rest, ip, card, phone = (re.compile(p) for p in (EMAIL_REST, IP, CARD, PHONE))
    local = frozenset(EMAIL_LOCAL)
    digits = frozenset(_DIGITS)
    login_rest = re.compile(r"://[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(:[0-9]+)?")
    iban = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
    number = re.compile(r"[0-9](?:[\x20-]?[0-9]){7,33}(?![A-Za-z0-9])")
    account_gap = re.compile(r"(?:\x20?(?:no|number|nr|num)\b\.?)?\s{0,2}[:=#]?\s{0,2}", re.IGNORECASE)
    secret_rest = re.compile(r"\x20{0,2}[:=]\x20{0,2}[\"']?([A-Za-z0-9_+/.=-]{8,})")
    keys = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
    place = {kind: i for i, kind in enumerate(KINDS)}

    def back(text: str, at: int, least: int, members: frozenset[str]) -> int:
        while at > least and text[at - 1] in members:
            at -= 1
        return at

    def find(text: str) -> list[tuple[str, int, int]]:
        spans = []
        done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, valid or not
        for last, (length, *kinds) in automaton.iter(text):
            at = last + 1 - length
            for kind in kinds:
                if kind == "email":
                    start = back(text, at, done[kind], local)
                    if start < at and (m := email_rest.match(text, at)):
                        done[kind] = m.end()
                        spans.append((kind, start, m.end()))
                elif kind == "ip":
                    if at >= done[kind] and (m := ip.match(text, start := back(text, at, done[kind], digits))):
                        done[kind] = m.end()
                        if all(len(p) < 4 and int(p or "0") < 256 for p in (p.lstrip("0") for p in m.group().split("."))):
                            spans.append((kind, start, m.end()))
                elif kind == "card":
                    if at >= done[kind]:
                        m = card.match(text, at)
                        done[kind] = m.end()
                        plain = m.group().replace(" ", "").replace("-", "")
                        if 12 <= len(plain) <= 19 and luhn(plain):
                            spans.append((kind, at, m.end()))
                elif kind == "phone":
                    if at >= done[kind] and (m := phone.match(text, at)):
                        done[kind] = m.end()
                        if 9 <= sum(c in digits for c in m.group()) <= 15:
                            spans.append((kind, at, m.end()))
                elif kind == "login":
                    start = back(text, at, done[kind], local)
                    if start < at and (m := login_rest.match(text, at)):
                        done[kind] = m.end()
                        spans.append((kind, start, m.end()))
                elif kind == "account":
                    begin = account_gap.match(text, last + 1).end()
                    m = iban.match(text, begin)
                    if m and not valid_iban(m.group()):
                        m = None
                    m = m or number.match(text, begin)
                    if m and begin >= done[kind]:
                        done[kind] = m.end()
                        spans.append((kind, begin, m.end()))
                elif kind == "secret":
                    if last >= done["secret"] and (m := secret_rest.match(text, last + 1)):
                        done["secret"] = m.end(1)
                        spans.append(("secret", m.start(1), m.end(1)))
                elif at >= done["secret"] and (m := keys.match(text, at)):
                    done["secret"] = m.end()
                    spans.append(("secret", at, m.end()))
        spans.sort(key=lambda s: (s[1], place[s[0]]))
        return spans

    return find


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: the personal data of every row, as ``kind, start, end`` in code points.

    A null text is empty and has no spans; repeated rows and ids stay rows of their own; a text of any
    length is searched whole. Spans of different kinds may overlap, those of one kind don't.
    Other columns of ``docs`` play no part.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        names = ("kind", "start", "end")
        for batch in batches:
            for part in slices(batch, "text"):
                found = [[dict(zip(names, s, strict=True)) for s in find(t)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, span)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(search, f"doc_id {kind}, spans {SPAN_TYPE}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans written out."""
    written = "concat_ws(',', transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    base = f"filter(spans, s -> s.kind IN {BASE_KINDS})"
    return found.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.expr(written.format(spans=base)), 256).alias("base_sha256"),
        F.expr(written.format(spans="spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_pii`` replaced by ``[KIND]``; overlapping spans become one, named by the first.

    A null text stays null. All other columns stay as they are, ``n_chars`` too.
    """
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                texts = []
                for text in part.column(at).to_pylist():
                    out, upto = [], 0
                    for kind, start, end in find(text) if text else ():
                        if start >= upto:
                            out += (text[upto:start], f"[{kind.upper()}]")
                        upto = max(upto, end)
                    texts.append(text if not out else "".join(out) + text[upto:])
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(replace, docs.schema)
