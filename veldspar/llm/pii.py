"""Personal data: expressions propose spans, checksums confirm them, nearby words move the score.

Base kinds (fixed contract, never dropped by the score): email, ip, card, phone.  The method adds
kinds that need stronger evidence: ``iban`` (mod-97) and ``phone_local`` (a number without country
code next to a word that announces one).  Each span has a score between 0 and 1: the kind's prior,
raised when a context word stands within ``CONTEXT`` characters, lowered for a misleading one.

Every expression is linear: quantifiers are possessive and no run is entered in its middle, so a
text of a million digits costs a million steps.  Offsets are code points, end exclusive.

Defined results: a null text is an empty one and has no spans; repeated rows each get their own
result; an empty table gives an empty result; other columns are carried, and one that has the
name of an added one is replaced, as ``withColumn`` does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import small_batches, trimmed, without

KINDS = ("email", "ip", "card", "phone", "iban", "phone_local")
BASE = KINDS[:4]
_ORDER = {k: i for i, k in enumerate(KINDS)}
CONTEXT = 40
#: Added spans below this score are not reported.
MIN_SCORE = 0.6

# Characters of the contract's expressions.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PHONE_LOCAL = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_DIGITS = re.compile(r"[^0-9]+")

# Prior score of a confirmed span, and words that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "phone_local": 0.3}
RAISES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax"),
}
LOWERS = {"ip": ("version", "release", "section"), "card": ("order", "serial", "isbn"), "phone_local": ("isbn", "serial", "order")}
UP, DOWN = 0.3, 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Same spans as a leftmost search of the whole expression, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds."""
    out = []
    if "@" in text:
        out += [(a, "email", b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), "phone", m.end()))
    return out


def score(text: str, start: int, kind: str, end: int) -> float:
    near = re.findall(r"[^\W\d_]+", text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower())
    s = PRIOR[kind]
    if any(w.startswith(RAISES[kind]) for w in near):
        s += UP
    if kind in LOWERS and any(w.startswith(LOWERS[kind]) for w in near):
        s -= DOWN
    return round(min(1.0, max(0.0, s)), 3)


def find(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed; base spans always, added ones by score."""
    text = text or ""
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    added = [(m.start(), "iban", m.end()) for m in _IBAN.finditer(text) if mod97(m[0])]
    added += [(m.start(), "phone_local", m.end()) for m in _PHONE_LOCAL.finditer(text) if not any(a < m.end() and m.start() < b for a, b in taken)]
    spans = [(a, _ORDER[k], b, score(text, a, k, b)) for a, k, b in base]
    spans += [(a, _ORDER[k], b, s) for a, k, b in added if (s := score(text, a, k, b)) >= min_score]
    return [(KINDS[k], a, b, s) for a, k, b, s in sorted(spans)]


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span (overlapping ones joined, named by the first) replaced by its kind."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double"))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(df: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE, redacted: bool = False) -> DataFrame:
    """``df`` with ``pii`` (all spans) and, if asked for, ``redacted`` (the text without them). No shuffle."""
    small_batches(df.sparkSession)
    df = without(df, "pii", *(["redacted"] if redacted else []))
    fields = [*df.schema.fields, T.StructField("pii", _SPAN), *([T.StructField("redacted", T.StringType())] if redacted else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            found, clean = [], []
            for scalar in column:
                text = scalar.as_py()
                spans = find(text, min_score)
                found.append([{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans])
                if redacted:
                    clean.append(None if text is None else redact(text, spans))
            extra = [pa.array(found, _SPAN_ARROW), *([pa.array(clean, pa.string())] if redacted else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[f.name for f in fields])

    return df.mapInArrow(trimmed(run), T.StructType(fields))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def count(kind: str):
        return F.size(F.filter("pii", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    base = joined(F.filter("pii", lambda x: x.kind.isin(*BASE)))
    return detect(docs).drop("text").select("doc_id", *(count(k) for k in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_pii": op3_pii}
ORACLES: dict[str, str] = {}
