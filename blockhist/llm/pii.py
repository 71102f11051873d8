"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

DataFrame functions only. The matches of an expression and the pieces between them come from the
same scan of the Java engine, so positions are running sums of their lengths; nothing is searched
twice and no position is found by scanning from the start of the text again.

The expressions are written so that no text makes them slow: where a run of characters cannot be
entered in its middle they say so (look-behind, end of the last match), and repetitions that need
no way back are possessive. What they match stays the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import empty, let, running
from .names import free_name

SPAN = "struct<kind:string,start:int,end:int,text:string,score:double>"
#: Characters of context on either side.
CONTEXT = 48
#: Spans of at least this score are reported.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """``prior`` is the score of a bare match, ``confirmed`` what a passed check adds."""
    name: str
    pattern: str
    check: str | None
    prior: float
    confirmed: float
    words: str
    needs: str


#: Kinds in the order of reports. The first four are the base: a match that passes its check is
#: always reported, context only moves its score. The others need their checksum or their context.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         None, 0.85, 0.0, "mail|contact|kontakt|correo|courriel|write to|from", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "ip", 0.2, 0.4, "ip|host|server|addr|login|dirección", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "card", 0.2, 0.5, "card|visa|credit|karte|carte|tarjeta|payment", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone", 0.2, 0.4, "phone|call|tel|fax|mobil|handy|téléphone|teléfono", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "iban", 0.1, 0.6,
         "iban|account|konto|compte|cuenta|bank", ""),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None, 0.35, 0.0,
         "ssn|social security|sozialversicherung|sécurité sociale|seguridad social", "-"),
]
BASE = [k.name for k in KINDS[:4]]
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"


def luhn(digits: Column) -> Column:
    """Whether 1 to 20 decimal digits pass the Luhn test."""
    padded = F.lpad(digits, 20, "0")
    twice = F.translate(padded, "0123456789", "0246813579")
    total = sum((F.substring(padded if i % 2 == 0 else twice, i, 1).cast("int") for i in range(1, 21)), F.lit(0))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97 (first four characters moved to the end)."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(acc, c):
        value = F.ascii(c)
        return F.when(value >= 65, (acc * 100 + value - 55) % 97).otherwise((acc * 10 + value - 48) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _passes(check: str | None, text: Column) -> Column:
    if check == "ip":
        return text.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if check == "card":
        digits = F.translate(text, " -", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if check == "phone":
        return F.length(F.translate(text, "+ ().-", "")).between(9, 15)
    if check == "iban":
        account = F.translate(text, " ", "")
        return F.when(F.length(account).between(15, 34), mod97(account)).otherwise(F.lit(False))
    return F.lit(True)


def proposals(text: Column, kind: Kind) -> Column:
    """ARRAY<SPAN> of the matches of one kind that pass their check, in order of start."""
    pattern = F.lit(kind.pattern)

    def spans(found):
        def placed(pieces):
            lengths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
            ends = running(lengths, F.lit(0), lambda a, b: a + b, "int")

            def span(m, i, end):
                near = F.lower(F.concat_ws(" ", F.substring(F.get(pieces, i), -CONTEXT, CONTEXT),
                                           F.substring(F.get(pieces, i + 1), 1, CONTEXT)))
                score = (F.lit(kind.prior + kind.confirmed)
                         + F.when(near.rlike(rf"(?<!\p{{L}})(?:{kind.words})"), 0.15).otherwise(0.0))
                return F.struct(F.lit(kind.name).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"),
                                m.alias("text"), F.round(score, 2).alias("score"))
            return let(ends, lambda e: F.transform(found, lambda m, i: span(m, i, F.get(e, i))))
        checked = F.filter(let(F.split(text, kind.pattern, -1), placed), lambda s: _passes(kind.check, s["text"]))
        if kind.name not in BASE:
            checked = F.filter(checked, lambda s: s["score"] >= THRESHOLD)
        return F.when(F.size(found) > 0, checked).otherwise(empty(SPAN))
    found = let(F.regexp_extract_all(text, pattern, 0), spans)
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(empty(SPAN)) if kind.needs else found


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` (text and any others) with one more column, the array ``pii`` (or ``pii_`` if that name
    is taken) of kind, start, end, text, score: by kind in the order of KINDS, then by start.

    Positions count code points, ``end`` is exclusive. A null or empty text has an empty array. Every
    row stands for itself, so repeated rows give the same array and an empty table no rows.
    """
    out = free_name(docs, "pii")
    text = F.coalesce("text", F.lit(""))
    arrays = {f"{out}_{k.name}": proposals(text, k) for k in KINDS}
    found = docs.withColumns(arrays)
    return found.select(*docs.columns, F.concat(*arrays).alias(out))


def merged(spans: Column) -> Column:
    """ARRAY<STRUCT<start, end, kind>>: overlapping spans joined, in order of start."""
    def heads(s):
        def joined(reach):
            first = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                             lambda i: F.when(i == 0, True).otherwise(F.get(s, i)["start"] >= F.get(reach, i - 1)))
            return let(first, lambda f: F.transform(f, lambda h, k: F.struct(
                F.get(s, h)["start"].alias("start"),
                F.get(reach, F.coalesce(F.get(f, k + 1), F.size(s)) - 1).alias("end"),
                F.get(s, h)["kind"].alias("kind"))))
        reach = running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b), "int")
        return let(reach, joined)
    kind = "struct<start:int,end:int,kind:string>"
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(ordered, heads)).otherwise(empty(kind))


#: Code points of a cell of text while spans are cut out; see ``masked``.
CELL = 4096


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every group of overlapping spans replaced by its first kind, as in ``[EMAIL]``.

    The text is cut into cells, so that a span is reached from the start of its cell instead of the
    start of the text.
    """
    def cells(all_spans):
        def cell(c, j):
            base = j * CELL
            inside = F.filter(all_spans, lambda m: (m["start"] < base + CELL) & (m["end"] > base))

            def cut(own):
                def before(m, i):
                    done = F.when(i == 0, base).otherwise(F.get(own, i - 1)["end"]) - base
                    tag = F.when(m["start"] >= base, F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]"))).otherwise(F.lit(""))
                    return F.concat(F.substring(c, done + 1, F.greatest(m["start"] - base - done, F.lit(0))), tag)
                rest = F.substring(c, F.get(own, F.size(own) - 1)["end"] - base + 1, F.lit(CELL))
                return F.when(F.size(own) > 0, F.concat(F.array_join(F.transform(own, before), ""), rest)).otherwise(c)
            return let(inside, cut)
        parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CELL}}}"), 0)
        return F.array_join(F.transform(parts, cell), "")
    return F.when(F.size(spans) > 0, let(merged(spans), cells)).otherwise(text)


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, personal data in ``text`` masked and ``n_chars``, if there is
    such a column, counted anew where the text has changed. No row is dropped; a null text stays null.

    A match that fails its check is not tried again, so masking its neighbour can leave one that now
    passes ("+1 ... 4111 1111 ..."): rows whose text has changed go through again until none has a
    span left. Every round is written; it takes digits or an @ from each of its rows, so they end.
    """
    clean, todo = None, docs
    while True:
        found = find_pii(todo)
        spans = found.columns[-1]
        new = free_name(found, "masked")
        found = found.withColumn(new, masked(F.col("text"), F.col(spans)))
        cols = {"text": F.col(new)}
        if "n_chars" in docs.columns:
            cols["n_chars"] = F.when(F.size(spans) > 0, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        changed = free_name(docs, "changed")
        out = materialise(found.select(*[cols.get(c, F.col(c)).alias(c) for c in docs.columns], (F.size(spans) > 0).alias(changed)), "redacted")
        rest = out.where(~F.col(changed)).drop(changed)
        clean = rest if clean is None else clean.unionByName(rest)
        todo = out.where(changed).drop(changed)
        if todo.isEmpty():
            return clean


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, the base as a hash and all spans as text."""
    found = find_pii(docs.select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("pii", lambda s: s["kind"].isin(*kinds))
    count = {f"n_{k}": F.size(of(k)).cast("long") for k in BASE}
    return found.select("doc_id", *[c.alias(n) for n, c in count.items()],
                        F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
