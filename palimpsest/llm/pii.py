"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their score.

Everything is a DataFrame expression; no row leaves the JVM. A text's matches come from two aligned calls:
``split(text, p, -1)`` gives the pieces between the matches that ``regexp_extract_all(text, p, 0)`` gives, so
positions are running sums of lengths in code points.

Defined results
    null or empty text: no spans. Rows that repeat are each answered. Other columns, whatever their names, are kept by
    :func:`with_spans` and :func:`redact`; a column named like a new one is replaced. Very long texts are scanned
    whole: quantifiers are possessive and starts are anchored, so time is linear in the text and the regex engine
    doesn't recurse. Spans that tie on their start are ordered by kind as in ``KINDS``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a span in which context words count.
CONTEXT = 40
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """One sort of personal data.

    pattern: where it may stand; needs: a character without which no match exists; prior: score of a confirmed span;
    lift: added if a context word stands near; least: spans that score less are dropped.
    """

    name: str
    pattern: str
    needs: str
    prior: float
    lift: float
    context: str
    least: float = 0.0


# A run that was entered too late can't match where its start failed, so starts inside a run are not tried, except
# where the last match ended (\G). Runs are possessive: what follows them is never in their class.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.1, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, 0.3, "ip|address|server|host|login|adresse"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", "", 0.8, 0.2, "card|visa|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, 0.2, "phone|call|tel|fax|mobile|telefon"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.9, 0.1, "iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, 0.5, "ssn|social security", 0.5),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:int,order:int,end:int,kind:string,score:double>>"


def _mod97(text: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN, digit by digit."""
    bare = F.translate(text, " ", "")
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    code = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: (acc * F.when(c >= "A", 100).otherwise(10) + code(c)) % 97,
    )


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", F.translate(match, " -", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _mod97(match) == 1
    return F.lit(True)


def _spans(text: Column, order: int) -> Column:
    """The confirmed spans of one kind, in order."""
    kind = KINDS[order]
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    near = lambda piece: F.lower(piece).rlike(rf"(?:^|[^a-z])(?:{kind.context})(?:[^a-z]|$)")
    parts = F.zip_with(
        F.transform(pieces, lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("tail"), F.left(p, F.lit(CONTEXT)).alias("head"))),
        matches,
        lambda p, m: F.struct(p["gap"].alias("gap"), p["tail"].alias("tail"), p["head"].alias("head"), m.alias("m")),
    )
    # Each match sees the piece before and, through the accumulator, is completed by the piece after it.
    lifted = lambda hit: F.round(kind.prior + F.when(hit, kind.lift).otherwise(0.0), 3)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        late = acc["open"].isNotNull() & near(x["head"])
        closed = F.when(acc["open"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["open"]["start"].alias("start"), F.lit(order).alias("order"), acc["open"]["end"].alias("end"), F.lit(kind.name).alias("kind"), lifted(acc["open"]["near"] | late).alias("score"))))
        )
        end = start + F.length(x["m"])
        opened = F.when(
            x["m"].isNotNull() & _confirmed(kind.name, x["m"]),
            F.struct(start.alias("start"), end.alias("end"), near(x["tail"]).alias("near")),
        )
        return F.struct(F.coalesce(end, start).alias("at"), opened.alias("open"), closed.alias("done"))

    zero = F.struct(
        F.lit(0).alias("at"),
        F.lit(None).cast("struct<start:int,end:int,near:boolean>").alias("open"),
        F.from_json(F.lit("[]"), SPAN).alias("done"),
    )
    spans = F.aggregate(parts, zero, step, lambda acc: acc["done"])
    if kind.least:
        spans = F.filter(spans, lambda s: s["score"] >= kind.least)
    found = F.size(matches) > 0
    if kind.needs:
        found = F.contains(text, F.lit(kind.needs)) & found
    return F.when(found, spans).otherwise(F.from_json(F.lit("[]"), SPAN))


def with_spans(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``into``: an array of (start, order, end, kind, score), by start and kind; ends are exclusive."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [f"__{into}_{k.name}" for k in KINDS]
    each = docs.withColumns({n: _spans(whole, i) for i, n in enumerate(names)})
    return each.withColumn(into, F.array_sort(F.concat(*names))).drop(*names)


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every span of personal data replaced by ``[KIND]``; spans that overlap become one.

    The columns stay as they were, except that ``count``, if named, gets the new length of texts that change. Texts
    without personal data, and null texts, are not touched.
    """
    found = with_spans(docs, text, "__pii")
    whole = F.col(f"`{text}`")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        piece = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        head = F.slice(acc, 1, F.size(acc) - 1)
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(piece)))

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,kind:string>>")
    merged = found.withColumn("__pii", F.aggregate("__pii", empty, merge))
    spans = F.col("__pii")
    cleaned = F.concat(
        F.array_join(
            F.transform(
                spans,
                lambda s, i: F.concat(
                    F.substring(whole, F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])),
                    F.lit("["), F.upper(s["kind"]), F.lit("]"),
                ),
            ),
            "",
        ),
        F.substring(whole, F.element_at(spans, -1)["end"] + 1, F.length(whole)),
    )
    out = merged.withColumn(text, F.when(F.size(spans) > 0, cleaned).otherwise(whole))
    if count:
        length = F.length(F.col(f"`{text}`")).cast(docs.schema[count].dataType)
        out = out.withColumn(count, F.when(F.size(spans) > 0, length).otherwise(F.col(f"`{count}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans, all spans, and their scores."""
    found = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("pii", lambda s: s["order"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(render(base), 256).alias("base_sha256"),
        render(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
