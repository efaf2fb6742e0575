"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is column expressions. A text is split at a pattern into gaps and matches by the same
left-to-right scan; running lengths of both give the places in code points. The patterns are written
so that one scan takes linear time on any text: a run of characters is entered at its first one only
(or where the last match ended), and is never given back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import id_and_text

LOCAL = "[A-Za-z0-9._%+-]"
CONTEXT_CHARS = 40
SPAN = "array<struct<kind:string,rank:int,start:bigint,end:bigint,score:double>>"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, what a text must hold to be searched at all, the score
    of a confirmed match, and words on either side of it that raise the score."""

    name: str
    pattern: str
    needs: str
    score: float
    context: str

    @property
    def raised(self) -> float:
        """The score with such a word within ``CONTEXT_CHARS`` characters before or after."""
        return round(min(1.0, self.score + 0.2), 2)


#: In the order in which spans are listed. The first four are the base kinds.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8,
         r"(?i)e-?mail|contact|write|reach|address"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.5, r"(?i)(?:^|[^a-z0-9_])ip(?:[^a-z0-9_]|$)|host|server|address|client|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, r"(?i)card|visa|master|credit|debit|pay|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"(?i)phone|tel|call|mobile|fax|cell"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "", 0.9, r"(?i)iban|bank|account|konto|transfer"),
)
BASE = ("email", "ip", "card", "phone")
#: Where spans overlap, the kind that is masked first wins.
MASK_ORDER = ("email", "iban", "ip", "card", "phone")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn: from the right, every second digit is doubled (18 counts as 9)."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(turned, i, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod_97(value: Column) -> Column:
    """Whether an account number passes its check: country and check digits last, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        worth = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substr(moved, i, F.lit(1))) - 1
        return (rest * F.when(worth > 9, 100).otherwise(10) + worth) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        number = digits(value)
        return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return mod_97(value) if kind == "iban" else F.lit(True)


def pieces(text: Column, kind: Kind) -> Column:
    """Gaps and matches in turn, as an array of (gap, hit); the last gap has no hit."""
    return F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"))


def searched(text: Column, kind: Kind) -> Column:
    return F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]")


def spans_of(text: Column, rank: int) -> Column:
    """Confirmed spans of one kind, in order."""
    kind = KINDS[rank]
    none = F.array().cast(SPAN)

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        before = F.substr(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
        near = before.rlike(kind.context) | F.substr(text, end + 1, F.lit(CONTEXT_CHARS)).rlike(kind.context)
        span = F.array(F.struct(
            F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"),
            F.when(near, F.lit(kind.raised)).otherwise(F.lit(kind.score)).alias("score"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(valid(kind.name, piece["hit"]), F.concat(state["found"], span))
                        .otherwise(state["found"]).alias("found"))

    hits = F.filter(pieces(text, kind), lambda p: p["hit"].isNotNull())
    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))
    return F.when(searched(text, kind), F.aggregate(hits, begin, step, lambda s: s["found"])).otherwise(none)


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, found``: all confirmed spans by kind, then start; places count code points.

    A null text counts as empty and has no spans. Repeated rows give equal results; other columns are
    not read.
    """
    texts = id_and_text(docs, id_column, text_column)
    return texts.select("doc_id", "text", F.concat(*(spans_of(F.col("text"), r) for r in range(len(KINDS)))).alias("found"))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of ``found``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, scores,
    score``; ``scores`` are those of the spans in percent, ``score`` is the highest of the document, 0 without spans."""
    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *map(of, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
        of("iban"), F.array_join(F.transform("found", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("score"))


def mask_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with every confirmed match in the text replaced by its kind,
    such as ``<EMAIL>``. Matches that overlap are replaced as one, by the kind of the longest, or the
    first in ``MASK_ORDER``. A null text stays null."""
    text = F.col(text_column)
    order = F.array(*(F.lit(name) for name in MASK_ORDER))
    spans = F.array_sort(F.transform(F.concat(*(spans_of(text, r) for r in range(len(KINDS)))), lambda s: F.struct(
        s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"),
        (s["start"] - s["end"]).cast("int").alias("minus"), F.array_position(order, s["kind"]).cast("int").alias("nth"),
        s["kind"].alias("kind"))))
    shape = "array<struct<start: int, end: int, minus: int, nth: int, kind: string>>"

    def merge(ranges: Column, s: Column) -> Column:
        last = F.get(ranges, F.size(ranges) - 1)
        longer = (s["minus"] < last["minus"]) | ((s["minus"] == last["minus"]) & (s["nth"] < last["nth"]))
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), *(
            F.when(longer, s[name]).otherwise(last[name]).alias(name) for name in ("minus", "nth", "kind")))
        return F.when(F.coalesce(s["start"] < last["end"], F.lit(False)),
                      F.concat(F.slice(ranges, 1, F.size(ranges) - 1), F.array(both))).otherwise(
            F.concat(ranges, F.array(s))).cast(shape)

    ranges = F.aggregate(spans, F.array().cast(shape), merge)

    def rebuild(ranges: Column) -> Column:
        def piece(r: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ranges, i - 1)["end"], F.lit(0))
            return F.concat(F.substr(text, before + 1, r["start"] - before), F.lit("<"), F.upper(r["kind"]), F.lit(">"))

        end = F.get(ranges, F.size(ranges) - 1)["end"]
        return F.when(F.size(ranges) == 0, text).otherwise(
            F.concat(F.array_join(F.transform(ranges, piece), ""), F.substr(text, end + 1, F.length(text))))

    return docs.withColumn(text_column, F.get(F.transform(F.array(ranges), rebuild), F.lit(0)))
