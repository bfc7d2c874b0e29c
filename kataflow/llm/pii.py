"""Personal data (native): regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is DataFrame expressions. Null and empty texts give no spans; positions are code points, end
exclusive; repeated rows are each treated alike; columns of the input are kept, those named as an output
are replaced. Patterns use possessive groups so that very long runs neither recurse nor backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: kind: pattern, base score, words that raise the score when near.
PATTERNS: dict[str, tuple[str, float, str]] = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, "ip|address|host|server|login"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", 0.8, "card|visa|credit|pay|konto|carte"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.7, "iban|account|bank|konto|cuenta|compte"),
    "secret": (r"(?<![A-Za-z0-9])[0-9a-f]{32,128}+(?![A-Za-z0-9])", 0.3, "token|secret|password|passwd|key|bearer|auth"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security"),
}
#: A cheap byte search that must succeed before the pattern is tried.
NEEDLE = {"email": "@", "phone": "+", "ssn": "-"}
NEAR, BOOST, KEEP, BLOCK = 40, 0.4, 0.5, 512
SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def _located(text: Column, rx: str) -> Column:
    """Array of (start, end, hit, near) for all leftmost matches: what lies between matches gives the positions.

    Two levels of blocks keep the work nearly linear in the number of matches of one text.
    """
    hits, pieces = F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.split(text, rx, -1)
    whole = F.struct(hits.alias("h"), pieces.alias("p"))
    block = F.transform(
        F.array(whole),
        lambda w: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(w["h"]) - 1) / BLOCK).cast("int")),
            lambda b: F.zip_with(
                F.zip_with(F.slice(w["p"], b * BLOCK + 1, F.least(F.lit(BLOCK), F.size(w["h"]) - b * BLOCK)), F.slice(w["h"], b * BLOCK + 1, F.lit(BLOCK)), lambda p, h: F.struct(p.alias("p"), h.alias("h"))),
                F.slice(w["p"], b * BLOCK + 2, F.least(F.lit(BLOCK), F.size(w["h"]) - b * BLOCK)),
                lambda x, after: F.struct(F.char_length(x["p"]).alias("gap"), x["h"].alias("hit"), F.lower(F.concat_ws(" ", F.right(x["p"], F.lit(NEAR)), F.left(after, F.lit(NEAR)))).alias("near")),
            ),
        ),
    )[0]
    none = F.lit(None).cast("array<struct<start:int,end:int,hit:string,near:string>>")
    empty = F.filter(F.coalesce(none, F.array().cast("array<struct<start:int,end:int,hit:string,near:string>>")), lambda x: F.lit(True))

    def walk(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.char_length(x["hit"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["near"].alias("near")))).alias("out"))

    def width(b: Column) -> Column:
        return F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + F.char_length(x["hit"]))

    placed = F.transform(
        F.array(block),
        lambda bs: F.zip_with(
            bs,
            F.aggregate(bs, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("at")), lambda a, b: F.struct((a["pos"] + width(b)).alias("pos"), F.concat(a["at"], F.array(a["pos"])).alias("at")))["at"],
            lambda b, at: F.aggregate(b, F.struct(at.alias("pos"), empty.alias("out")), walk)["out"],
        ),
    )[0]
    return F.flatten(placed)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return a + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    s = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, F.lit(5), F.char_length(s)), F.left(s, F.lit(4)))

    def add(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v <= 57, (a * 10 + v - 48) % 97).otherwise((a * 100 + v - 55) % 97)

    return F.aggregate(F.split(turned, "", -1), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        bare = F.transform(F.split(hit, r"\.", -1), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: (F.char_length(p) <= 3) & (F.coalesce(F.when(F.char_length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(_digits(hit))
    if kind == "phone":
        return F.char_length(_digits(hit)).between(8, 15)
    if kind == "iban":
        return _mod97(hit)
    return F.lit(True)


def _spans(kind: str, t: Column) -> Column:
    rx, score, words = PATTERNS[kind]
    tried = t.rlike(rx)
    if kind in NEEDLE:
        tried = F.contains(t, F.lit(NEEDLE[kind])) & tried
    raised = lambda x: F.when(x["near"].rlike(words), F.lit(min(1.0, score + BOOST))).otherwise(F.lit(score))
    spans = F.transform(
        F.filter(_located(t, rx), lambda x: _valid(kind, x["hit"])),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("text"), raised(x).alias("score")),
    )
    if kind not in BASE:
        spans = F.filter(spans, lambda x: x["score"] >= KEEP)
    return F.when(tried, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def detect(df: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """df with `out`: array of (kind, start, end, text, score), by kind as listed in PATTERNS, then start.

    Base kinds that pass their check always stay; the others stay from a score of KEEP. A context word within
    NEAR characters raises the score by BOOST, to 1 at most.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(out, F.concat(*(_spans(kind, t) for kind in kinds)))


def redact(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """df with every span of `spans` in `text` replaced by its kind in brackets; overlapping spans become one.

    What lies between spans is cut out of the code points at four bytes each, so that a piece costs its own length.
    """
    t = F.col(text)
    order = F.array_sort(F.transform(F.col(spans), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    none = F.array().cast("array<struct<at:int,upto:int,kind:string>>")

    def step(a: Column, x: Column) -> Column:
        piece = F.struct(a["pos"].alias("at"), x["start"].alias("upto"), x["kind"].alias("kind"))
        return F.struct(F.greatest(a["pos"], x["end"]).alias("pos"), F.when(x["start"] >= a["pos"], F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    points, mark = F.encode(t, "UTF-32"), F.lit(b"\x00\x00\xfe\xff")  # decode takes one mark off
    cut = lambda at, upto: F.decode(F.concat(mark, F.substring(points, at * 4 + 1, (upto - at) * 4)), "UTF-32")
    masked = F.aggregate(
        order, F.struct(F.lit(0).alias("pos"), F.filter(none, lambda x: F.lit(True)).alias("out")), step,
        lambda a: F.concat(F.array_join(F.transform(a["out"], lambda p: F.concat(cut(p["at"], p["upto"]), F.lit("["), F.upper(p["kind"]), F.lit("]"))), ""), cut(a["pos"], F.char_length(t))),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(t))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(df: DataFrame) -> DataFrame:
    """The columns of the contract from detect()'s spans."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    counts = [_count(k) for k in BASE]
    base = F.array_join(F.transform(F.filter("pii", lambda x: x["kind"].isin(*BASE)), name), ",")
    return df.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("pii", name), ",").alias("spans"))
