"""Regression cases: the line grammar, its writer, the union of case files, and the evaluation against hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kataflow.functions.text import trimmed

#: What is wrong with a line.
NESTED, UNMATCHED, OPEN = "nested fuzzy tail brackets are not supported", "unmatched fuzzy tail bracket", "unterminated fuzzy tail bracket"
NO_TAIL, EMPTY_TAIL, NOT_LAST, EMPTY = "fuzzy tail must contain at least one entry", "fuzzy tail entries must be non-empty", "fuzzy tail brackets are only allowed at the end", "parser case entries must be non-empty"


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines (blank ones dropped) with token, prefix_hits, fuzzy_tail_hits and error (null where the line is right).

    token, strict hits..., and at the end maybe (tail, tail...); entries are trimmed and separated by commas.
    """
    t = trimmed(line)
    # Brackets alone tell nesting: each must be followed by its partner.
    signs = F.regexp_replace(t, "[^()]", "")
    paired = F.regexp_replace(signs, r"^(\(\))*", "")
    bracket = F.when(paired.startswith("(("), NESTED).when(paired.startswith(")"), UNMATCHED).when(paired == "(", OPEN)
    # Commas within brackets are hidden while the line is split.
    parts = F.transform(F.split(F.regexp_replace(t, r",(?=[^()]*\))", "\x00"), ",", -1), lambda x: trimmed(F.replace(x, F.lit("\x00"), F.lit(","))))
    last = F.element_at("_parts", -1)
    fuzzy = last.rlike(r"^\([^()]*\)\z")
    inner = trimmed(F.substring(last, F.lit(2), F.char_length(last) - 2))
    tail = F.transform(F.split(inner, ",", -1), trimmed)
    parsed = lines.where(t != "").withColumns({"_bracket": bracket, "_parts": parts})
    parsed = parsed.withColumns({"_fuzzy": fuzzy, "_tail": F.when(fuzzy, tail).otherwise(F.array().cast("array<string>")), "_inner": F.when(fuzzy, inner)})
    parsed = parsed.withColumn("_strict", F.when(F.col("_fuzzy"), F.slice("_parts", F.lit(1), F.size("_parts") - 1)).otherwise(F.col("_parts")))
    error = (
        F.when(F.col("_bracket").isNotNull(), F.col("_bracket")).when(F.exists("_parts", lambda x: x == ""), EMPTY)
        .when(F.col("_inner") == "", NO_TAIL).when(F.exists("_tail", lambda x: x == ""), EMPTY_TAIL)
        .when(F.exists("_strict", lambda x: x.rlike("[()]")), NOT_LAST)
    )
    # A line that is nothing but a tail has no token.
    return parsed.select(
        *lines.columns, F.get("_strict", F.lit(0)).alias("token"), F.slice("_strict", F.lit(2), F.greatest(F.size("_strict"), F.lit(1))).alias("prefix_hits"),
        F.col("_tail").alias("fuzzy_tail_hits"), error.alias("error"),
    )


def strict(parsed: DataFrame) -> DataFrame:
    """Raises, when run, on the first wrong line."""
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("Syntax Error: "), F.col("error")))).otherwise(F.col("token"))
    return parsed.withColumn("token", checked.cast("string"))


def line_of(token: Column, prefix: Column, tail: Column) -> Column:
    """The inverse of parse()."""
    head = F.array_join(F.array_prepend(prefix, token), ", ")
    return F.when(F.size(tail) > 0, F.concat(head, F.lit(", ("), F.array_join(tail, ", "), F.lit(")"))).otherwise(head)


def materialize(cases: DataFrame, order: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """The first of each (token, prefix, tail) in file and line order, with `duplicates`, how many followed it."""
    same = Window.partitionBy("token", "prefix_hits", "fuzzy_tail_hits")
    return cases.withColumn("_n", F.row_number().over(same.orderBy(*order))).withColumn("duplicates", F.count("*").over(same) - 1).where("_n = 1").drop("_n")


def evaluate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases with passed, missing_tail (a list) and redundant, from hits (token, actual array<string> in order)."""
    found = cases.join(hits, "token", "left").withColumn("actual", F.coalesce("actual", F.array().cast("array<string>")))
    n = F.size("prefix_hits")
    prefix_ok = F.slice("actual", F.lit(1), n) == F.col("prefix_hits")
    rest = F.slice("actual", n + 1, F.greatest(F.size("actual"), F.lit(1)))
    missing = F.filter("fuzzy_tail_hits", lambda x: ~F.array_contains(rest, x))
    only = (n == 1) & (F.size("fuzzy_tail_hits") == 0) & (F.get("prefix_hits", F.lit(0)) == F.col("token")) & F.array_contains("actual", F.col("token"))
    return found.withColumns({"prefix_ok": prefix_ok, "missing_tail": missing, "passed": prefix_ok & (F.size(missing) == 0), "redundant": F.coalesce(only, F.lit(False))})
