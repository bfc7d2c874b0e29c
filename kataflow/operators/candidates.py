"""Candidates: text variants times breadth-first rewriting, ordered, first occurrences only, ranked from 1."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataflow.functions import rules
from kataflow.functions.text import capitalized, strip_marks

#: The text processors in order, with their fixed names.
PROCESSORS: tuple[tuple[str, Callable[[str], str]], ...] = (
    ("decapitalize", str.lower),
    ("capitalizeFirstLetter", lambda s: s[:1].upper() + s[1:]),
    ("removeAlphabeticDiacritics", strip_marks),
)
#: Longest chain of rewritings; the rules can't reach it, and a token that did would be an error, not cut short.
DEPTH = 64
SCHEMA = "token string, rank int, text string, preprocessors array<string>, transforms array<string>, conditions int, variant_ord int, path array<int>"


def variants(token: str) -> list[tuple[str, list[str]]]:
    """(text, names of the processors that changed it), the first chain that gives a text winning."""
    found = {token: []}
    for name, f in PROCESSORS:
        step: dict[str, list[str]] = {}
        for text, chain in found.items():
            step.setdefault(text, chain)
            changed = f(text)
            step.setdefault(changed, chain if changed == text else [*chain, name])
        found = step
    return list(found.items())


def variant_columns(token: Column) -> Column:
    """variants() as an array of (text, preprocessors), with built-in functions but for diacritics of non-ASCII texts."""
    start = F.array(F.struct(token.alias("text"), F.array().cast("array<string>").alias("preprocessors")))
    for (name, _), f in zip(PROCESSORS[:2], (F.lower, capitalized), strict=True):
        start = _grow(start, name, f)
    return start


def _grow(chain: Column, name: str, f: Callable[[Column], Column]) -> Column:
    def both(x: Column) -> Column:
        changed = f(x["text"])
        more = F.when(changed == x["text"], x["preprocessors"]).otherwise(F.concat(x["preprocessors"], F.array(F.lit(name))))
        return F.array(x, F.struct(changed.alias("text"), more.alias("preprocessors")))

    all_ = F.flatten(F.transform(chain, both))
    return F.aggregate(
        all_, F.filter(all_, lambda x: F.lit(False)),
        lambda kept, x: F.when(F.exists(kept, lambda y: y["text"] == x["text"]), kept).otherwise(F.concat(kept, F.array(x))),
    )


def with_variants(df: DataFrame, token: str = "token") -> DataFrame:
    """df with `variants`, all three processors applied: a row per row, without a shuffle."""
    @F.pandas_udf("array<struct<text:string,preprocessors:array<string>>>")
    def whole(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: [{"text": x, "preprocessors": chain} for x, chain in variants(t)], na_action="ignore")

    other = "not_ascii_" + "_".join(df.columns)  # longer than any of them
    ascii_only = ~F.col(token).rlike(r"[^\x00-\x7F]")
    found = df.withColumn(other, whole(F.when(~ascii_only, F.col(token))))
    return found.withColumn("variants", F.when(ascii_only, variant_columns(F.col(token))).otherwise(F.col(other))).drop(other)


@lru_cache(4096)
def _applicable(first: str, last: str) -> list[tuple[int, str, int, Callable[[str], str | None]]]:
    """The rules that a text with this first and last character may meet, in order."""
    def may(r: rules.Rule) -> bool:
        if r.kind == "word":
            return r.own[0] == first and r.own[-1] == last
        if r.kind in ("rest", "loose"):
            return (not r.pre or r.pre[0] == first) and any(not s or s[-1] == last for s in r.suf)
        return True

    return [p for p, (_, _, _, r) in zip(rules.program(), rules.RULES, strict=True) if may(r)]


def rewrite(text: str) -> list[tuple[str, int, tuple[int, ...], list[str]]]:
    """(text, conditions, path of rule numbers, transforms newest first) in breadth-first order.

    A state (text, conditions) met before is left out with all that would follow from it: the earlier one has it all.
    Only texts without conditions are rewritten further.
    """
    out: list[tuple[str, int, tuple[int, ...], list[str]]] = [(text, 0, (), [])]
    seen, at = {(text, 0)}, 0
    while at < len(out):
        s, conditions, path, names = out[at]
        at += 1
        if conditions or not s:
            continue
        if len(path) >= DEPTH:
            raise ValueError(f"{text!r} is rewritten more than {DEPTH} times")
        for g, name, emitted, f in _applicable(s[0], s[-1]):
            made = f(s)
            if made is not None and (made, emitted) not in seen:
                seen.add((made, emitted))
                out.append((made, emitted, (*path, g), [name, *names]))
    return out


def candidates(token: str) -> list[tuple]:
    """Rows SCHEMA of a token."""
    rows, seen = [], set()
    for k, (text, chain) in enumerate(variants(token)):
        for made, conditions, path, names in rewrite(text):
            if made not in seen:
                seen.add(made)
                rows.append((token, len(rows) + 1, made, chain, names, conditions, k, list(path)))
    return rows


def generate(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Rows SCHEMA for every distinct token of `tokens`; null tokens have none."""
    return generate_each(tokens.select(F.col(token).alias("token")).distinct())


def generate_each(tokens: DataFrame, *carry: str) -> DataFrame:
    """Rows SCHEMA for every row of tokens (distinct already) that isn't null, with its columns `carry`: without a shuffle."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 2000):
                part = frame.iloc[start : start + 2000]
                found = [candidates(t) for t in part["token"]]
                made = pd.DataFrame([r for rows in found for r in rows], columns=names)
                for c in carry:
                    made[c] = part[c].repeat([len(rows) for rows in found]).to_numpy()
                yield made

    more = "".join(f", `{c}` {tokens.schema[c].dataType.simpleString()}" for c in carry)
    return tokens.select("token", *carry).where("token is not null").mapInPandas(run, SCHEMA + more)


def expand(frontier: DataFrame, keep: tuple[str, ...] = ("token",)) -> DataFrame:
    """One step of rewriting in built-in functions: (keep, text, conditions, path) to the rows one rule further."""
    found = frontier.where("conditions = 0").withColumn("_x", F.explode(rules.steps(F.col("text"))))
    return found.select(*keep, F.col("_x.text").alias("text"), F.col("_x.conditions").alias("conditions"), F.concat("path", F.array("_x.g")).alias("path"))


def upto_depth(tokens: DataFrame, depth: int) -> DataFrame:
    """(token, text, conditions, depth) of all distinct states within `depth` rewritings, in built-in functions."""
    level = tokens.select("token", F.col("token").alias("text"), F.lit(0).alias("conditions"), F.array().cast("array<int>").alias("path"))
    found = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = expand(level)
        found = found.unionByName(level.withColumn("depth", F.lit(d)))
    return found.groupBy("token", "text", "conditions").agg(F.min("depth").alias("depth"))


class ConditionFlags:
    """Condition types to bits: a type with sub-conditions has all their bits."""

    MOST = 32

    def __init__(self, types: dict[str, tuple[str, ...] | None], word_classes: frozenset[str] = frozenset()):
        self.flags: dict[str, int] = {}
        waiting, bit = dict(types), 0
        while waiting:
            ready = {n: subs for n, subs in waiting.items() if not subs or all(s in self.flags for s in subs)}
            if not ready:
                raise ValueError(f"cyclic or unknown sub-conditions: {sorted(waiting)}")
            for name, subs in ready.items():
                if subs:
                    value = 0
                    for s in subs:
                        value |= self.flags[s]
                else:
                    if bit >= self.MOST:
                        raise ValueError(f"more than {self.MOST} conditions")
                    value, bit = 1 << bit, bit + 1
                self.flags[name] = value
                del waiting[name]
        self.word_classes = word_classes

    def of(self, names: list[str], strict: bool = False) -> int:
        """The flags of the names together; unknown ones count nothing, or raise when strict."""
        value = 0
        for n in names:
            if strict and n not in self.flags:
                raise ValueError(f"unknown condition {n!r}")
            value |= self.flags.get(n, 0)
        return value

    def of_word_classes(self, names: list[str]) -> int:
        return self.of([n for n in names if n in self.word_classes])


#: Fixed value: the one condition type, a verb in its dictionary form.
INDONESIAN = ConditionFlags({"v": None}, frozenset({"v"}))


def conditions_match(current: Column, wanted: Column) -> Column:
    return (current == 0) | (current.bitwiseAND(wanted) != 0)


def transform_names(ids: DataFrame, column: str = "id") -> DataFrame:
    """ids with the name and description of each transform; unknown ids name themselves."""
    spark = ids.sparkSession
    known = spark.createDataFrame([(t.id, t.name, t.description) for t in rules.TRANSFORMS], f"`{column}` string, name string, description string")
    return ids.join(F.broadcast(known), column, "left").withColumn("name", F.coalesce("name", column))
