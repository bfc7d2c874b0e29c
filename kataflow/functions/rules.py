"""The rewriting rules from surface forms to possible base forms, and their compilation to Python, Spark and SQL.

A rule takes the whole token apart as pre + rest + suf, where the rest is a run of at least `least` lower-case ASCII
letters, with conditions, and puts it together as out + rest + add, or as the active form of that. Rules that are not
of this form are `loose` (no demand on the rest), `word` (a whole word) or have a pattern of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

VERB = 1  # the condition of a finished active verb: nothing rewrites it further


@dataclass(frozen=True)
class Rule:
    pre: str = ""
    suf: tuple[str, ...] = ("",)
    least: int = 3
    first: str = "a-z"  # what the rest may begin with
    second: str = ""  # and its second letter, where that matters
    out: str = ""
    add: str | None = None  # None: nothing, "=": the suffix found
    active: bool = False
    verb: bool = False
    bars: tuple[str, ...] = ()  # the token may not begin with these
    no_in: bool = False  # the rest may not end in "in"
    kind: str = "rest"
    own: str = ""

    @property
    def condition(self) -> int:
        return VERB if self.active or self.verb else 0

    @property
    def pattern(self) -> str:
        """For kind "rest": group 1 is the rest, group 2 the suffix."""
        first = self.first if self.first.startswith("[") else f"[{self.first}]"
        ends = "|".join(self.suf)
        return f"^{self.pre}({first}[a-z]{{{self.least - 1},}})({ends})$"


@dataclass(frozen=True)
class Transform:
    id: str
    name: str
    description: str | None
    rules: tuple[Rule, ...]


def _not(letters: str) -> str:
    """All lower-case letters but these, as ranges."""
    keep = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in letters)
    return "".join(keep)


def _strip(*suffixes: str) -> tuple[Rule, ...]:
    return tuple(Rule(suf=(s,)) for s in suffixes)


def _nasal(pre: str, first: str, least: int, *restored: str) -> list[Rule]:
    return [Rule(pre, least=least, first=first, out=r) for r in restored]


def _active(pre: str, first: str, least: int, restored: tuple[str, ...], suffixed: bool) -> list[Rule]:
    """Colloquial verbs: with -in both formal suffixes for each restored letter, without it one form."""
    if suffixed:
        return [Rule(pre, ("in",), least, first, out=r, add=a, active=True) for r in restored for a in ("kan", "i")]
    return [Rule(pre, (("",)), least, first, out=r, active=True, no_in=True) for r in restored]


V, NOT_E, NOT_GY = "aeiou", _not("e"), _not("gy")
# The ids, names and descriptions of the transforms, and the affixes, words and letters of their rules.
WORDS = {"ga": "tidak", "gak": "tidak", "enggak": "tidak", "nggak": "tidak", "kalo": "kalau", "taun": "tahun", "cape": "capai", "capek": "capai", "menjijikkan": "menjijikan"}
NO_IMPERATIVE = ("di", "memper", "menge", "meny", "meng", "men", "mem", "me", "ber", "ter", "per")
TRANSFORMS: tuple[Transform, ...] = (
    Transform("clitic", "clitic", "Attached emphatic, possessive, or pronominal clitic", _strip("lah", "kah", "pun", "ku", "mu", "nya")),
    Transform("numeric reduplication", "numeric reduplication", "Informal numeric notation for a repeated word", (Rule(kind="twice", own="^([a-z]{2,})-?2$"),)),
    Transform(
        "passive di-", "passive di- → active meN-", "Passive verb converted to its corresponding active form",
        (Rule("di", ("in",), add="kan", active=True), Rule("di", ("in",), add="i", active=True), Rule("di", active=True)),
    ),
    Transform(
        "colloquial active verb", "colloquial → active meN-", "Colloquial nasal verb converted to a formal active form",
        (
            *_active("nge", "a-z", 3, ("",), True), *_active("ny", "a-z", 2, ("c", "s"), True), *_active("ng", NOT_E, 3, ("",), True),
            *_active("n", NOT_GY, 3, ("t", "c"), True), *_active("m", NOT_E, 3, ("p", "b"), True),
            *_active("nge", "a-z", 2, ("",), False), *_active("ny", "a-z", 2, ("c", "s"), False), *_active("ng", NOT_E, 3, ("",), False),
            *_active("n", NOT_GY, 3, ("t", "c"), False), *_active("m", NOT_E, 3, ("p", "b"), False),
        ),
    ),
    Transform(
        "imperative active verb", "imperative → active meN-", "Suffixed imperative converted to a formal active form",
        (Rule("per", ("kan", "i"), out="memper", add="=", verb=True), Rule("", ("kan", "i"), add="=", active=True, bars=NO_IMPERATIVE)),
    ),
    Transform("informal -in", "informal -in", "Colloquial -in suffix converted to formal -kan or -i", (Rule(suf=("in",), add="kan", kind="loose"), Rule(suf=("in",), add="i", kind="loose"))),
    Transform("ke- → ter-", "ke- → ter-", "Colloquial ke- verb converted to formal ter-", (Rule("ke", out="ter", bars=("ketidak",)),)),
    Transform("colloquial spelling", "colloquial spelling", "Common colloquial spelling converted to its formal form", (*(Rule(kind="word", own=w, out=o) for w, o in WORDS.items()), Rule(kind="inside", own="emen", out="eman"))),
    Transform(
        "reduplication", "reduplication", "Repeated word converted to its unreduplicated form",
        (Rule(kind="half", own="^(?:ber|ter|se|ke|di)([a-z]{2,})-[a-z]{2,}$"), Rule(kind="half", own="^([a-z]{2,})-[a-z]{2,}$")),
    ),
    Transform("ku-/kau-/ga-", "ku-/kau-/ga-", "Attached pronoun or colloquial negator", tuple(Rule(p) for p in ("kau", "ku", "nggak", "gak", "ga"))),
    Transform(
        "colloquial nasal prefix", "colloquial nasal prefix", None,
        (*_nasal("nge", "a-z", 2, ""), *_nasal("ny", "a-z", 2, "c", "s"), *_nasal("ng", NOT_E, 3, "", "k"), *_nasal("n", NOT_GY, 3, "t", "c", "d", "j"), *_nasal("m", NOT_E, 3, "p", "b")),
    ),
    Transform(
        "meN-", "meN-", "Active verbal prefix",
        (
            Rule("memper", out="per"), *_nasal("menge", "a-z", 2, ""), *_nasal("meny", "a-z", 2, "s", "c", ""), *_nasal("meng", NOT_E, 2, "", "k"),
            Rule("men", first=V, out="t"), Rule("men", first=NOT_GY), Rule("mem", first=V, out="p", bars=("memper",)), Rule("mem", bars=("memper",)), Rule("me", first=_not("mn")),
        ),
    ),
    Transform(
        "peN-", "peN-", "Nominal peN- prefix",
        (
            *_nasal("penge", "a-z", 2, ""), *_nasal("peny", "a-z", 2, "s", "c", ""), *_nasal("peng", NOT_E, 2, "", "k"),
            Rule("pen", first=V, out="t"), Rule("pen", first=NOT_GY), Rule("pem", first=V, out="p"), Rule("pem"), Rule("pe", first=_not("mn")),
        ),
    ),
    Transform(
        "ber-/per-/ter-", "ber-/per-/ter-", "Verbal or nominal r-prefix",
        (
            Rule(kind="word", own="belajar", out="ajar"), Rule(kind="word", own="bekerja", out="kerja"),
            Rule("be", first="r"), Rule("pe", first="r"), Rule("te", first="r"),
            Rule("ber", kind="loose"), Rule("per", kind="loose"), Rule("ter", kind="loose"),
        ),
    ),
    Transform("circumfix", "circumfix", "Prefix and suffix removed together", tuple(Rule(p, ("an",)) for p in ("ketidak", "ke", "ber", "per"))),
    Transform("simple prefix", "simple prefix", None, tuple(Rule(p, kind="loose") for p in ("ketidak", "di", "se", "ke"))),
    Transform("derivational suffix", "derivational suffix", None, _strip("kan", "an", "i")),
)
#: What an active form puts before a root's first letter, and how much of the root it replaces (letters not named: meng, 0).
ACTIVE = {"p": ("mem", 1), "t": ("men", 1), "k": ("meng", 1), "s": ("meny", 1)} | dict.fromkeys("bfv", ("mem", 0)) | dict.fromkeys("cdjz", ("men", 0)) | dict.fromkeys("ghq", ("meng", 0)) | dict.fromkeys("lmnrwy", ("me", 0))
SHORT_ACTIVE = ("menge", 3)  # for roots of at most so many letters
#: (number, transform number, number within the transform, rule), in the order of application.
RULES: tuple[tuple[int, int, int, Rule], ...] = tuple((g, t, k, r) for g, (t, k, r) in enumerate((t, k, r) for t, x in enumerate(TRANSFORMS) for k, r in enumerate(x.rules)))


# In Python.


def active_form(root: str) -> str:
    if len(root) <= SHORT_ACTIVE[1]:
        return SHORT_ACTIVE[0] + root
    prefix, cut = ACTIVE.get(root[0], ("meng", 0))
    return prefix + root[cut:]


def compiled(rule: Rule) -> Callable[[str], str | None]:
    """The rule as a function: the rewritten token, or None where the rule doesn't apply."""
    if rule.kind == "word":
        return lambda s: rule.out if s == rule.own else None
    if rule.kind == "inside":
        return lambda s: s.replace(rule.own, rule.out, 1) if rule.own in s else None
    if rule.kind == "loose":
        suf, n = rule.suf[0], len(rule.pre)
        return lambda s: s[n : len(s) - len(suf)] + (rule.add or "") if s.startswith(rule.pre) and s.endswith(suf) else None
    if rule.kind in ("twice", "half"):
        find = re.compile(rule.own[:-1] + r"\Z").match
        return lambda s: (f"{m[1]}-{m[1]}" if rule.kind == "twice" else m[1]) if (m := find(s)) else None
    find = re.compile(rule.pattern[:-1] + r"\Z").match

    def apply(s: str) -> str | None:
        m = find(s)
        if not m or s.startswith(rule.bars) and rule.bars or rule.no_in and m[1].endswith("in"):
            return None
        root = rule.out + m[1]
        return (active_form(root) if rule.active else root) + (m[2] if rule.add == "=" else rule.add or "")

    return apply


@lru_cache(1)
def program() -> list[tuple[int, str, int, Callable[[str], str | None]]]:
    return [(g, TRANSFORMS[t].id, r.condition, compiled(r)) for g, t, _, r in RULES]


# As Spark columns.


def active_column(root: Column) -> Column:
    tail = F.substring(root, F.lit(2), F.char_length(root))
    first = F.substring(root, 1, 1)
    case = F.when(F.char_length(root) <= SHORT_ACTIVE[1], F.concat(F.lit(SHORT_ACTIVE[0]), root))
    for (prefix, cut), letters in _by_prefix().items():
        case = case.when(first.isin(*letters), F.concat(F.lit(prefix), tail if cut else root))
    return case.otherwise(F.concat(F.lit("meng"), root))


def _by_prefix() -> dict[tuple[str, int], list[str]]:
    found: dict[tuple[str, int], list[str]] = {}
    for letter, form in ACTIVE.items():
        found.setdefault(form, []).append(letter)
    return found


def rule_column(rule: Rule, s: Column) -> Column:
    """The rewritten token, or null."""
    if rule.kind == "word":
        return F.when(s == rule.own, F.lit(rule.out))
    if rule.kind == "inside":
        at = F.instr(s, rule.own)
        return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(rule.out), F.substring(s, at + len(rule.own), F.char_length(s))))
    if rule.kind == "loose":
        n = len(rule.pre) + len(rule.suf[0])
        return F.when(s.startswith(rule.pre) & s.endswith(rule.suf[0]), F.concat(F.substring(s, F.lit(len(rule.pre) + 1), F.char_length(s) - n), F.lit(rule.add or "")))
    rx = (rule.own if rule.own else rule.pattern)[:-1] + r"\z"
    # Cheap tests come first; the pattern runs once, and its first group is never empty where it matches.
    if rule.kind in ("twice", "half"):
        may = F.contains(s, F.lit("2" if rule.kind == "twice" else "-"))
        made = lambda rest: F.when(rest != "", F.concat(rest, F.lit("-"), rest) if rule.kind == "twice" else rest)
    else:
        may = s.startswith(rule.pre)
        if "" not in rule.suf:
            ends = [s.endswith(x) for x in rule.suf]
            may = may & (ends[0] if len(ends) == 1 else ends[0] | ends[1])
        for bar in rule.bars:
            may = may & ~s.startswith(bar)

        def made(rest: Column) -> Column:
            ok = (rest != "") & ~rest.endswith("in") if rule.no_in else rest != ""
            root = F.concat(F.lit(rule.out), rest) if rule.out else rest
            tail = F.regexp_extract(s, rx, 2) if rule.add == "=" else F.lit(rule.add or "")
            return F.when(ok, F.concat(active_column(root) if rule.active else root, tail))

    return F.when(may, F.get(F.transform(F.array(F.regexp_extract(s, rx, 1)), made), F.lit(0)))


def steps(s: Column, transform: int | None = None) -> Column:
    """Array of (g, transform, text, conditions) of all rules that apply to s."""
    made = [
        F.struct(F.lit(g).alias("g"), F.lit(TRANSFORMS[t].id).alias("transform"), rule_column(r, s).alias("text"), F.lit(r.condition).alias("conditions"))
        for g, t, _, r in RULES if transform in (None, t)
    ]
    return F.filter(F.array(*made), lambda x: x["text"].isNotNull())


# As SQL for engines without lookahead whose `$` is the end.


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def active_sql(root: str) -> str:
    whens = [f"WHEN length({root}) <= {SHORT_ACTIVE[1]} THEN concat('{SHORT_ACTIVE[0]}', {root})"]
    for (prefix, cut), letters in _by_prefix().items():
        whens.append(f"WHEN left({root}, 1) IN ({', '.join(map(_quoted, letters))}) THEN concat('{prefix}', {f'substr({root}, 2)' if cut else root})")
    return f"CASE {' '.join(whens)} ELSE concat('meng', {root}) END"


def rule_sql(rule: Rule, s: str) -> tuple[str, str]:
    """(condition, rewritten token)."""
    if rule.kind == "word":
        return f"{s} = {_quoted(rule.own)}", _quoted(rule.out)
    if rule.kind == "inside":
        return f"contains({s}, {_quoted(rule.own)})", f"regexp_replace({s}, {_quoted(rule.own)}, {_quoted(rule.out)})"
    if rule.kind == "loose":
        n = len(rule.pre) + len(rule.suf[0])
        return f"starts_with({s}, {_quoted(rule.pre)}) AND ends_with({s}, {_quoted(rule.suf[0])})", f"concat(substr({s}, {len(rule.pre) + 1}, length({s}) - {n}), {_quoted(rule.add or '')})"
    rx = _quoted(rule.own or rule.pattern)
    rest = f"regexp_extract({s}, {rx}, 1)"
    if rule.kind in ("twice", "half"):
        return f"regexp_matches({s}, {rx})", f"concat({rest}, '-', {rest})" if rule.kind == "twice" else rest
    ok = [f"regexp_matches({s}, {rx})", *(f"NOT starts_with({s}, {_quoted(b)})" for b in rule.bars)]
    if rule.no_in:
        ok.append(f"NOT ends_with({rest}, 'in')")
    root = f"concat({_quoted(rule.out)}, {rest})"
    tail = f"regexp_extract({s}, {rx}, 2)" if rule.add == "=" else _quoted(rule.add or "")
    return " AND ".join(ok), f"concat({active_sql(root) if rule.active else root}, {tail})"
