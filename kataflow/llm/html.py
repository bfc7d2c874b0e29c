"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

1. A page becomes a stream of container tokens (opening and closing tags of sections, with the letters of their classes)
   and text slots; paragraphs, headings, lists, tables and breaks make the blocks of a slot.
2. Streams of a host are aligned one by one with the wrapper so far: balanced stretches that follow each other alike fold
   into repeated groups, stretches that only one side has become optional groups. Equal streams are counted first, and
   wrappers merge in a tree of bounded fan-in, so that no host meets in one task.
3. Each page is matched against its host's wrapper, which gives every slot of the page its slot of the wrapper. Per slot of
   the wrapper pages, text, link text and the pages of each block's text are counted: a block that nearly all pages of
   the host have in that slot is template, the others are what the slot takes in.
4. Over the wrapper as a tree the main part is chosen: its article (or main) with the most text where the host marks one,
   else the deepest container that holds most of the text that differs between pages and isn't links. What is taken are
   the slots below it and those of the containers around it (a title, say), without boilerplate (sections and blocks that tags, roles or class words tell to be menus, notices
   and so on), without slots of links or of template only, and without template blocks among text that differs.

White space becomes one space; blocks are joined by one space; a break counts as white space. Containers nested deeper
than DEEP belong to the one at that depth.

Null and empty pages give ''. Pages of a host whose wrapper says nothing of them, and slots that the wrapper doesn't have,
are judged by the page alone. Repeated pages count each; where nearly all text of a host repeats, none of it is template;
null urls are a host of their own. Columns of the input are kept; one named as the output is replaced.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataflow.llm.common import chunks, durable, tidy

#: Broadcast rules up to so many characters in all; beyond it they are joined to pages by host. Both give the same.
BROADCAST_CHARS = 8_000_000
#: Wrappers that one task merges, about; deepest container; what a worker remembers of hosts and streams.
FAN_IN, DEEP, KNOWN = 64, 256, 2000
#: A block is template on so many pages at least, and on this share of the host's; it is told from text that differs only
#: where such text is at least this share of all.
LEAST_PAGES, MOST_PAGES, VARIED = 5, 0.9, 0.2
CONTAINERS = frozenset("html head body div section article main nav header footer aside form dialog menu fieldset figure details center".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("head nav footer aside form dialog menu fieldset".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar".split())
#: Class words that say what a section has or lacks, not what it is.
ABOUT_WORDS = frozenset("no not without with has hide show".split())
MARKED = ("article", "main")
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|svg|iframe|select|textarea)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_LETTERS = re.compile("[a-z]+")


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """A container's token, and whether its tag, role or class words tell boilerplate."""
    words, role, named, whole = [], "", False, set()
    for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values).lower()
        if kind.lower() == "role":
            role = value.strip()
            continue
        for name in value.split():
            own = _LETTERS.findall(re.sub("[0-9]+", " ", name))
            words += own
            whole.add(name)
            named |= not BOILER_WORDS.isdisjoint(own) and ABOUT_WORDS.isdisjoint(own)
    if tag in ("html", "body"):
        boiler = False
    elif tag in ("article", "main"):
        boiler = not whole.isdisjoint(("comment", "comments", "reply"))
    else:
        boiler = tag in BOILER_TAGS or role in BOILER_ROLES or named or bool(attributes and _HIDDEN.search(attributes))
    return ".".join(["main" if role == "main" else tag, *dict.fromkeys(words)]), boiler


class Page:
    """A page's stream, and for each of its slots whether it is boilerplate and its blocks as [raw text pieces, characters in links]."""

    def __init__(self, source: str):
        self.stream: list[str] = []
        self.slots: list[tuple[bool, list[list]]] = []
        stack: list[tuple[str, str, bool, bool]] = []  # tag, label, boilerplate, within an article
        opened: Counter[str] = Counter()
        pieces: list[str] = []
        blocks: list[list] = []
        link = linked = at = 0

        def close_block() -> None:
            nonlocal pieces, linked
            if any(not p.isspace() for p in pieces if p):
                blocks.append([pieces, linked])
            pieces, linked = [], 0

        def close_slot() -> None:
            nonlocal blocks
            close_block()
            if blocks:
                boiler = bool(stack) and stack[-1][2]
                if self.stream and self.stream[-1] == "#" and self.slots[-1][0] == boiler:
                    self.slots[-1][1].extend(blocks)  # beyond DEEP, where containers leave no token
                else:
                    self.stream.append("#")
                    self.slots.append((boiler, blocks))
            blocks = []

        def pop() -> None:
            tag, label, _, _ = stack.pop()
            opened[tag] -= 1
            if len(stack) < DEEP:
                self.stream.append("/" + label)

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                pieces.append(source[at : m.start()])
                linked += (m.start() - at) * bool(link)
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if tag in INLINE:
                if tag == "a":
                    link = 0 if m[2] else 1
                continue
            if stack and not m[2] and (stack[-1][0] == "p" and tag != "br" or stack[-1][0] == tag == "li"):
                close_slot()  # the paragraph or list item before ends here
                pop()
            if tag not in CONTAINERS and not (opened[tag] if m[2] else tag not in VOID and _label(tag, m[4])[1]):
                if tag in VOID:
                    pieces.append(" ")
                else:
                    close_block()
                continue
            close_slot()
            link = 0
            if m[2]:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if m[4].endswith("/"):
                continue
            if tag == "body":
                while stack and stack[-1][0] != "html":
                    pop()
            label, boiler = _label(tag, m[4])
            _, _, inside, article = stack[-1] if stack else ("", "", False, False)
            if tag == "header":
                boiler = boiler and not BOILER_WORDS.isdisjoint(label.split(".")[1:]) if article else True
            stack.append((tag, label, inside or boiler, article or label.split(".")[0] in MARKED))
            opened[tag] += 1
            if len(stack) <= DEEP:
                self.stream.append(label)
        if at < len(source):
            pieces.append(source[at:])
        close_slot()
        while stack:
            pop()


def plain(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


# A wrapper is a list of items: a token, or [sign, items] with sign "?" (optional) or "+" (repeated).


def _key(item: str | list) -> str:
    return item if isinstance(item, str) else json.dumps(item)


def _balanced(items: list) -> list[list]:
    """items cut into the shortest balanced stretches: a container with all it holds, or a single item; no recursion."""
    out: list[list] = []
    depth, start = 0, 0
    for k, x in enumerate(items):
        if isinstance(x, str) and x != "#":
            depth += -1 if x.startswith("/") else 1
            if depth < 0:  # closes what these items did not open
                out += [[y] for y in items[start : k + 1]]
                depth, start = 0, k + 1
                continue
        if depth == 0:
            out.append(items[start : k + 1])
            start = k + 1
    return out + [[y] for y in items[start:]]


def fold(items: list) -> list:
    """Stretches that follow each other alike become one repeated group, innermost first."""
    stack: list[list] = [[]]
    for x in items:
        opens = isinstance(x, str) and x != "#" and not x.startswith("/")
        closes = isinstance(x, str) and x.startswith("/")
        if opens:
            stack.append([x])
        elif closes and len(stack) > 1:
            done = [*stack.pop(), x]
            _append(stack[-1], done)
        else:
            _append(stack[-1], [x])
    while len(stack) > 1:
        stack[-2].extend(stack.pop())
    return stack[0]


def _append(level: list, part: list) -> None:
    """part after level's items; a part like the one before it, a group of it or an optional of it makes a group."""
    core = part[0][1] if len(part) == 1 and isinstance(part[0], list) else part
    if core == ["#"]:
        if not (level and level[-1] == "#"):
            level.extend(part)
        return
    n = len(core)
    if level and isinstance(level[-1], list) and level[-1][1] == core:
        level[-1] = ["+" if len(part) != 1 or part[0] != ["?", core] or level[-1][0] == "+" else level[-1][0], core]
    elif len(level) >= n and level[-n:] == core and core[0] != "#" and isinstance(core[0], str) and not core[0].startswith("/"):
        level[-n:] = [["+", core]]
    else:
        level.extend(part)


def _lift(items: list, groups: dict[str, list]) -> list:
    """items with every stretch that is the core of one of the groups replaced by that group."""
    out, opens = [], []
    for x in items:
        out.append(x)
        if isinstance(x, list):
            out[-1] = groups.get(json.dumps([x]), x)
        elif x.startswith("/") and opens:
            start = opens.pop()
            if found := groups.get(json.dumps(out[start:])):
                out[start:] = [found]
        elif x != "#" and not x.startswith("/"):
            opens.append(len(out) - 1)
    return out


def _groups(items: list) -> dict[str, list]:
    """The groups of items by core; a core both repeated and left out is found by both forms."""
    found: dict[str, list] = {}
    for x in items:
        if isinstance(x, list):
            found[json.dumps(x[1])] = x
            if len(x[1]) == 1 and isinstance(x[1][0], list):
                found[json.dumps(x[1][0][1])] = x
    return found


def _keys(items: list) -> list[tuple[int, str]]:
    """What must agree for two items to be the same: the item, and a number for the containers around it."""
    out, above = [], [0]
    for x in items:
        if isinstance(x, str) and x.startswith("/"):
            out.append((above[-1], x))
            if len(above) > 1:
                above.pop()
        else:
            out.append((above[-1], _key(x)))
            if isinstance(x, str) and x != "#":
                above.append(hash((above[-1], x)))
    return out


def align(wrapper: list, stream: list) -> list:
    """The wrapper generalised to match the stream (or wrapper) too."""
    stream = _lift(stream, _groups(wrapper))
    wrapper = _lift(wrapper, _groups(stream))
    if wrapper == stream:
        return wrapper
    out: list = []
    for op, i, j, m, n in difflib.SequenceMatcher(None, _keys(wrapper), _keys(stream), autojunk=False).get_opcodes():
        if op == "equal":
            out += wrapper[i:j]
            continue
        for only in (wrapper[i:j], stream[m:n]):
            for part in _balanced(only):
                optional = len(part) > 1 or part == ["#"] or isinstance(part[0], list) and part[0][0] == "+"
                out += [["?", part]] if optional else part
    return fold(out)


def infer(streams: Iterator[list]) -> list:
    """One wrapper for all streams."""
    wrapper: list | None = None
    for s in streams:
        s = fold(s)
        wrapper = s if wrapper is None else align(wrapper, s)
    return wrapper or []


class Node:
    """A container of a wrapper: what it holds in order, as (repeats?, container or slot number)."""

    __slots__ = ("above", "kids", "label", "places")

    def __init__(self, label: str, above: Node | None):
        self.label, self.above = label, above
        self.kids: list[tuple[bool, Node | int]] = []
        self.places: dict[str, list[int]] = {}

    def add(self, label: str, kid: Node | int, repeats: bool) -> None:
        self.places.setdefault(label, []).append(len(self.kids))
        self.kids.append((repeats, kid))


class Wrapper:
    """A wrapper as a tree; slots are numbered from 0."""

    def __init__(self, items: list):
        self.root, self.slots = Node("", None), []  # the node that holds each slot
        self._grow(items, self.root, False)

    def _grow(self, items: list, at: Node, repeats: bool) -> None:
        top = at
        for x in items:
            again = repeats and at is top
            if isinstance(x, list):
                self._grow(x[1], at, again or x[0] == "+")
            elif x == "#":
                at.add("#", len(self.slots), again)
                self.slots.append(at)
            elif not x.startswith("/"):
                node = Node(x, at)
                at.add(x, node, again)
                at = node
            elif at.above:
                at = at.above

    def match(self, stream: list[str]) -> list[int]:
        """The wrapper's slot of each slot of a stream, -1 where it has none: the next one that may come."""
        out, stack, at, least = [], [], self.root, 0
        for x in stream:
            if x.startswith("/"):
                at, least = stack.pop()
                continue
            places = at.places.get(x) if at else None
            if places:
                # Past the last such place, an earlier one of the same label is the best there is.
                k = places[min(bisect_left(places, least), len(places) - 1)]
                repeats, kid = at.kids[k]
                least = max(least, k if repeats else k + 1)
            else:
                kid = None
            if x == "#":
                out.append(-1 if kid is None else kid)
            else:
                stack.append((at, least))
                at, least = kid, 0
        return out

    def above(self, slot: int) -> list[Node]:
        """The containers of a slot, from the root on."""
        chain, at = [], self.slots[slot]
        while at:
            chain.append(at)
            at = at.above
        return chain[::-1]


class Slot(NamedTuple):
    """What the pages of a host have in a slot of its wrapper; fixed: characters of template blocks."""

    pages: int
    boiler: bool
    chars: int
    linked: int
    fixed: int


def choose(wrapper: Wrapper, pages: int, slots: dict[int, Slot]) -> tuple[list[int], bool]:
    """The slots to take, and whether template blocks among them are left out."""
    text = {w: s for w, s in slots.items() if not s.boiler}
    own = {w: max(0, s.chars - s.linked) for w, s in text.items()}
    varied = {w: max(0, own[w] - s.fixed) for w, s in text.items()}
    # Where nearly all repeats (copies of a page, say) that tells nothing.
    told = pages >= LEAST_PAGES and sum(varied.values()) >= VARIED * max(1, sum(own.values()))
    for tag in MARKED:
        found: dict[Node, list[int]] = {}
        for w in text:
            if top := next((n for n in wrapper.above(w) if n.label.split(".")[0] == tag), None):
                found.setdefault(top, []).append(w)
        if found:  # the page says what its article is
            inside = max(found.values(), key=lambda ws: (sum(text[w].chars for w in ws), -ws[0]))
            return sorted(inside), told and sum(varied[w] for w in inside) >= (1 - VARIED) * sum(own[w] for w in inside)
    weight = varied if told else own
    total: dict[Node, int] = {}
    for w in text:
        for n in wrapper.above(w):
            total[n] = total.get(n, 0) + weight[w]
    depth = lambda n: 0 if n.above is None else 1 + depth(n.above)
    main = max((n for n, c in total.items() if c >= 0.8 * total[wrapper.root]), key=depth, default=wrapper.root)

    around, n = set(), main.above  # what directly holds the main container, a title's place
    while n and n.above and n.label.split(".")[0] not in ("html", "body"):
        around.add(n)
        n = n.above

    def taken(w: int, s: Slot) -> bool:
        chain = wrapper.above(w)
        if main not in chain and chain[-1] not in around:
            return False
        # Text of the main container itself stays; other text must not be links or template only.
        return chain[-1] is main or s.linked <= 0.6 * max(1, s.chars) and not (told and s.fixed >= 0.95 * max(1, s.chars))

    return sorted(w for w, s in text.items() if taken(w, s)), told


def mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def alone(page: Page) -> set[int]:
    """The numbers of the page's own slots to take when it is judged by itself."""
    wrapper = Wrapper(fold(page.stream))
    sums: dict[int, Slot] = {}
    at = wrapper.match(page.stream)
    for w, (boiler, blocks) in zip(at, page.slots, strict=True):
        old = sums.get(w, Slot(1, True, 0, 0, 0))
        sums[w] = Slot(1, old.boiler and boiler, old.chars + sum(len(plain(p)) for p, _ in blocks), old.linked + sum(n for _, n in blocks), 0)
    take = set(choose(wrapper, 1, sums)[0])
    return {k for k, w in enumerate(at) if w in take}


class Rule:
    """A host's wrapper with the slots to take and the template blocks to leave out, (slot, mark of the text)."""

    def __init__(self, rule: str):
        found = json.loads(rule)
        self.wrapper = Wrapper(found["wrapper"])
        self.take, self.fixed = set(found.get("take", ())), {(w, h) for w, hs in found.get("fixed", ()) for h in hs}
        self.matched: dict[tuple[str, ...], list[int]] = {}

    def match(self, page: Page) -> list[int]:
        key = tuple(page.stream)
        if key not in self.matched:
            if len(self.matched) >= KNOWN // 20:
                self.matched.clear()
            self.matched[key] = self.wrapper.match(page.stream)
        return self.matched[key]

    def text_of(self, page: Page) -> str:
        at, own = self.match(page), None
        if -1 in at or not any(w in self.take and not s[0] for w, s in zip(at, page.slots, strict=True)):
            own = alone(page)
        whole = own is not None and -1 not in at  # the wrapper says nothing of this page
        out = []
        for k, (w, (boiler, blocks)) in enumerate(zip(at, page.slots, strict=True)):
            if boiler or not (k in own if whole or w < 0 else w in self.take):
                continue
            out += [t for pieces, _ in blocks if (t := plain(pieces)) and (not self.fixed or (w, mark(t)) not in self.fixed)]
        return " ".join(out)


class Rules(dict):
    """Rules by their JSON, a bounded number of them."""

    def __missing__(self, rule: str) -> Rule:
        if len(self) >= KNOWN:
            self.clear()
        found = self[rule] = Rule(rule)
        return found


def _host() -> Column:
    """Of `url`: the host with its port, in lower case; '' where there is none."""
    whole = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_extract(whole, r"([^@]*)$", 1))


def _per_host(pages: DataFrame, rules: DataFrame, work: Callable[[pa.RecordBatch, list[str], list[Rule]], pa.RecordBatch], schema: str) -> DataFrame:
    """work over pages (with `html` and, last, the host) and the rule of each page's host; rules: (host, rule)."""
    host = pages.columns[-1]
    size = rules.agg(F.coalesce(F.sum(F.length("rule") + F.length("host")), F.lit(0))).first()[0]
    if size <= BROADCAST_CHARS:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.rule for r in rules.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Rules()
            for batch, sources in chunks(batches, "html"):
                yield work(batch, sources, [known[shared.value[h]] for h in batch.column(host).to_pylist()])

        return pages.mapInArrow(tidy(run), schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules()
        for batch, sources in chunks(batches, "html"):
            yield work(batch, sources, [known[r] for r in batch.column(batch.num_columns - 1).to_pylist()])

    own = rules.select(F.col("host").alias(host), F.col("rule").alias(f"{host}_rule"))
    return pages.join(own, host).select(*pages.columns, f"{host}_rule").mapInArrow(tidy(joined), schema)


def _wrappers(pages: DataFrame) -> DataFrame:
    """(host, rule, pages): a wrapper for each host, as {"wrapper": items}."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in chunks(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1), pa.array([json.dumps(fold(Page(x).stream)) for x in sources], pa.string())], ["host", "wrapper"])

    made = pages.mapInArrow(tidy(streams), "host string, wrapper string").groupBy("host", "wrapper").agg(F.count("*").alias("n"))
    made = durable(made)
    # Of each host about FAN_IN meet in a group, as long as there are more.
    left = made.groupBy("host").agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        by = frame.sort_values(["n", "wrapper"], ascending=[False, True])
        return pd.DataFrame({"host": frame["host"].iloc[:1], "salt": frame["salt"].iloc[:1], "wrapper": [json.dumps(infer(map(json.loads, by["wrapper"])))], "n": [int(frame["n"].sum())]})

    made = made.withColumn("salt", F.xxhash64("wrapper"))
    while left > 1:
        groups = -(-left // FAN_IN)
        # Salts stay those of the level before, so that what is merged doesn't depend on what was made.
        made = made.withColumn("salt", F.pmod("salt", F.lit(groups))).groupBy("host", "salt").applyInPandas(merge, "host string, salt long, wrapper string, n long")
        left = groups
    return durable(made.select("host", F.concat(F.lit('{"wrapper": '), "wrapper", F.lit("}")).alias("rule"), F.col("n").alias("pages")))


def rules(pages: DataFrame) -> DataFrame:
    """(host, rule): the wrapper of each host as JSON, with the slots to take and the template blocks; the host is pages' last column."""
    found = _wrappers(pages)
    names = ["host", "w", "mark", "n", "boiler", "chars", "linked"]

    def count(batch: pa.RecordBatch, sources: list[str], known: list[Rule]) -> pa.RecordBatch:
        """A row per slot of a page's wrapper, and one per text of a block in it."""
        out: list[list] = [[] for _ in names]
        for host, source, rule in zip(batch.column(host_at).to_pylist(), sources, known, strict=True):
            page = Page(source)
            slots: dict[int, list] = {}
            blocks: dict[tuple[int, int], int] = {}
            for w, (boiler, parts) in zip(rule.match(page), page.slots, strict=True):
                row = slots.setdefault(w, [True, 0, 0])
                row[0] &= boiler
                for pieces, linked in parts:
                    t = plain(pieces)
                    row[1] += len(t)
                    row[2] += linked
                    if t and not boiler:
                        blocks[w, mark(t)] = blocks.get((w, mark(t)), 0) + len(t)
            for r in (*((host, w, None, 1, *row) for w, row in slots.items()), *((host, w, h, 1, False, c, 0) for (w, h), c in blocks.items())):
                for column, v in zip(out, r, strict=True):
                    column.append(v)
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    host_at = len(pages.columns) - 1
    seen = _per_host(pages, found.select("host", "rule"), count, "host string, w int, mark long, n long, boiler boolean, chars long, linked long")
    sums = durable(seen.groupBy("host", "w", "mark").agg(F.sum("n").alias("n"), F.min("boiler").alias("boiler"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")))
    often = sums.where(F.col("mark").isNotNull() & (F.col("n") >= LEAST_PAGES)).join(found.select("host", "pages"), "host").where(F.col("n") >= MOST_PAGES * F.col("pages"))
    # Both lists are as long as a wrapper and a page are, however many pages a host has.
    fixed = often.groupBy("host", "w").agg(F.sum("chars").alias("fixed"), F.array_sort(F.collect_list("mark")).alias("marks"))
    slots = sums.where("mark is null and w >= 0").drop("mark").join(fixed, ["host", "w"], "left")
    listed = slots.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("w", "n", "boiler", "chars", "linked", F.coalesce("fixed", F.lit(0)).alias("fixed"), "marks"))).alias("slots"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for rule, pages, rows in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                own = json.loads(rule)
                take, told = choose(Wrapper(own["wrapper"]), pages, {r["w"]: Slot(r["n"], r["boiler"], r["chars"], r["linked"], r["fixed"]) for r in rows or ()})
                own["take"] = take
                own["fixed"] = [[r["w"], r["marks"]] for r in rows or () if told and r["w"] in set(take) and r["marks"]]
                made.append(json.dumps(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["host", "rule"])

    return durable(found.join(listed, "host", "left").mapInArrow(tidy(decide), "host string, rule string"))


def extract(pages: DataFrame, out: str = "text") -> DataFrame:
    """pages with the main text of each page's html."""
    kept = [c for c in pages.columns if c != out]
    host = "host_of_" + "_".join(pages.columns)  # longer than any of them
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != out)
    hosted = pages.select(*kept, _host().alias(host))

    def texts(batch: pa.RecordBatch, sources: list[str], known: list[Rule]) -> pa.RecordBatch:
        made = [rule.text_of(Page(s)) for s, rule in zip(sources, known, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(made, pa.string())], [*kept, out])

    return _per_host(hosted, rules(hosted.select("html", host)), texts, f"{schema}, `{out}` string")
