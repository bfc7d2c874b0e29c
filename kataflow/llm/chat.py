"""Chat formatting (native): event logs folded into final messages, then rendered by a reversible template.

Events have a conversation, a message number, a sequence number, a kind, a role and a text: "delta" appends, "edit"
replaces the message, "regenerate" discards what came before it (its own text starts the message anew). Ties in the
sequence number fold in the order of kind, role and text. A message's role is its last one that isn't null; null texts
and roles are empty. Each message renders as

    ### role
    text</turn>

with backslash, '#' and '<' of roles and texts written as \\\\, \\h and \\l (and a line break of a role as \\n), so that no
text can end a turn or open one. The loss mask are the escaped texts of assistant messages, as code point spans.

Empty logs give no rows; a null conversation is a conversation of its own; other columns are ignored. A conversation
comes together in one row because its rendering is one string (some 500 million characters at most: an array of Spark's
has 2 GB and the mask is read at four bytes a character); messages fold before that, spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"


def _escape(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescape(text: Column) -> Column:
    """Two backslashes are one, whatever stands next to them; pairs are found from the left, as they were written."""
    parts = F.split(text, r"\\\\", -1)
    plain = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.array_join(F.transform(parts, plain), "\\")


def log_rows(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a service that wrote them; equal turns follow each other by role, then text.

    An assistant's message begins with a delta that a regeneration discards, then comes in two deltas; any other message
    comes in one delta that an edit replaces by the whole text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))
    event = lambda seq, kind, part, role=F.lit(None).cast("string"): F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), part.alias("text"))
    streamed = F.array(event(0, "delta", second, F.col("role")), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", second))
    edited = F.array(event(0, "delta", first, F.col("role")), event(1, "edit", text))
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    events = numbered.select("conv_id", "message", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return events.select("conv_id", "message", "e.seq", "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages as the last event leaves them."""
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    folded = events.groupBy("conv_id", "message").agg(log.alias("log"))
    resets = F.filter(F.sequence(F.lit(1), F.size("log")), lambda i: F.element_at("log", i)["kind"].isin("edit", "regenerate"))
    since = F.slice("log", F.greatest(F.coalesce(F.array_max(resets), F.lit(1)), F.lit(1)), F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return folded.select(
        "conv_id", "message",
        F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise(F.lit("")).alias("role"),
        F.array_join(F.transform(since, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): a row per conversation."""
    text = _escape(F.col("text"))
    role = F.replace(_escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    pieces = messages.select("conv_id", "message", (F.col("role") == "assistant").alias("loss"), F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), text.alias("body"))
    width = F.char_length("head") + F.char_length("body") + len(CLOSE)
    upto = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.select("conv_id", "message", "loss", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), (F.sum(width).over(upto) - len(CLOSE)).alias("end"), F.char_length("body").alias("n"))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "piece", "loss", "end", "n"))).alias("all"))
    spans = F.transform(F.filter("all", lambda x: x["loss"]), lambda x: F.struct((x["end"] - x["n"]).alias("start"), x["end"].alias("end")))
    return rows.select("conv_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendering."""
    turns = F.split(formatted, CLOSE, -1)

    def turn(x: Column) -> Column:
        two = F.split(x, "\n", 2)
        return F.struct(_unescape(F.substring(two[0], F.lit(len(OPEN) + 1), F.char_length(two[0]))).alias("role"), _unescape(two[1]).alias("text"))

    return F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the spans, unescaped, one after another.

    Cut out of the code points at four bytes each, so that a span costs its own length wherever it stands.
    """
    points = F.encode(formatted, "UTF-32")
    mark = F.lit(b"\x00\x00\xfe\xff")  # taken off by decode, so that a text's own first mark stays
    cut = lambda x: F.decode(F.concat(mark, F.substring(points, x["start"] * 4 + 1, (x["end"] - x["start"]) * 4)), "UTF-32")
    return F.array_join(F.transform(spans, lambda x: _unescape(cut(x))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """The columns of the contract: turns read back from `formatted`, the loss from what the mask covers of it."""
    both = rendered.select(
        "conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("said")
    )
    return both.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars",
    )
