r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template: a turn is ``### role:`` on a line, its text, and ``</turn>`` on a line.  ``### `` and
``</turn>`` are the control strings.  Inside texts a control string that follows any number of
backslashes gets one more; reading takes one away.  Roles write ``\`` as ``\\``, newlines as ``\n`` and
a null role as ``\0``.

Each conversation is first rendered as it is, parsed by the grammar and compared with its source turns.
Where they differ, its texts are escaped and it is rendered and parsed again (level 1), which the
escape makes identical for any text; ``identical`` says so of each row.

Nulls: a null text is empty, a null turn sorts first, rows without conv_id are one conversation.  Ties
and repeated rows sort by turn, role, text and are turns each.  Other columns are ignored.  An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
CONTROL = r"(\\*)(### |</turn>)"
#: A control string that no backslash precedes.
BARE = r"(?<!\\)(### |</turn>)"
END = "\n" + CLOSE + "\n"


def _role_out(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.coalesce(plain, F.lit("\\0"))


def _role_in(role: Column) -> Column:
    # Cut at pairs of backslashes, from the left; what is left between holds "\\n" for newlines only.
    back = F.array_join(F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")
    return F.when(role == "\\0", F.lit(None).cast("string")).otherwise(back)


def render(turns: Column, escape: bool) -> Column:
    """turns: array of (role, text); one string."""

    def one(t: Column) -> Column:
        text = F.regexp_replace(t["text"], CONTROL, r"\\$1$2") if escape else t["text"]
        return F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit(":\n"), text, F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """array of (role, text), or null where the string isn't of the grammar."""
    parts = F.split(rendered, END)
    body = F.slice(parts, 1, F.size(parts) - 1)

    def header(p: Column) -> Column:
        return F.substring_index(p, "\n", 1)

    def text(p: Column) -> Column:
        return p.substr(F.length(header(p)) + 2, F.length(p))

    def fits(p: Column) -> Column:
        h = header(p)
        return h.startswith(OPEN) & h.endswith(":") & (F.length(h) < F.length(p)) & ~text(p).rlike(BARE)

    def turn(p: Column) -> Column:
        h = header(p)
        role = _role_in(h.substr(F.lit(len(OPEN) + 1), F.length(h) - len(OPEN) - 1))
        return F.struct(role.alias("role"), F.regexp_replace(text(p), r"\\(\\*)(### |</turn>)", "$1$2").alias("text"))

    good = (F.element_at(parts, -1) == "") & F.forall(body, fits)
    return F.when(good, F.transform(body, turn))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: a row a conversation.

    A conversation's text is one value, so its turns meet in one row by what is asked for.
    """
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(
            conversations["turn"].cast("long").alias("turn"), conversations["role"].cast("string").alias("role"),
            F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    bare = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), bare).alias("turns"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, rendered, parsed (turns read back), escape_level, identical."""
    plain = turns_of(conversations).withColumn("plain", render(F.col("turns"), False))
    plain = plain.withColumn("read", parse(F.col("plain"))).withColumn("same", F.coalesce(F.col("read").eqNullSafe(F.col("turns")), F.lit(False)))
    level = F.when(F.col("same"), 0).otherwise(1)
    out = plain.withColumn("rendered", F.when(F.col("same"), F.col("plain")).otherwise(render(F.col("turns"), True)))
    out = out.withColumn("parsed", F.when(F.col("same"), F.col("read")).otherwise(parse(F.col("rendered"))))
    return out.select("conv_id", "rendered", "parsed", level.alias("escape_level"), F.coalesce(F.col("parsed").eqNullSafe(F.col("turns")), F.lit(False)).alias("identical"))


def with_spans(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds spans: for each turn, (role, from, to) in code points of its text in the rendered string, and loss (of ``role``)."""
    escaped = F.transform("parsed", lambda t: F.struct(F.length(_role_out(t["role"])).alias("r"), F.when(F.col("escape_level") == 1, F.length(F.regexp_replace(t["text"], CONTROL, r"\\$1$2"))).otherwise(F.length(t["text"])).alias("n"), t["role"].alias("role")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,start:int,end:int,loss:boolean>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + t["r"] + F.lit(len(OPEN) + 2)
        span = F.struct(t["role"].alias("role"), begin.alias("start"), (begin + t["n"]).alias("end"), F.coalesce(t["role"] == role, F.lit(False)).alias("loss"))
        return F.struct((begin + t["n"] + len(END)).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return formatted.withColumn("spans", F.aggregate(escaped, start, step, lambda a: a["spans"]))


def digest(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """What was read back, as counts and checksums."""
    turns = F.col("parsed")
    whole = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
    return formatted.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("rendered").cast("long").alias("formatted_chars"), "escape_level", "identical",
    )
