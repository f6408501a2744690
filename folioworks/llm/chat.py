"""Chat formatting with a grammar that reads back what was written.

    conversation = turn*          turn = "### " role ": " text "</turn>" newline

A backslash takes its meaning from the character behind it.  Everything here is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"
_TURN = r"(?s)^### ((?:[^:\\]++|\\.)*+): (.*)$"


def escaped(text: Column) -> Column:
    """No control string is left; :func:`unescaped` gives the text back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("#\\##"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _rendered(turns: Column, escape: bool) -> Column:
    def one(turn: Column) -> Column:
        role, text = turn["role"], turn["text"]
        if escape:
            role, text = F.replace(escaped(role), F.lit(":"), F.lit("\\:")), escaped(text)
        return F.concat(F.lit(HEAD), role, F.lit(": "), text, F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, by the grammar alone."""
    return F.transform(
        _turns(formatted),
        lambda c: F.struct(
            unescaped(F.regexp_extract(c, _TURN, 1)).alias("role"), unescaped(F.regexp_extract(c, _TURN, 2)).alias("text")),
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, escape_level, turns, identical) of every conversation.

    Turns stand in the order of turn, role and text (null turns first); null
    texts and roles are empty; rows without conv_id form the conversation null.
    A conversation is first rendered as it is (level 0) and reparsed; if the
    recovered turns differ from the source, it is rendered with its control
    strings escaped (level 1) and reparsed again: a control string that reads back
    unharmed stays as it is.  ``turns`` are the recovered ones, ``identical`` says
    that they equal the source.  Other columns are left out; repeated rows are turns
    of their own; an empty table gives an empty one.  Texts are handled whole, a
    conversation by one task, in time proportional to its length.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("source"))
    source = source.withColumn("source", F.transform("source", lambda t: F.struct(t["role"], t["text"])))
    plain = source.withColumn("plain", _rendered(F.col("source"), False)).withColumn("plain_turns", parsed(F.col("plain")))
    plain = plain.withColumn("escape_level", F.when(F.col("plain_turns") == F.col("source"), 0).otherwise(1))
    full = plain.withColumn(
        "formatted", F.when(F.col("escape_level") == 0, F.col("plain")).otherwise(_rendered(F.col("source"), True)))
    full = full.withColumn(
        "turns", F.when(F.col("escape_level") == 0, F.col("plain_turns")).otherwise(parsed(F.col("formatted"))))
    return full.select("conv_id", "formatted", "escape_level", "turns", (F.col("turns") == F.col("source")).alias("identical"))


def _turns(formatted: Column) -> Column:
    """The rendered turns without their end marks."""
    chunks = F.split(formatted, END)
    return F.slice(chunks, 1, F.size(chunks) - 1)


def _running(sizes: Column) -> Column:
    """Sums up to and with each element, by doubling: a step adds what stands 1, 2, 4, ... places before.

    A fold that appends to its result would copy it for each element.
    """
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(
        steps, sizes, lambda acc, step: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - step), F.lit(0).cast("long"))))


def _ends(formatted: Column) -> Column:
    """Where each turn of ``formatted`` ends, behind its end mark."""
    return _running(F.transform(_turns(formatted), lambda c: (F.length(c) + len(END)).cast("long")))


def with_loss(chats: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds ``loss_spans``, an entry for each turn: (start, length) of its text in code points
    of ``formatted``, as it stands there, if the turn is trained, else null.

    An existing column of that name is replaced.  A conversation null has null spans.
    """
    texts = F.transform(_turns(F.col("formatted")), lambda c: F.struct(
        (unescaped(F.regexp_extract(c, _TURN, 1)) == role).alias("trained"),
        F.length(F.regexp_extract(c, _TURN, 2)).cast("long").alias("length")))
    return chats.withColumn("loss_spans", F.zip_with(texts, _ends(F.col("formatted")), lambda t, end: F.when(
        t["trained"], F.struct((end - len(END) - t["length"]).alias("start"), t["length"].alias("length")))))


def digest(chats: DataFrame) -> DataFrame:
    """The counts and hashes of what is read back from ``formatted`` and its mask."""
    places = F.zip_with(_turns(F.col("formatted")), _ends(F.col("formatted")), lambda c, end: F.struct(
        c.alias("chunk"), (end - len(END) - F.length(c)).alias("at")))
    trained = F.array_join(F.zip_with(places, F.col("loss_spans"), lambda p, s: F.when(s.isNull(), F.lit("")).otherwise(
        unescaped(F.substring(p["chunk"], (s["start"] - p["at"] + 1).cast("int"), s["length"].cast("int"))))), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "escape_level", "identical",
    )
