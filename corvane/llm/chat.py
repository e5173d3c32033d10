"""Chat formatting with DataFrame expressions only.

Turns are collected per conversation as structs and sorted. Runs of adjacent turns
of one role are merged by array aggregation into one block of the template; inside
it each further turn starts with a continuation mark, so nothing of the input is
lost. The aggregation also tells where in its block each text under the loss mask
lies; with the sizes of the blocks before it this gives the mask: spans of bytes of
the formatted string. Every control string of the template starts with ``<`` or
``[``, and texts have these two characters (and the escape character ``\\``)
replaced by two-character escapes, so a text can never look like template.

Template (BOS ``<s>``, then blocks)::

    user       [INST]text[INST+]text[/INST]
    assistant  [OUT]text[OUT+]text</s>
    system     [SYS]text[SYS+]text[/SYS]
    others     [ROLE]role[TEXT]text[ROLE+]role[TEXT]text[/ROLE]

A run of more than RUN turns is merged in several steps, so the work stays in
proportion to the turns however long a run is.

Edge cases: null text or role counts as empty, null turn sorts first, ties of
turn are ordered by role, then text, repeated rows are repeated turns, a null
conv_id is a conversation of its own, texts may have any length, an empty table
gives no rows. Only the four named columns are read, so other columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPENING = {"user": "[INST", "assistant": "[OUT", "system": "[SYS"}
BOS = "<s>"
CLOSING = {"user": "[/INST]", "assistant": "</s>", "system": "[/SYS]"}
LOSS_ROLE = "assistant"
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))
#: Turns that are merged in one step.
RUN = 256
MARK = r"([<\[][^<\[>\]]*[>\]])([^<\[]*)"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _by_role(role: Column, values: dict[str, str], other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for a value that a lambda within use() would compute again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _merged(run: Column) -> Column:
    """Of a run of turns (mark, text, close, loss): struct<text, size in bytes, spans array<struct<start, size>>> with the spans under the mask."""
    size = lambda c: F.octet_length(c).cast("long")
    empty = F.struct(
        F.expr("cast(array() as array<string>)").alias("parts"),
        F.lit(0).cast("long").alias("size"),
        F.expr("cast(array() as array<struct<start:bigint,size:bigint>>)").alias("spans"),
    )

    def merge(held: Column, t: Column) -> Column:
        span = F.struct((held["size"] + size(t["mark"])).alias("start"), size(t["text"]).alias("size"))
        return F.struct(
            F.concat(held["parts"], F.array(t["mark"], t["text"], t["close"])).alias("parts"),
            (held["size"] + size(t["mark"]) + size(t["text"]) + size(t["close"])).alias("size"),
            F.when(t["loss"], F.concat(held["spans"], F.array(span))).otherwise(held["spans"]).alias("spans"),
        )

    return F.aggregate(run, empty, merge, lambda x: F.struct(F.array_join(x["parts"], "").alias("text"), x["size"].alias("size"), x["spans"].alias("spans")))


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id, formatted, mask array<struct<start, size>>: the bytes of formatted under the loss mask, which are the (escaped) assistant texts."""
    turns = (
        df.select(
            "conv_id",
            F.struct(
                F.col("turn"),
                F.coalesce(F.col("role"), F.lit("")).alias("role"),
                F.coalesce(F.col("text"), F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .withColumn("roles", F.transform("turns", lambda t: t["role"]))
    )
    roles, n = F.col("roles"), F.size("turns")

    def marked(t: Column, i: Column) -> Column:
        role = t["role"]
        sign = F.when((i > 0) & (F.get(roles, i - 1) == role), F.lit("+]")).otherwise(F.lit("]"))
        other = F.concat(F.lit("[ROLE"), sign, escape(role), F.lit("[TEXT]"))
        opening = F.when(role.isin(*OPENING), F.concat(_by_role(role, OPENING, F.lit("")), sign)).otherwise(other)
        last = F.coalesce(F.get(roles, i + 1) != role, F.lit(True))
        closing = F.when(last, _by_role(role, CLOSING, F.lit("[/ROLE]"))).otherwise(F.lit(""))
        return F.struct(opening.alias("mark"), escape(t["text"]).alias("text"), closing.alias("close"), (role == LOSS_ROLE).alias("loss"))

    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i % RUN == 0) | (F.get(roles, i - 1) != F.get(roles, i)))
    turns = turns.withColumn("marked", F.transform("turns", marked)).withColumn("starts", starts)
    run = lambda m, i, k: F.slice(m, i + 1, F.coalesce(F.get("starts", k + 1), n) - i)
    blocks = turns.select("conv_id", _once(F.col("marked"), lambda m: F.transform("starts", lambda i, k: _merged(run(m, i, k)))).alias("blocks"))
    # where each block starts: sums over stretches of RUN blocks, then within the stretch
    sizes = F.transform("blocks", lambda b: b["size"])
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    sums = lambda a, first: F.slice(F.aggregate(a, F.array(first), lambda x, y: F.concat(x, F.array(F.element_at(x, -1) + y))), 1, F.size(a))
    placed = blocks.withColumn("sizes", sizes).withColumn("stretches", _once(F.col("sizes"), lambda sizes: F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda k: F.slice(sizes, k * RUN + 1, RUN))))
    placed = placed.withColumn("bases", sums(F.transform("stretches", total), F.lit(len(BOS)).cast("long")))
    placed = placed.withColumn("at", F.flatten(F.zip_with("stretches", "bases", sums)))
    mask = F.flatten(F.zip_with("blocks", "at", lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["size"].alias("size")))))
    return placed.select("conv_id", F.concat(F.lit(BOS), F.array_join(F.transform("blocks", lambda b: b["text"]), "")).alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, mask, turns array<struct<mark, role, text>>: the turns as the formatted string holds them."""
    parts = F.arrays_zip(
        F.regexp_extract_all("formatted", F.lit(MARK), F.lit(1)).alias("mark"),
        F.regexp_extract_all("formatted", F.lit(MARK), F.lit(2)).alias("body"),
    )
    roles = {f"{opening}{sign}": role for role, opening in OPENING.items() for sign in ("]", "+]")}
    marked = formatted.select("conv_id", "formatted", "mask", parts.alias("parts"))
    turn = lambda p, i: F.struct(
        p["mark"].alias("mark"),
        F.when(p["mark"] == "[TEXT]", unescape(F.get("parts", i - 1)["body"])).otherwise(_by_role(p["mark"], roles, F.lit(None))).alias("role"),
        unescape(p["body"]).alias("text"),
    )
    return marked.select("conv_id", "formatted", "mask", F.filter(F.transform("parts", turn), lambda t: t["role"].isNotNull()).alias("turns"))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped text of the bytes of formatted under the mask, end to end."""
    piece = lambda data, s: F.substring(data, (s["start"] + 1).cast("int"), s["size"].cast("int")).cast("string")
    return unescape(F.array_join(_once(formatted.cast("binary"), lambda data: F.transform(mask, lambda s: piece(data, s))), ""))


def digests(df: DataFrame) -> DataFrame:
    """The op5 digest of format_conversations(), from the formatted string and its mask."""
    loss = under_mask(F.col("formatted"), F.col("mask"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(df).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
