"""Quotation linking in conversations.

A line's quote level is its number of leading ``>`` marks.  Consecutive lines of
one level without a blank one between are a passage.  Quoted passages, lower-cased
and with single spaces, are hashed and joined to the earliest message that says
the same at level 0: first in the same conversation at an earlier turn, else in
the earliest other conversation.  A message replies to what it quotes at the
lowest level first; replies follow what they answer, and quotes are left out.

Everything is DataFrame expressions.  Originals are aggregated to one row per hash
before the join, so a passage that a third of all messages hold joins to one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, save

_MARK = r"^((?:[ \t]*>)+)"


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, own text, deepest level and ``passages`` (level, place, hash) of each row."""
    src = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.translate(body(), "\r\x01\x02", "\n").alias("text"))
    lines = src.withColumn("raw", F.split("text", "\n", -1)).withColumn("lines", F.transform("raw", lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 1), "[^>]", "")).alias("level"),
        F.btrim(F.regexp_replace(x, _MARK, ""), F.lit(" \t")).alias("body"),
    )))
    # a level-0 line "... wrote:" just before a quote only says whose it is
    lines = lines.withColumn("lines", F.expr("""
        transform(array(lines), l -> transform(l, (x, i) -> if(x.level = 0 and x.body rlike '(?i)\\\\bwrote:$' and coalesce(get(l, i + 1).level, 0) > 0,
                                                               named_struct('level', -1, 'body', ''), x)))[0]"""))  # fmt: skip
    joined = F.expr("""
        array_join(transform(array(lines), l -> transform(l, (x, i) -> concat(
          if(i > 0 and coalesce(get(l, i - 1).level = x.level and get(l, i - 1).body <> '' and x.body <> '', false), ' ',
             concat(char(1), cast(x.level as string), char(2))), x.body)))[0], '')""")  # fmt: skip
    cut = lines.withColumn("found", F.split(joined, "\x01", -1))
    passages = F.expr(r"""
        filter(transform(found, (p, i) -> named_struct(
          'level', cast(nullif(split_part(p, char(2), 1), '') as int), 'place', i,
          'said', btrim(regexp_replace(lower(split_part(p, char(2), 2)), '[ \\t\\n\\x0b\\f]+', ' ')))), s -> s.said <> '')""")  # fmt: skip
    own = F.expr("array_join(transform(filter(arrays_zip(raw, lines), z -> z.lines.level = 0), z -> z.raw), '\n')")
    return cut.select(
        "conv_id", "turn", "role", "text", F.regexp_replace(own, r"\A\s+|\s+\z", "").alias("own"),
        F.expr("greatest(0, array_max(transform(lines, x -> x.level)))").alias("deepest"),
        F.transform(passages, lambda s: F.struct(s.level.alias("level"), s.place.alias("place"), F.md5(s.said).alias("hash"))).alias("passages"),
    )


def linked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, to_conv, to_turn, quotes, links of the keys that quote; nulls where nothing is found."""
    each = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*")
    quoted = each.where("level > 0")
    said = each.where("level = 0").join(quoted.select("hash").distinct(), "hash", "left_semi")
    here = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("first_turn"))
    anywhere = here.groupBy("hash").agg(F.min(F.struct("conv_id", "first_turn")).alias("first"))
    found = quoted.join(here, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
    near = F.col("first_turn") < F.col("turn")
    far = F.col("first.conv_id") != F.col("conv_id")
    to = F.when(near, F.struct(F.col("conv_id").alias("conv"), F.col("first_turn").alias("at"))).when(far, F.struct(F.col("first.conv_id").alias("conv"), F.col("first.first_turn").alias("at")))
    found = found.select("conv_id", "turn", F.when(to.isNotNull(), F.struct("level", "place", to.conv.alias("conv"), to.at.alias("at"))).alias("link"))
    return found.groupBy("conv_id", "turn").agg(F.min("link").alias("first"), F.count(F.lit(1)).alias("quotes"), F.count("link").alias("links")).select(
        "conv_id", "turn", F.col("first.conv").alias("to_conv"), F.col("first.at").alias("to_turn"), "quotes", "links"
    )


def rooted(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of the replies within a conversation, by pointer jumping."""
    up = save(links.where("to_conv = conv_id").select("conv_id", "turn", F.col("to_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        over = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        joined = up.join(over, ["conv_id", "root_turn"], "left")
        if joined.where("next is not null").isEmpty():
            return up
        up = save(joined.select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")


def conversations(messages: DataFrame) -> DataFrame:
    """Messages without quotes, in the order of replies.

    conv_id, turn, role, text (without quotes), position (from 0 in its
    conversation), deepest, quotes, links, to_conv, to_turn, root_turn, depth.
    Positions go by the turn that a chain of replies starts with, then by turn,
    role and text.  Rows that share conv_id and turn are one message as regards
    links and keep a row each; a null conv_id or turn takes no part in links; a
    null text counts as empty.  No rows give none; other columns are ignored.
    """
    rows = save(parsed(messages), "parsed")
    links = save(linked(rows), "links")
    out = rows.join(links, ["conv_id", "turn"], "left").join(rooted(links), ["conv_id", "turn"], "left")
    out = out.withColumn("root_turn", F.coalesce("root_turn", "turn"))
    order = Window.partitionBy("conv_id").orderBy(F.col("root_turn").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), (F.row_number().over(order) - 1).cast("long").alias("position"),
        F.col("deepest").cast("long").alias("deepest"), F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("links", F.lit(0)).alias("links"),
        "to_conv", "to_turn", "root_turn", F.coalesce("depth", F.lit(0)).alias("depth"),
    )
