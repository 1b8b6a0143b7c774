"""Best representative of each duplicate group, by iterative truth discovery.

Members of a group claim values for fields; each claim comes from a source. Starting from equal trust, the claims vote
with their source's reliability, each field of each group takes the value with the highest support, and a source's
reliability becomes the share of its votes that went to such values; this alternates until no reliability moves by more
than ``tolerance``. Reliability follows from the chosen values alone, so that values chosen a second time end it too: if
they were chosen the round before, nothing can change any more; if earlier, the rounds since go round in a circle, and
each source is given its mean reliability in them. Claims are summed by group, field, value and source before anything else, so that a group that holds
a third of all records costs no more than its distinct values.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut

#: Texts that stand for "not known", in lower case.
STAND_INS = ["", "-", "--", "?", "n/a", "na", "nil", "none", "null", "undefined", "unknown", "unspecified"]


def said_text(text: Column) -> Column:
    """The text without blanks around it, or NULL where it says nothing."""
    bare = F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")
    return F.when(~F.lower(bare).isin(STAND_INS), bare)


def said_date(text: Column) -> Column:
    """The text, where it is a date that exists, written as cameras do."""
    bare = said_text(text)
    return F.when(F.try_to_timestamp(bare, F.lit("yyyy:MM:dd HH:mm:ss")).isNotNull(), bare)


def said_number(text: Column) -> Column:
    """The number as text, where it is one and not zero."""
    number = said_text(text).try_cast("double")
    return F.when((number != 0) & ~F.isnan(number), number.cast("string"))


def claims_of(members: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(group_id, id, source, recency, field, value): one row for each field of which a member says something."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), value.cast("string").alias("value")) for name, value in fields.items()])
    long = members.select("group_id", "id", "source", "recency", F.explode(pairs).alias("x"))
    return long.select("group_id", "id", "source", "recency", "x.field", "x.value").where("value is not null")


def survivors(claims: DataFrame, largest: tuple[str, ...] = (), tolerance: float = 1e-3, most_rounds: int = 1000, prior: float = 2.0) -> DataFrame:
    """(group_id, field, value, id, claimants, agreeing, support): the surviving value of each field of each group.

    claims: group_id, id, source, recency (DOUBLE), field, value (STRING); other columns are ignored. id is the member
    that gives the value: of those that claim it the one with the latest recency, then the smallest id. claimants are
    the members that say anything about the field, agreeing those that claim the survivor. Fields in ``largest`` take
    the largest number instead of a vote. Equal support is decided by the latest recency, then by the value as text.
    NULL groups, members, fields and values claim nothing; a NULL source is a source of its own; repeated rows of a
    member count once; no claims give no rows. ``prior`` is the number of half-right votes each source starts with. It
    runs until it has converged; should it not have after ``most_rounds``, it fails. For sizes of copies of one file the
    largest is what is wanted (the others were cut or made smaller), however few have it: such fields aren't voted on.
    """
    given = claims.where("group_id is not null and id is not null and field is not null and value is not null")
    recency = F.coalesce(F.col("recency").cast("double"), F.lit(float("-inf")))
    given = given.select("group_id", "id", F.coalesce("source", F.lit("")).alias("source"), recency.alias("recency"), "field", "value").distinct()
    voices = cut(
        given.groupBy("group_id", "field", "value", "source").agg(
            F.count("*").alias("n"), F.max(F.struct("recency", (-F.col("id")).alias("less"))).alias("giver")
        )
    )
    votes = voices.where(~F.col("field").isin(*largest)) if largest else voices
    # only contested fields move; of the others each source has won its n votes for good
    spread = votes.groupBy("group_id", "field").agg((F.min("value") != F.max("value")).alias("contested"))
    marked = cut(votes.join(spread, ["group_id", "field"]))
    contested = marked.where("contested")
    base = marked.groupBy("source").agg(F.sum("n").alias("all"), F.sum(F.when(~F.col("contested"), F.col("n")).otherwise(0)).alias("won"))
    trust = cut(base.withColumn("trust", F.lit(1.0)))

    def best(voices: DataFrame, trust: DataFrame) -> DataFrame:
        voted = voices.join(trust.select("source", "trust"), "source")
        by_value = voted.groupBy("group_id", "field", "value").agg(
            F.sum(F.col("n") * F.col("trust")).alias("support"), F.max("giver").alias("giver"), F.sum("n").alias("agreeing")
        )
        top = F.max(F.struct("support", "giver.recency", "value", "giver.less", "agreeing")).alias("top")
        return by_value.groupBy("group_id", "field").agg(top, F.sum("agreeing").alias("claimants"))

    seen: dict[tuple, int] = {}
    states: list[DataFrame] = []
    while not contested.isEmpty() and len(states) <= most_rounds:
        if len(states) == most_rounds:
            raise RuntimeError(f"trust still changes after {most_rounds} rounds")
        chosen = cut(best(contested, trust).select("group_id", "field", F.col("top.value").alias("value")))
        mark = tuple(chosen.agg(F.count("*"), F.sum(F.xxhash64("group_id", "field", "value").cast("decimal(38,0)"))).first())
        if mark in seen:
            circle = states[seen[mark] :]
            if len(circle) > 1:
                every = functools.reduce(DataFrame.unionByName, [s.select("source", "trust") for s in circle])
                trust = cut(every.groupBy("source").agg(F.avg("trust").alias("trust")))
            break
        seen[mark] = len(states)
        won = contested.join(chosen, ["group_id", "field", "value"]).groupBy("source").agg(F.sum("n").alias("more"))
        share = (F.col("won") + F.coalesce("more", F.lit(0)) + prior / 2) / (F.col("all") + prior)
        moved = cut(trust.join(won, "source", "left").select("source", "all", "won", share.alias("trust"), F.abs(share - F.col("trust")).alias("step")))
        largest_step = moved.agg(F.max("step")).first()[0] or 0.0
        trust = moved
        states.append(trust)
        if largest_step <= tolerance:
            break
    out = best(marked, trust).select(
        "group_id", "field", "top.value", (-F.col("top.less")).alias("id"), "claimants", F.col("top.agreeing").alias("agreeing"), F.col("top.support").alias("support")
    )
    if not largest:
        return out
    number = F.col("value").try_cast("double").alias("number")
    sizes = voices.where(F.col("field").isin(*largest)).groupBy("group_id", "field", "value").agg(F.sum("n").alias("agreeing"), F.max("giver").alias("giver"))
    top = F.max(F.struct(number, "value", "giver.less", "agreeing")).alias("top")
    sizes = sizes.groupBy("group_id", "field").agg(top, F.sum("agreeing").alias("claimants"))
    return out.unionByName(
        sizes.select("group_id", "field", "top.value", (-F.col("top.less")).alias("id"), "claimants", F.col("top.agreeing").alias("agreeing"), F.col("top.number").alias("support"))
    )
