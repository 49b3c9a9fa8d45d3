"""Preference pairs: one prompt from the turns that chosen and rejected conversations share, and two masked completions.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns (turn, role, text) in order of turn, then role and text.

    A null turn number comes first, a null role is "unknown" and a null text empty. Rows that repeat another of
    their conversation whole count once; rows without a conversation are left out.
    """
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(f"`{role}`", F.lit("unknown")).alias("role"),
                        F.coalesce(f"`{text}`", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text"))).alias("turns"))


def common(a: str, b: str) -> Column:
    """How many turns two conversations share from the start: role and text are equal."""
    least = F.least(F.size(a), F.size(b))
    same = lambda i: (F.get(a, i)["role"] == F.get(b, i)["role"]) & (F.get(a, i)["text"] == F.get(b, i)["text"])
    differ = F.array_min(F.filter(F.sequence(F.lit(0), least), lambda i: ~F.coalesce((i < least) & same(i), F.lit(False))))
    return F.coalesce(differ, least)


def plain(text: Column) -> Column:
    """Text in which the template's own signs are broken up, so that no turn can forge another."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), plain(turn["role"]), F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(plain(turn["text"]), F.lit(CLOSE + "\n"))


def pieces(turns: Column, speaker: str) -> Column:
    """(text, trained) pieces: what the speaker says and its end are trained on, all else is masked."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(head(t).alias("text"), F.lit(False).alias("trained")), F.struct(body(t).alias("text"), (t["role"] == speaker).alias("trained")))))


def format_pairs(pairs: DataFrame, turns: DataFrame, chosen: str = "chosen_id", rejected: str = "rejected_id", speaker: str = "assistant") -> DataFrame:
    """Append n_prompt_turns, prompt, chosen and rejected to ``pairs``.

    ``prompt`` renders the longest common prefix of turns once; ``chosen`` and ``rejected`` are arrays of pieces
    (text, trained) of the turns after it, empty if a conversation ends there. Pairs of which a conversation is
    missing are left out; repeated pairs stay. Columns of the added names are replaced.
    """
    one = conversations(turns)
    base = pairs.drop("n_prompt_turns", "prompt", "chosen", "rejected", "_a", "_b")
    both = base
    for id_, name in ((chosen, "_a"), (rejected, "_b")):
        both = both.join(one.select(F.col("conv_id").alias(f"_id{name}"), F.col("turns").alias(name)), F.col(f"`{id_}`") == F.col(f"_id{name}")).drop(f"_id{name}")
    both = both.withColumn("n_prompt_turns", common("_a", "_b"))
    prompt = F.array_join(F.transform(F.slice("_a", F.lit(1), F.col("n_prompt_turns")), lambda t: F.concat(head(t), body(t))), "")
    rest = lambda c: pieces(F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0))), speaker)
    return both.select(*(F.col(f"`{c}`") for c in base.columns), "n_prompt_turns", prompt.alias("prompt"), rest("_a").alias("chosen"), rest("_b").alias("rejected"))


RANGES = 256  # conversations are dealt into so many ranges of ids to find each one's successor


def successors(ids: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): every conversation but the last with the one of the next existing id, whatever the gaps.

    Ids are dealt into ranges of about equal numbers (edges from a sketch of quantiles), in which a window finds
    successors. The successor of a range's last id is the first id of the next range: a window over ``RANGES`` rows.
    """
    edges = ids.agg(F.percentile_approx("conv_id", F.lit([k / RANGES for k in range(1, RANGES)]), 10 * RANGES)).first()[0] or []
    placed = ids.select("conv_id", F.size(F.filter(F.lit([int(e) for e in edges]).cast("array<bigint>"), lambda e: e <= F.col("conv_id"))).alias("_range"))
    inside = placed.withColumn("_next", F.lead("conv_id").over(Window.partitionBy("_range").orderBy("conv_id")))
    firsts = placed.groupBy("_range").agg(F.min("conv_id").alias("_first"))
    after = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))
    found = inside.join(F.broadcast(after), "_range")  # one row for each range
    return found.select(F.col("conv_id").alias("chosen_id"), F.coalesce("_next", "_after").alias("rejected_id")).where("rejected_id IS NOT NULL")


def pair_up(turns: DataFrame, salts: int = 64) -> DataFrame:
    """Pairs (kind, chosen_id, rejected_id) for a table that names none, as many as there are conversations at most twice.

    "opening": the least conversation of all with the same first turn against each other one of them; "neighbour":
    each conversation against that of the next existing id, but for the last one. An opening that many conversations
    share is dealt out over ``salts`` tasks.
    """
    firsts = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("f"))
    firsts = firsts.select("conv_id", F.sha2(F.concat_ws("\n", "f.role", "f.text"), 256).alias("opening"))
    least = firsts.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("_n")).where("_n > 1")
    salted = firsts.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int"))
    copies = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    opening = salted.join(copies.drop("_n"), ["opening", "_salt"]).where("conv_id > chosen_id").select(F.lit("opening").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"))
    return opening.unionByName(successors(firsts.select("conv_id")).select(F.lit("neighbour").alias("kind"), "chosen_id", "rejected_id"))
