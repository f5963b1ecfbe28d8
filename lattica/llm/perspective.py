"""Multi-party perspective rotation, DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant and all
others as named users; the mask marks the assistant's own words. A rendering comes in numbered pieces of a fixed
number of turns, so that no row grows with the dialogue; character offsets run on from piece to piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import written

LAST = (1 << 63) - 1
#: Pieces whose lengths are added up by one window; the sums of such groups are added up by another.
GROUP = 1024


def _heading(name: Column) -> Column:
    return F.concat(F.lit("<|user name="), name, F.lit("|>\n"))


OWN_HEADING = "<|assistant|>\n"


def numbered(turns: DataFrame) -> DataFrame:
    """The different turns (key, conv_id, turn, speaker, text) with their place in the dialogue (idx, from 0).

    Rows are sorted by ranges over all dialogues, so a long dialogue lies in many partitions; a row's place is that
    in its partition and the numbers of the dialogue's rows in the partitions before."""
    speaker = F.trim(F.col("role").cast("string"))
    conv = F.col("conv_id").cast("string")
    base = turns.select(
        F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv)).alias("key"), "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.when(F.length(speaker) > 0, speaker).otherwise(F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    order = ["key", "turn", "speaker", "tie"]
    ranged = base.withColumn("tie", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    low = F.lit((1 << 33) - 1)
    placed = written(ranged.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id().bitwiseAND(low)}).drop("tie"), "perspective-turns")
    runs = placed.groupBy("key", "part").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(runs, ["key", "part"]).select("key", "conv_id", "turn", "speaker", "text", (F.col("pos") + F.col("shift")).alias("idx"))


def _starts(counts: DataFrame) -> DataFrame:
    """counts (key, piece, speaker, n, chars): of each speaker's turns in a piece -> key, piece, speaker, start: where
    the piece begins in that speaker's rendering, for all speakers of the dialogue."""
    who = counts.select("key", "speaker").distinct()
    pieces = counts.groupBy("key", "piece").agg(F.sum("chars").alias("chars"))
    own = counts.select("key", "piece", "speaker", "n")
    saved = F.lit(len(OWN_HEADING)) - F.length(_heading(F.col("speaker")))
    each = pieces.join(who, "key").join(own, ["key", "piece", "speaker"], "left").withColumn("chars", F.col("chars") + F.coalesce("n", F.lit(0)) * saved)
    each = each.withColumn("group", F.floor(F.col("piece") / GROUP)).drop("n")
    sums = each.groupBy("key", "speaker", "group").agg(F.sum("chars").alias("chars"))

    def before(*keys: str, order: str) -> Column:
        return F.coalesce(F.sum("chars").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = sums.select("key", "speaker", "group", before("key", "speaker", order="group").alias("base"))
    each = each.withColumn("within", before("key", "speaker", "group", order="piece"))
    return each.join(sums, ["key", "speaker", "group"]).select("key", "piece", "speaker", (F.col("base") + F.col("within")).alias("start"))


def rotate(turns: DataFrame, piece_turns: int = 64) -> DataFrame:
    """turns (conv_id, turn, role, text) -> for each dialogue and each of its participants the whole dialogue, in pieces
    of piece_turns turns (the last one may be shorter): conv_id, speaker, piece (from 0), n_turns, messages
    array<struct<role, name, content, train>>, text, start (the characters of the rendering before this piece), spans
    (array of struct<start, end>: characters to learn from, counted from the rendering's first). A participant's
    pieces, joined in order, are the rendering.

    Turns are in order of turn, speaker and the text's MD5; a null turn comes last. Rows that repeat in all four
    columns are one turn. A null or blank role is the speaker `unknown`, a null text is empty, rows with a null conv_id
    form one dialogue. Texts are rendered whole, however long. Other columns, whatever their names, are left out. An
    empty table gives none."""
    rows = numbered(turns).withColumn("piece", F.floor(F.col("idx") / piece_turns))
    chars = F.length(_heading(F.col("speaker"))) + F.length("text") + 1
    starts = _starts(rows.groupBy("key", "piece", "speaker").agg(F.count("*").alias("n"), F.sum(chars).alias("chars")))
    whole = rows.groupBy("key", "piece").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("idx", F.col("speaker").alias("name"), "text"))).alias("turns"))
    each = whole.join(starts, ["key", "piece"])

    def own(x: Column) -> Column:
        return x["name"] == F.col("speaker")

    def head(x: Column) -> Column:
        return F.when(own(x), F.lit(OWN_HEADING)).otherwise(_heading(x["name"]))

    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(head(x))
        end = begin + F.length(x["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(own(x) & (end > begin), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    message = F.transform("turns", lambda x: F.struct(F.when(own(x), F.lit("assistant")).otherwise(F.lit("user")).alias("role"), F.when(~own(x), x["name"]).alias("name"), x["text"].alias("content"), own(x).alias("train")))
    return each.select(
        "conv_id", "speaker", "piece", F.size("turns").cast("long").alias("n_turns"), message.alias("messages"),
        F.array_join(F.transform("turns", lambda x: F.concat(head(x), x["text"], F.lit("\n"))), "").alias("text"), "start", F.aggregate("turns", zero, add)["spans"].alias("spans"),
    )


def digest(rotated: DataFrame) -> DataFrame:
    span = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotated.select(
        "conv_id", "speaker", "piece", "n_turns", "start", F.length("text").cast("long").alias("n_chars"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_own_chars"), F.sha2("text", 256).alias("text_sha256"), span.alias("mask"),
    )
