"""Multi-party chat formatting: every dialogue once from each participant's view.

For each participant the dialogue is rendered with that speaker as the
assistant and all others as named users; system turns stay what they are. The
loss mask covers what the assistant says. Only DataFrame expressions are used.

A dialogue is one row for each participant. Only where its rendered turns pass
``most_chars`` is it written in parts: consecutive stretches of its turns, cut
by the running size of the turns before, so parts join up to the dialogue, and
nothing about them depends on how the table is partitioned. These running sizes
are taken by ranges, so that no task holds such a dialogue whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.ranks import running_sum

BEGIN, END = "<|im_start|>", "<|im_end|>"
_FRAME = 48  # characters that a turn's marks and head take, whoever speaks


def _parts(turns: DataFrame, most_chars: int) -> DataFrame:
    """Add ``part``, a turn's stretch of the dialogue, and ``copy``, the number of a repeated turn."""
    size = F.length("text") + F.length("name") + _FRAME
    turns = turns.withColumn("size", size.cast("long"))
    over = turns.groupBy("conv_id").agg(F.sum(F.col("n") * F.col("size")).alias("chars")).filter(F.col("chars") > most_chars).select(F.col("conv_id").alias("long_id"))
    copies = lambda t: t.withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)")))
    whole = copies(turns.join(over, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_anti")).withColumn("part", F.lit(0).cast("long"))
    if over.isEmpty():
        return whole.drop("n", "size")
    long = turns.join(over, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    long = running_sum(long, ["conv_id", "turn", "role", "text"], F.col("n") * F.col("size"), "upto")
    start = long.groupBy(F.col("conv_id").alias("long_id")).agg(F.min(F.col("upto") - F.col("n") * F.col("size")).alias("start"))
    long = copies(long.join(start, F.col("conv_id").eqNullSafe(F.col("long_id"))))
    before = F.col("upto") - (F.col("n") - F.col("copy")) * F.col("size") - F.col("start")
    return whole.unionByName(long.withColumn("part", F.floor(before / most_chars).cast("long")).select(*whole.columns)).drop("n", "size")


def rotate(turns: DataFrame, most_chars: int = 4 << 20) -> DataFrame:
    """Render ``conv_id, turn, role, text`` once for each participant.

    Returns ``conv_id, perspective`` (the speaker who is the assistant)``, part``
    (0, but for dialogues above ``most_chars``)``, n_turns, n_trained, text, mask``
    (start:end of trained content in the row's text, in code points,
    comma-joined). Participants are all distinct roles of the dialogue but
    ``system``. A null role is a participant too: a user without a name, and the
    null perspective. A null text is empty, a null turn comes first. Rows without
    a conversation id are one dialogue, that of the null id. Equal turns are
    ordered by role and text, and repeated rows are all rendered. Template marks
    in texts and names are broken up, and control characters in names are
    written as spaces. Empty input gives an empty result.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    own = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    own = own.withColumn("text", safe(F.col("text"))).withColumn("name", safe(F.regexp_replace(F.coalesce("role", F.lit("")), "[\\x00-\\x1F\\x7F]", " ")))
    speakers = turns.filter("role IS NULL OR role <> 'system'").select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    dealt = _parts(own, most_chars)
    seen = dealt.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("mine", F.col("role").eqNullSafe(F.col("perspective")))
    head = F.when(F.col("mine"), f"{BEGIN}assistant\n").when(F.col("role") == "system", f"{BEGIN}system\n").when(F.col("role").isNull(), f"{BEGIN}user\n").otherwise(F.concat(F.lit(f"{BEGIN}user name="), "name", F.lit("\n")))
    seen = seen.withColumn("head", head)
    order = W.partitionBy("conv_id", "perspective", "part").orderBy("turn", "role", "text", "copy").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.sum((F.length("head") + F.length("text") + len(END) + 1).cast("long")).over(order)
    placed = seen.withColumn("at", upto - F.length("text") - len(END) - 1)
    span = F.when(F.col("mine"), F.concat_ws(":", F.col("at").cast("string"), (F.col("at") + F.length("text")).cast("string")))
    # ``at`` grows with the turns' order, so it is the order of both lists
    rows = placed.select("conv_id", "perspective", "part", "mine", F.struct("at", F.concat("head", "text", F.lit(f"{END}\n")).alias("x")).alias("said"), F.when(F.col("mine"), F.struct("at", span.alias("x"))).alias("span"))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["x"]), by)
    return rows.groupBy("conv_id", "perspective", "part").agg(
        F.count("*").alias("n_turns"), F.sum(F.col("mine").cast("long")).alias("n_trained"), joined("said", "").alias("text"), joined("span", ",").alias("mask"),
    )


#: The same rows in DuckDB's SQL, for dialogues of one part.
SQL = f"""
    WITH own AS (
        SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text, replace(regexp_replace(coalesce(role, ''), '[\\x00-\\x1F\\x7F]', ' ', 'g'), '<|', '< |') AS name FROM conversations
    ), speakers AS (SELECT DISTINCT conv_id AS of, role AS perspective FROM own WHERE role IS NULL OR role <> 'system'),
    said AS (
        SELECT o.*, perspective, role IS NOT DISTINCT FROM perspective AS mine,
               CASE WHEN role IS NOT DISTINCT FROM perspective THEN '{BEGIN}assistant' WHEN role = 'system' THEN '{BEGIN}system' WHEN role IS NULL THEN '{BEGIN}user' ELSE '{BEGIN}user name=' || name END || chr(10) AS head
        FROM own o JOIN speakers ON conv_id IS NOT DISTINCT FROM of
    ), placed AS (
        SELECT *, CAST(coalesce(sum(length(head) + length(text) + {len(END) + 1}) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
        FROM said
    )
    SELECT conv_id, perspective, CAST(0 AS BIGINT) AS part, count(*) AS n_turns, CAST(sum(CAST(mine AS INT)) AS BIGINT) AS n_trained,
           string_agg(head || text || '{END}' || chr(10), '' ORDER BY begins) AS text,
           coalesce(string_agg(CASE WHEN mine THEN (begins + length(head)) || ':' || (begins + length(head) + length(text)) END, ',' ORDER BY begins), '') AS mask
    FROM placed GROUP BY conv_id, perspective
"""
