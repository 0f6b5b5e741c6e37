"""Chat formatting by perspective rotation: each participant in turn is the assistant, the others are named users.

A turn becomes a segment for each perspective, with its place in the rendered dialogue; segments are then put
together. A dialogue of more than ``CHUNK`` code points comes in several rows, so that no task ever holds a
whole conversation. Marks within names and texts are escaped and can't be taken for turns. Everything is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns whose places are summed together; sums of blocks are then summed in turn.
BLOCK = 64
SYSTEM = "system"
#: Code points of a dialogue from which a further row begins, with the next segment.
CHUNK = 65_536


def escaped(text: Column) -> Column:
    """A mark's opening within a text gets a backslash, one more if it has some already; taking one off each restores the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    """A name's openings and closings of marks get a backslash each."""
    return F.regexp_replace(escaped(name), r"\|(\\*)>", r"|\\$1>")


def header(role: Column, name: Column) -> Column:
    """What precedes a turn's text; only users carry a name."""
    return F.concat(F.lit("<|"), role, F.when(role == "user", F.concat(F.lit(" name="), escaped_name(name))).otherwise(F.lit("")), F.lit("|>\n"))


FOOTER = "<|end|>\n"


def rotate(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per turn and perspective of ``conversations(conv_id, turn, role, text)``.

    Columns: ``conv_id, speaker`` (the perspective), ``turn, seq`` (rank of equal turns), ``chat_role``
    (``assistant`` for the speaker's turns, ``system`` for system turns, else ``user``), ``name`` (a user's
    role in the conversation, else null), ``segment``, ``start, end`` (code points in the perspective's
    dialogue, end exclusive), ``mask_start, mask_end`` (the trained part: the assistant's text with its
    footer; null for other turns).

    A participant is every distinct role but ``system``; a conversation of system turns alone has no rows.
    A null role counts as ``unknown``, a null text as empty; null turns come first and null conversation ids
    are one conversation. Rows of one turn are ordered by role and text; repeated rows are turns of their
    own. An empty table gives no rows; other columns are not read.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text")
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)))
    # A key without nulls: windows and joins then keep one partitioning.
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.lit("n")))
    in_turn = Window.partitionBy("key", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same_turn = Window.partitionBy("key", "part", "turn").orderBy("role", "text")
    turns = rows.withColumns({"at": F.row_number().over(in_turn), "seq": F.row_number().over(same_turn)})

    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("key").alias("c"), F.col("role").alias("speaker")).distinct()
    lengths = F.length("text") + len(FOOTER)
    own = lengths + F.length(header(F.lit("assistant"), F.col("role")))
    other = lengths + F.length(header(F.when(F.col("role") == SYSTEM, SYSTEM).otherwise("user"), F.col("role")))
    # Lengths before each block: of all turns as others render them, corrected for the speaker's own.
    sums = rows.groupBy("key", "part", "role").agg(F.sum(other).alias("n"), F.sum(own - other).alias("d"))
    by_part = sums.groupBy("key", "part").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("role", "d"))).alias("d"))
    parts = by_part.join(speakers, F.col("key") == F.col("c"))
    before = Window.partitionBy("c", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("n") + F.coalesce(F.try_element_at("d", "speaker"), F.lit(0))
    parts = parts.select("c", "speaker", F.col("part").alias("p"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("base"))

    out = turns.join(parts, (F.col("key") == F.col("c")) & (F.col("part") == F.col("p")))
    chat_role = F.when(F.col("role") == SYSTEM, SYSTEM).when(F.col("role") == F.col("speaker"), "assistant").otherwise("user")
    out = out.withColumn("chat_role", chat_role).withColumn("head", header(F.col("chat_role"), F.col("role")))
    out = out.withColumn("segment", F.concat("head", "text", F.lit(FOOTER)))
    upto = Window.partitionBy("key", "part", "speaker").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("end", F.col("base") + F.sum(F.length("segment")).over(upto)).withColumn("start", F.col("end") - F.length("segment"))
    trained = F.col("chat_role") == "assistant"
    return out.select(
        "conv_id", "speaker", "turn", F.col("seq").cast("int").alias("seq"), "chat_role", F.when(F.col("chat_role") == "user", F.col("role")).alias("name"), "segment",
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        F.when(trained, F.col("start") + F.length("head")).cast("long").alias("mask_start"), F.when(trained, F.col("end")).cast("long").alias("mask_end"),
    )


def dialogues(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rendered dialogues: ``conv_id, speaker, part, start, text, masks`` for every perspective of ``rotate``.

    A dialogue of at most ``chunk`` code points is one row, part 0; a segment that starts in the n-th stretch of
    ``chunk`` code points belongs to part n, so a row holds at most that many code points and one more
    segment, and parts in order give the whole. ``start`` is the row's first code point in the dialogue, ``masks``
    the trained stretches as ``start:end`` in the dialogue, comma-joined. Rows are as defined as those of ``rotate``.
    """
    part = F.floor(F.col("start") / chunk).cast("long").alias("part")
    rows = rotate(conversations).select("conv_id", "speaker", part, F.struct("start", "segment", "mask_start", "mask_end").alias("s"))
    rows = rows.groupBy("conv_id", "speaker", "part").agg(F.sort_array(F.collect_list("s")).alias("s"))
    masks = F.transform(F.filter("s", lambda x: x["mask_start"].isNotNull()), lambda x: F.concat(x["mask_start"].cast("string"), F.lit(":"), x["mask_end"].cast("string")))
    return rows.select("conv_id", "speaker", "part", F.element_at("s", 1)["start"].alias("start"), F.array_join("s.segment", "").alias("text"), F.array_join(masks, ",").alias("masks"))


_ESCAPED = r"regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g')"
_ESCAPED_ROLE = r"regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g')"

#: The same rows by plain window functions, for a conversation of any length.
ROTATE_SQL = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, {_ESCAPED} AS text FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                 row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS seq FROM t),
    s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> '{SYSTEM}'),
    r AS (SELECT *, CASE WHEN role = '{SYSTEM}' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user' END AS chat_role
          FROM o JOIN s ON o.conv_id IS NOT DISTINCT FROM s.c),
    h AS (SELECT *, '<|' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || {_ESCAPED_ROLE} ELSE '' END || '|>' || chr(10) AS head FROM r),
    g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
    e AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY pos) AS BIGINT) AS e FROM g)
    SELECT conv_id, speaker, turn, CAST(seq AS INTEGER) AS seq, chat_role, CASE WHEN chat_role = 'user' THEN role END AS name, segment,
           e - length(segment) AS start, e AS "end",
           CASE WHEN chat_role = 'assistant' THEN e - length(segment) + length(head) END AS mask_start,
           CASE WHEN chat_role = 'assistant' THEN e END AS mask_end
    FROM e"""

#: The dialogues, put together from these rows.
DIALOGUES_SQL = f"""
    WITH segments AS ({ROTATE_SQL})
    SELECT conv_id, speaker, start // {CHUNK} AS part, min(start) AS start, string_agg(segment, '' ORDER BY start) AS text,
           coalesce(string_agg(mask_start || ':' || mask_end, ',' ORDER BY start), '') AS masks
    FROM segments GROUP BY conv_id, speaker, start // {CHUNK}"""
