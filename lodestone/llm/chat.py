"""Chat formatting with multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users; system turns are context
in every rendering and have none of their own. The result has one row per turn
of a rendering: its text, its place in the whole rendering, and the part that
counts for the loss. So a conversation of any length is spread over many tasks;
places come from prefix sums on three levels (4,096 turns, 64 turns, one turn)
and no window or join ever gathers a whole conversation's turns: all sums run over
narrow rows (a turn's hash and length), the participants are sent to the turns
while there are at most BROADCAST_PEOPLE of them (beyond, they are joined by a
shuffle, whose hot conversations adaptive execution splits), and texts are joined
at the end by conversation, turn, speaker and hash.

Defined results: a null role speaks as ``unknown``, a null text as empty; a null
turn comes first; turns with equal number are ordered by hash, then role, then
text (texts of a turn and speaker are told apart by their md5); equal rows are rendered once each, in a row; a conversation of system
turns alone has no rendering; rows without a conversation id form one
conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
SYSTEM_ROLES = ("system",)
LEVELS = (4096, 64)
#: (conversation, participant) rows, some 60 bytes each, that are broadcast at most.
BROADCAST_PEOPLE = 100_000
#: Stands for a null turn, which sorts first; the least number there is.
NO_TURN = -(1 << 63)


def _before(df: DataFrame, within: list[str], by: list[str], base: DataFrame | None, on: list[str]) -> DataFrame:
    """Exclusive prefix sums of (_n, _chars) in the order ``by`` inside ``within``, on top of ``base``'s."""
    w = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_n0", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_c0", F.coalesce(F.sum("_chars").over(w), F.lit(0)))
    if base is not None:
        up = base.select(*on, F.col("_n0").alias("_n1"), F.col("_c0").alias("_c1"))
        out = out.join(up, on).withColumn("_n0", F.col("_n0") + F.col("_n1")).withColumn("_c0", F.col("_c0") + F.col("_c1")).drop("_n1", "_c1")
    return out


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: tuple[str, ...] = SYSTEM_ROLES) -> DataFrame:
    """(conv, perspective, position, turn, speaker, rendered_as, segment, start, end, loss, loss_start, loss_end).

    Offsets are code points in the rendering, ends exclusive; ``loss_start`` and
    ``loss_end`` span the assistant's text and closing mark, null elsewhere.
    """
    rows = turns.select(
        F.when(F.col(conv).isNull(), F.lit("?")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string"))).alias("_conv"),
        F.coalesce(F.col(turn).cast("long"), F.lit(NO_TURN)).alias("_turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).withColumn("_hash", F.md5(F.concat_ws("\u001f", "speaker", "_text")))
    one = ["_conv", "_turn", "speaker", "_hash"]
    texts = rows.groupBy(*one).agg(F.max("_text").alias("_text"))
    same = rows.select(*one, F.length("_text").alias("_length")).groupBy(*one).agg(F.count(F.lit(1)).alias("_copies"), F.max("_length").alias("_length"))
    people = rows.where(~F.col("speaker").isin(*system)).select("_conv", F.col("speaker").alias("perspective")).distinct()
    if people.limit(BROADCAST_PEOPLE + 1).count() <= BROADCAST_PEOPLE:
        people = F.broadcast(people)
    spoken_as = F.when(F.col("speaker").isin(*system), F.lit("system")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(F.col("rendered_as") == "user", F.concat(F.lit(" "), F.col("speaker"))).otherwise(F.lit(""))
    head = F.concat(F.lit(OPEN), F.col("rendered_as"), name, F.lit(MIDDLE))
    each = same.join(people, "_conv").withColumn("rendered_as", spoken_as).withColumn("_len", F.length(head) + F.col("_length") + F.lit(len(CLOSE))).withColumn("_part", F.substring("_hash", 1, 2))
    for k, size in enumerate(LEVELS):
        each = each.withColumn(f"_l{k}", F.floor(F.col("_turn") / size))
    who = ["_conv", "perspective"]
    sums = [F.sum("_n").alias("_n"), F.sum("_chars").alias("_chars")]
    fine = each.groupBy(*who, "_l0", "_l1", "_turn", "_part").agg(F.sum("_copies").alias("_n"), F.sum(F.col("_copies") * F.col("_len")).alias("_chars"))
    middle = fine.groupBy(*who, "_l0", "_l1").agg(*sums)
    coarse = _before(middle.groupBy(*who, "_l0").agg(*sums), who, ["_l0"], None, [])
    middle = _before(middle, [*who, "_l0"], ["_l1"], coarse, [*who, "_l0"])
    fine = _before(fine, [*who, "_l0", "_l1"], ["_turn", "_part"], middle, [*who, "_l0", "_l1"])
    group = [*who, "_turn", "_part"]
    w = Window.partitionBy(*group).orderBy("_hash", "speaker").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        each.withColumn("_n2", F.coalesce(F.sum("_copies").over(w), F.lit(0)))
        .withColumn("_c2", F.coalesce(F.sum(F.col("_copies") * F.col("_len")).over(w), F.lit(0)))
        .join(fine.select(*group, "_n0", "_c0"), group)
        .join(texts, one)
        .withColumn("_head", head)
    )
    copy = F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int")))
    loss: Column = F.col("rendered_as") == "assistant"
    out = placed.select("*", copy.alias("_k")).withColumn("start", (F.col("_c0") + F.col("_c2") + F.col("_k") * F.col("_len")).cast("long"))
    return out.select(
        F.when(F.col("_conv") != "?", F.expr("substring(_conv, 2)").cast(turns.schema[conv].dataType)).alias(conv),
        "perspective",
        (F.col("_n0") + F.col("_n2") + F.col("_k") + 1).cast("long").alias("position"),
        F.when(F.col("_turn") != NO_TURN, F.col("_turn")).alias("turn"),
        "speaker",
        "rendered_as",
        F.concat("_head", "_text", F.lit(CLOSE)).alias("segment"),
        "start",
        (F.col("start") + F.col("_len")).cast("long").alias("end"),
        loss.alias("loss"),
        F.when(loss, F.col("start") + F.length("_head")).cast("long").alias("loss_start"),
        F.when(loss, F.col("start") + F.col("_len")).cast("long").alias("loss_end"),
    )


ORACLE = f"""
WITH rows AS (
  SELECT coalesce(conv_id, -1) AS conv, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS txt FROM conversations
), people AS (
  SELECT DISTINCT conv, speaker AS perspective FROM rows WHERE speaker NOT IN ('system')
), each_row AS (
  SELECT r.*, p.perspective,
    CASE WHEN r.speaker IN ('system') THEN 'system' WHEN r.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS rendered_as,
    md5(r.speaker || chr(31) || r.txt) AS h
  FROM rows r JOIN people p ON r.conv = p.conv
), headed AS (
  SELECT *, '{OPEN}' || rendered_as || CASE WHEN rendered_as = 'user' THEN ' ' || speaker ELSE '' END || '{OPEN[::-1].replace("<", ">")}' || chr(10) AS head FROM each_row
), sized AS (
  SELECT *, length(head) + length(txt) + {len(CLOSE)} AS len,
    row_number() OVER w AS position
  FROM headed WINDOW w AS (PARTITION BY conv, perspective ORDER BY turn, h, speaker, txt)
), placed AS (
  SELECT *, coalesce(sum(len) OVER (PARTITION BY conv, perspective ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sized
)
SELECT nullif(conv, -1) AS conv_id, perspective, position, nullif(turn, -1) AS turn, speaker, rendered_as,
  head || txt || '<|end|>' || chr(10) AS segment, CAST(s AS BIGINT) AS start, CAST(s + len AS BIGINT) AS "end",
  rendered_as = 'assistant' AS loss,
  CASE WHEN rendered_as = 'assistant' THEN CAST(s + length(head) AS BIGINT) END AS loss_start,
  CASE WHEN rendered_as = 'assistant' THEN CAST(s + len AS BIGINT) END AS loss_end
FROM placed
"""
