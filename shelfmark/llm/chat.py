"""Chat formatting by a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := START role LF text END LF        START = <|im_start|>, END = <|im_end|>

A turn is rendered as it is and parsed again. Where the parser doesn't give back its role and text, both are
escaped; the escaped form holds no control string, and the parser undoes the escapes. Each whole conversation is
parsed once more, and a job that would write one that doesn't parse to its turns fails instead.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LF = "<|im_start|>", "<|im_end|>", "\n"
_START_PATTERN = r"<\|im_start\|>"


def escape(content: Column) -> Column:
    """Backslashes doubled, line feeds and the bar of `<|` spelled out."""
    doubled = F.replace(content, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit(LF), F.lit("\\n")), F.lit("<|"), F.lit("<\\p"))


def unescape(content: Column) -> Column:
    """Undo `escape`. Content without backslashes stays as it is."""
    def plain(piece):
        return F.replace(F.replace(piece, F.lit("\\n"), F.lit(LF)), F.lit("\\p"), F.lit("|"))
    return F.array_join(F.transform(F.split(content, r"\\\\"), plain), "\\")


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation as (role, text), unescaped; text that is no turn has a null text."""
    def turn(segment):
        role = F.substring_index(segment, LF, 1)
        body = F.substr(segment, F.length(role) + 2)
        text = F.substr(body, F.lit(1), F.length(body) - len(END + LF))
        whole = F.endswith(body, F.lit(END + LF)) & (F.instr(text, END) == 0)
        return F.struct(unescape(role).alias("role"), F.when(whole, unescape(text)).alias("text"))
    segments = F.split(formatted, _START_PATTERN)
    opened = F.get(segments, F.lit(0)) == ""
    turns = F.transform(F.slice(segments, F.lit(2), F.size(segments)), turn)
    return F.when(opened, turns).otherwise(
        F.array(F.struct(F.get(segments, F.lit(0)).alias("role"), F.lit(None).cast("string").alias("text"))))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(LF), text, F.lit(END + LF))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: its id, n_turns, formatted, and loss_spans (start, length) of the texts to learn.

    Turns are ordered by turn number, then role, then text; repeated rows all count. Null roles and texts are empty,
    null turn numbers come first, null ids are one conversation. Spans count code points of `formatted` from 0 and
    cover the escaped texts of `loss_roles`, nothing else. Other columns are left behind. An empty table gives no
    rows. Offsets are running sums in a window, and the window's shuffle serves the grouping.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = F.array(F.struct(F.col("role"), F.col("text")))
    conflicts = ~parse(_rendered(F.col("role"), F.col("text"))).eqNullSafe(source)
    rows = rows.withColumn("conflicts", conflicts) \
        .withColumn("role_out", F.when(F.col("conflicts"), escape(F.col("role"))).otherwise(F.col("role"))) \
        .withColumn("text_out", F.when(F.col("conflicts"), escape(F.col("text"))).otherwise(F.col("text"))) \
        .withColumn("piece", _rendered(F.col("role_out"), F.col("text_out")))
    ordered = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(ordered)) \
        .withColumn("start", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0))) \
        .withColumn("start", F.col("start") + len(START) + F.char_length("role_out") + 1)
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(
        "place", "role", "text", "piece", "start", F.char_length("text_out").cast("long").alias("length"),
    ))).alias("turns"))
    learned = F.filter("turns", lambda t: t["role"].isin(*loss_roles))
    formatted = whole.select(
        F.col("conv").alias(conv), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(learned, lambda t: F.struct(t["start"], t["length"])).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("source"))
    checked = F.when(parse(F.col("formatted")).eqNullSafe(F.col("source")), F.col("formatted")) \
        .otherwise(F.raise_error(F.lit("a formatted conversation does not parse to its turns")))
    return formatted.withColumn("formatted", checked).drop("source")


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
