"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as `### role: text</turn>` and a line feed. The grammar of a conversation is

    conversation = { turn };  turn = "### " role [ "*" ] ": " text "</turn>\\n"

where neither role nor text holds a control string (`### ` or `</turn>`); a star marks escaped content. Each turn is first rendered as it is and
parsed again; if the parser doesn't give back the same single turn, its content is escaped: `\\` as `\\\\`, `### ` as `\\h`,
`</turn>` as `\\e`, and in a role also `:` as `\\c` and `*` as `\\s`. Then no control string is left, and undoing it is unique, since a backslash always
begins one of these pairs. The whole conversation is then parsed and compared once more, and the query fails if it isn't the source.

Turns are rendered and checked row by row before they are grouped; a group only puts them in order, since a conversation is one text. So a conversation's text
must fit in one row: at most 2 GB, and some multiples of it in its task's memory.

Defined results: a null role or text is empty; a very long text is a turn like others; rows of one turn number are ordered by role and text, and repeated rows are repeated turns; rows without
conv_id are one conversation; an empty table gives no rows; columns besides conv_id, turn, role and text are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import let, table

HEAD, END = "### ", "</turn>"
LEARNED = "assistant"
_TEXT = ((HEAD, "\\h"), (END, "\\e"))
_ROLE = (*_TEXT, (":", "\\c"), ("*", "\\s"))


def escape(text: Column, pairs) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in pairs:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column, pairs) -> Column:
    """A doubled backslash is a backslash; what lies between them has only codes."""

    def undo(part):
        for plain, code in pairs:
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), undo), "\\")


def render(role: Column, text: Column, escaped: Column) -> Column:
    head = F.when(escaped, F.concat(escape(role, _ROLE), F.lit("*"))).otherwise(role)
    return F.concat(F.lit(HEAD), head, F.lit(": "), F.when(escaped, escape(text, _TEXT)).otherwise(text), F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """The turns (role, text, escaped) of a conversation; null if it doesn't follow the grammar."""
    chunks = F.split(rendered, END + "\n", -1)

    def turn(chunk):
        at = F.instr(chunk, ": ")
        head, body = F.substr(chunk, F.lit(len(HEAD) + 1), at - (len(HEAD) + 1)), F.substr(chunk, at + 2)
        starred = F.endswith(head, F.lit("*"))
        role = F.when(starred, unescape(F.substr(head, F.lit(1), F.char_length(head) - 1), _ROLE)).otherwise(head)
        sound = F.startswith(chunk, F.lit(HEAD)) & (at > 0)
        for control in (HEAD, END):
            sound &= ~F.contains(body, F.lit(control)) & ~F.contains(head, F.lit(control))
        return F.when(sound, F.struct(role.alias("role"), F.when(starred, unescape(body, _TEXT)).otherwise(body).alias("text"), starred.alias("escaped")))

    def all_turns(c):
        turns = F.transform(F.slice(c, 1, F.size(c) - 1), turn)
        return let(turns, lambda t: F.when((F.element_at(c, -1) == "") & ~F.exists(t, lambda x: x.isNull()), t))

    return let(chunks, all_turns)


def plain(turns: Column) -> Column:
    """Only the roles and texts of turns."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start and end in code points of the assistant's texts as they are rendered; number of the turn from 1 and where it begins).

    A conversation that isn't parsed back identically fails the query; escaping leaves none.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    own = F.array(F.struct("role", "text"))
    escaped = ~F.coalesce(plain(parse(render(F.col("role"), F.col("text"), F.lit(False)))) == own, F.lit(False))
    rows = rows.withColumn("escaped", escaped).withColumn("rendered", render(F.col("role"), F.col("text"), F.col("escaped")))
    # where each turn begins, as a running sum over rows
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size, body = F.char_length("rendered"), F.char_length(F.when(F.col("escaped"), escape(F.col("text"), _TEXT)).otherwise(F.col("text")))
    end = F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"number": F.row_number().over(order), "at": end - size, "end": end - (len(END) + 1), "start": end - (len(END) + 1) - body})
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("number", "at", "start", "end", "role", "text", "rendered", "escaped"))).alias("turns"))
    formatted = turns.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["rendered"]), ""))
    learned = F.filter("turns", lambda t: t["role"] == LEARNED)
    spans = F.transform(learned, lambda t: F.struct(*(t[c].alias(c) for c in ("start", "end", "escaped", "number", "at"))))
    same = F.coalesce(plain(parse(F.col("formatted"))) == plain(F.col("turns")), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("no round trip of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    return formatted.select("conv_id", F.when(same, F.col("formatted")).otherwise(failed).alias("formatted"), spans.alias("loss_spans"))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped. A span is cut from its own turn, so that all cuts together are linear in the text."""

    def one(parts):
        def cut(s):
            found = F.substr(F.element_at(parts, s["number"]), (s["start"] - s["at"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
            return F.when(s["escaped"], unescape(found, _TEXT)).otherwise(found)

        return F.array_join(F.transform(spans, cut), "")

    return let(F.split(formatted, END + "\n", -1), one)


CONTROL = "\\### Assistant: </turn> ok"


def with_control(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts look like the template."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    return rows.unionByName(more)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_chats(with_control(table(spark, sf_dir, "conversations")))
    read = found.select("conv_id", parse(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, contains(text, '### ') OR contains(text, '</turn>') AS escaped FROM rows
), rendered AS (
  SELECT *, CASE WHEN escaped THEN '### ' || role || '*: ' || replace(replace(replace(text, '\', '\\'), '### ', '\h'), '</turn>', '\e')
    ELSE '### ' || role || ': ' || text END || '</turn>' || chr(10) AS part FROM marked
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(part))::BIGINT AS formatted_chars
FROM rendered GROUP BY conv_id
"""
