"""Chat formatting by Spark expressions alone: sorted turn structs, adjacent turns of a role merged, one string with a loss mask.

The template is ``<|im_start|>role\\n text <|sep|> text <|im_end|>\\n``, without blanks around the texts; ``<|sep|>`` stands
between the texts of adjacent turns of one role, so the turns can be told apart again. Inside roles and texts ``&`` is written
``&amp;`` and ``<|`` is written ``&lt;|`` (in roles also a line feed ``&#10;``): no text can look like a mark, and reading back
gives every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|sep|>", "<|im_end|>\n"
#: Lengths are added up in runs of so many, and then over the runs: work and memory stay near linear in the number of parts.
RUN = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _blocks(turns: Column) -> Column:
    """Sorted turns as blocks (role, texts): adjacent turns of one role are one slice of the array."""
    opens = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(opens, F.lit(2), F.size(opens)), F.array(F.size(turns)))
    return F.transform(F.arrays_zip(opens.alias("begin"), ends.alias("end")), lambda x: F.struct(
        F.get(turns, x["begin"])["role"].alias("role"), F.transform(F.slice(turns, x["begin"] + 1, x["end"] - x["begin"]), lambda t: t["text"]).alias("texts")))


def _running(lengths: Column) -> Column:
    """The sum of the entries before each one."""
    def sums(run: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(run, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda k: F.slice(lengths, k * RUN + 1, F.lit(RUN)))
    totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(runs, sums(totals)["out"], lambda run, at: F.transform(sums(run)["out"], lambda x: x + at)))


def _parts(block: Column, loss_role: str) -> Column:
    """A block as (part, learned): its marks, and its texts, which are learned if the role is the one to learn."""
    mark = lambda s: F.struct(s.alias("part"), F.lit(False).alias("learned"))
    texts = F.flatten(F.transform(block["texts"], lambda t, i: F.filter(
        F.array(mark(F.when(i > 0, F.lit(SEP))), F.struct(t.alias("part"), (block["role"] == loss_role).alias("learned"))), lambda p: p["part"].isNotNull())))
    return F.concat(F.array(mark(F.concat(F.lit(START), block["role"], F.lit("\n")))), texts, F.array(mark(F.lit(END))))


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 loss_role: str = "assistant") -> DataFrame:
    """(id, formatted, loss_spans): one row per conversation; the spans are (start, length) in code points of ``formatted``.

    Turns are sorted by number, ties by role and text, a null number first. Null texts and null roles are empty ones; a null id
    is a conversation of its own. A repeated row is a turn each time. An empty table gives an empty result. Other columns are
    ignored. A conversation becomes one string and must fit a row, very long texts included, as any formatted conversation must.
    """
    role = F.replace(escape(F.coalesce(F.col(role_col), F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    rows = turns.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).alias("t"))
    chats = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select("id", _blocks(F.col("turns")).alias("blocks"))
    chats = chats.select("id", F.flatten(F.transform("blocks", lambda b: _parts(b, loss_role))).alias("parts"))
    chats = chats.select("id", "parts", F.transform("parts", lambda p: F.length(p["part"])).alias("lengths"))
    chats = chats.select("id", "parts", F.zip_with("parts", F.zip_with(_running(F.col("lengths")), "lengths", lambda s, n: F.struct(s.alias("start"), n.alias("length"))), lambda p, at: F.when(p["learned"], at)).alias("spans"))
    spans = F.filter("spans", lambda s: s.isNotNull())
    return chats.select("id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: array of (role, text)."""
    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        role = unescape(F.replace(head, F.lit("&#10;"), F.lit("\n")))
        return F.transform(F.split(body, r"<\|sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), turns_of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
