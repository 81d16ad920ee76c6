"""Chat formatting by Spark expressions alone.

The turns of a conversation are collected as structs and sorted, neighbours of one role
share a header, and all is concatenated by array expressions, with the spans
of the text that a model is to learn.  :func:`parse` reads the formatted text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import bound

#: The template's marks.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: What no text may hold as it is: all strings of the form of the marks, and control strings of other templates.
#: Group 2 starts with the backslashes that escaping has put in.
CONTROL = r"([<\[])(\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]))"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
#: Turns whose lengths are summed one by one; longer conversations are summed in blocks of as many.
BLOCK = 256


def escape(text: Column) -> Column:
    """One more backslash after the first character of each control string, so that none is left as it is."""
    return F.when(text.rlike(r"[<\[]"), F.regexp_replace(text, CONTROL, r"$1\\$2")).otherwise(text)


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: one backslash less in each."""
    return F.when(text.rlike(r"[<\[]\\"), F.regexp_replace(text, CONTROL.replace(r"(\\*", r"\\(\\*"), "$1$2")).otherwise(text)


def _sums_before(n: Column) -> Column:
    """For each element the sum of those before it, in blocks, so that the work grows with ``BLOCK`` and not with the array."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    places = lambda a: F.sequence(F.lit(1), F.size(a))
    before = lambda a: F.when(F.size(a) > 0, F.transform(places(a), lambda i: total(F.slice(a, F.lit(1), i - 1)))).otherwise(F.array().cast("array<long>"))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        return bound(before(F.transform(parts, total)), lambda base: F.flatten(F.transform(parts, lambda part, i: F.transform(before(part), lambda s: s + F.get(base, i)))))

    return bound(n, lambda a: F.when(F.size(a) <= BLOCK, before(a)).otherwise(bound(blocks(a), joined)))


def _pieces(turns: Column) -> Column:
    """What each turn adds to the formatted text: before its text, the text, and after it."""

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get(turns, i - 1)["role"] != t["role"])
        last = (i == F.size(turns) - 1) | (F.get(turns, i + 1)["role"] != t["role"])
        head = F.when(first, F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT))
        return F.struct(head.alias("head"), t["text"].alias("text"), F.when(last, F.lit(END)).otherwise(F.lit("")).alias("tail"), (t["role"] == LEARNED).alias("learned"))

    return F.transform(turns, piece)


def _formatted(pieces: Column) -> Column:
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    sizes = F.transform(pieces, lambda p: (F.char_length(p["head"]) + F.char_length(p["text"]) + F.char_length(p["tail"])).cast("long"))

    def span(p: Column, start: Column) -> Column:
        begin = start + F.char_length(p["head"])
        return F.struct(p["learned"].alias("learned"), begin.alias("start"), (begin + F.char_length(p["text"])).alias("stop"))

    spans = F.filter(F.zip_with(pieces, _sums_before(sizes), span), lambda s: s["learned"])
    return F.struct(text.alias("formatted"), F.transform(spans, lambda s: F.struct(s["start"], s["stop"])).alias("loss_spans"))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``id_col, formatted, loss_spans``.

    Turns come in the order of ``turn_col`` (null first; equal ones by role, then text).  Neighbours of
    one role share a header and keep their borders.  A null role or text is empty; all texts are
    escaped ahead of the shuffle, whole.  ``loss_spans`` has the start and end (code points, end exclusive) of each
    text of ``assistant``, in order.  Rows that repeat a turn are turns of their own; a null id is an id like any other.  An
    empty table gives no rows; other columns are not used.  A formatted conversation is one row, so it
    must fit in one; its turns meet in one task, in an array.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), blank(role_col).alias("role"), escape(blank(text_col)).alias("text")).alias("t"))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    done = whole.select("id", bound(bound(F.col("turns"), _pieces), _formatted).alias("f"))
    return done.select(F.col("id").alias(id_col), "f.formatted", "f.loss_spans")


def parse(formatted: Column) -> Column:
    """Array of turns (role, text) that a formatted conversation was made of."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    marks = r"<\|turn\|>|<\|text\|>|<\|next\|>"

    def turns(parts: Column) -> Column:
        return F.transform(F.slice(parts, F.lit(3), F.size(parts)), lambda t: F.struct(unescape(F.get(parts, 1)).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, lambda b: bound(F.split(b, marks), turns)))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    Each code point takes four bytes in the encoding that is cut, so a span is found at once wherever it lies.
    """
    order_mark = F.unhex(F.lit("0000FEFF"))  # a text's own would be taken for one

    def cut(codes: Column) -> Column:
        one = lambda s: F.substring(codes, (s["start"] * 4 + 1).cast("int"), ((s["stop"] - s["start"]) * 4).cast("int"))
        return F.array_join(F.transform(spans, lambda s: unescape(F.decode(F.concat(order_mark, one(s)), "UTF-32"))), "")

    return bound(F.encode(formatted, "UTF-32"), cut)


def digest_columns(done: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted text and its mask hold, read back from them: counts and digests of turns and of learned text."""
    lines = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = lambda turns: F.struct(F.size(turns).cast("long").alias("n"), F.sha2(lines(turns), 256).alias("sha"))
    learned = lambda text: F.struct(F.char_length(text).cast("long").alias("n"), F.sha2(text, 256).alias("sha"))
    rows = done.select(id_col, bound(parse(F.col("formatted")), read).alias("t"), bound(learned_text(F.col("formatted"), F.col("loss_spans")), learned).alias("l"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return rows.select(id_col, F.col("t.n").alias("n_turns"), F.col("t.sha").alias("turns_sha256"), F.col("l.n").alias("loss_chars"), F.col("l.sha").alias("loss_sha256"), "formatted_chars")


_ESCAPED = r"regexp_replace({}, '([<\[])(\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]))', '\1\\\2', 'g')"

ORACLE_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i], '</s>[INST] ok [/INST]' FROM range(1, 3) r(i)
), marked AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS first FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  sum(length({_ESCAPED.format("text")}) + CASE WHEN first THEN {len(TURN + TEXT + END)} + length({_ESCAPED.format("role")}) ELSE {len(NEXT)} END)::bigint AS formatted_chars
FROM marked GROUP BY conv_id
"""
