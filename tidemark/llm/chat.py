"""Chat formatting with a grammar round trip (operator 9, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import whole

# The template, fixed values. A turn is START, the mark of its role, a blank (text as it is) or a backslash (text escaped),
# the text, END.
START, END = "<s>", "</s>"
MARKS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
VERBATIM, ESCAPED = " ", "\\"
#: No text may hold one of these as it is; [ROLE= begins the mark of any other role.
CONTROL = [START, END, *MARKS.values(), "[ROLE="]


def escape(text: Column) -> Column:
    """Backslash, ``<`` and ``[`` become ``\\b``, ``\\l`` and ``\\o``: no control string can start inside the text."""
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\o")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("[", "\\o"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def conflicts(text: Column) -> Column:
    """Whether the text holds a control string."""
    found = F.lit(False)
    for c in CONTROL:
        found = found | F.contains(text, F.lit(c))
    return found


def _mark(role: Column) -> Column:
    """Other roles carry their name, escaped, with ``]`` as ``\\r``."""
    named = F.concat(F.lit("[ROLE="), F.replace(escape(role), F.lit("]"), F.lit("\\r")), F.lit("]"))
    out = named
    for name, mark in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _role(mark: Column) -> Column:
    out = unescape(F.replace(F.regexp_extract(mark, "^\\[ROLE=([^\\]]*)\\]$", 1), F.lit("\\r"), F.lit("]")))
    for name, text in MARKS.items():
        out = F.when(mark == text, F.lit(name)).otherwise(out)
    return out


def render(turns: Column, escaped) -> Column:
    """turns: array of (role, text). escaped(turn) says whether that turn's text is escaped."""
    def one(t: Column) -> Column:
        flag = escaped(t)
        body = F.when(flag, F.concat(F.lit(ESCAPED), escape(t["text"]))).otherwise(F.concat(F.lit(VERBATIM), t["text"]))
        return F.concat(F.lit(START), _mark(t["role"]), body, F.lit(END))
    return F.array_join(F.transform(turns, one), "")


#: START, a mark in brackets, the kind of the text, the text. The first END closes the turn, whatever stands in it.
TURN = "^<s>(\\[[^\\]]*\\])([ \\\\])((?s:.*))$"


def parse(rendered: Column) -> Column:
    """array of (role, text, shown): shown is the text as it stands in the output.

    What is not of the grammar, such as a text that holds a control string, has a null role.
    """
    # The text after the last END is empty in every sentence of the grammar; it is kept as a faulty turn otherwise.
    pieces = F.split(rendered, END, -1)
    pieces = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)

    def one(p: Column) -> Column:
        kind, shown = F.regexp_extract(p, TURN, 2), F.regexp_extract(p, TURN, 3)
        return F.struct(F.when((kind != "") & ~conflicts(shown), _role(F.regexp_extract(p, TURN, 1))).alias("role"),
                        F.when(kind == ESCAPED, unescape(shown)).otherwise(shown).alias("text"), shown.alias("shown"))
    return F.transform(pieces, one)


def _recovered(rendered: Column, turns: Column) -> Column:
    return F.transform(parse(rendered), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == turns


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, turns): the rendered conversation and what the parser reads back from it.

    Turns are ordered by number, then role and text, so ties and repeated rows have one order; a null turn comes first,
    a null role or text is empty. Every text is first rendered as it is and parsed again. If the turns differ from the
    source, texts that hold a control string are escaped; if they still differ, all texts are. The last form always reads
    back, since no control string can stand in an escaped text. Texts of any length are rendered whole; further columns are
    not looked at. A conversation is one record of the output, so its rows meet in one task.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), whole(F.col(role)).alias("role"),
                                                   whole(F.col(text)).alias("text"))))
    source = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = rows.groupBy(F.col(conv)).agg(source.alias("_source"))
    source = F.col("_source")
    out = out.withColumn("_plain", render(source, lambda t: F.lit(False)))
    out = out.withColumn("_some", F.when(_recovered(F.col("_plain"), source), F.col("_plain"))
                         .otherwise(render(source, lambda t: conflicts(t["text"]))))
    out = out.withColumn("formatted", F.when(_recovered(F.col("_some"), source), F.col("_some"))
                         .otherwise(render(source, lambda t: F.lit(True))))
    return out.select(conv, "formatted").withColumn("turns", parse(F.col("formatted")))


def loss_spans(turns: Column, learned: str = "assistant") -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == learned), lambda t: t["text"])
