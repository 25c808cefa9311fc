"""Chat formatting (method: a visitor over typed content parts).

A message is a list of parts: text, image, audio or document. The visitor goes over the parts in order and flattens each
into a piece of text: a text part gives its text, escaped; any other part gives a placeholder with its kind and number
in the message, an attachment record (turn, kind, reference, tokens) and the number of tokens that it expands to.
A conversation's turns, in order, become marked segments; the segments of assistant turns' content are under the loss.

All marks begin with `<|`. In contents and roles a backslash is doubled and one is put inside each control string (the
template's own and those of common templates), so that none of them occurs there and reading back is exact.

Only DataFrame functions run. Rows of a conversation are ordered by turn (null first), then role, then parts as they came
in (for plain texts: the raw text), so ties change nothing but the order of equals; null texts and roles are empty; very
long texts are formatted whole; a null conv_id is a conversation of its own; repeated rows are turns each; an empty table
gives no rows; extra columns are ignored, also those named like a result. Turns are put together in groups of 256 before a conversation's are, so that
no sort holds more rows than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, CONTENT, END = "<|role|>", "<|content|>", "<|end|>"
#: Control strings and what they become; a backslash comes first, as itself doubled.
ESCAPES = [("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"), ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>")]
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens: one for each patch of an image, each part of a second of audio, and so many for a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512
#: For a part that doesn't state its size.
DEFAULT_SIDE, DEFAULT_SECONDS, DEFAULT_PAGES = 448, 30.0, 1
GROUP = 256


def escaped(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens_of(part: Column) -> Column:
    """Tokens that a part expands to, besides those of texts."""
    side = lambda x: F.ceil(F.coalesce(x, F.lit(DEFAULT_SIDE)) / PATCH)
    return (
        F.when(part.kind == "image", side(part.width) * side(part.height))
        .when(part.kind == "audio", F.ceil(F.coalesce(part.seconds, F.lit(DEFAULT_SECONDS)) * PER_SECOND))
        .when(part.kind == "document", F.coalesce(part.pages, F.lit(DEFAULT_PAGES)) * PER_PAGE)
        .otherwise(0)
        .cast("bigint")
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part.kind, F.lit("text")) == "text"


def flattened(parts: Column) -> Column:
    """The visitor: the pieces of all parts, joined."""
    visit = lambda p, i: F.when(is_text(p), escaped(F.coalesce(p.text, F.lit("")))).otherwise(F.concat(F.lit("<|"), escaped(p.kind), F.lit(" "), i.cast("string"), F.lit("|>")))
    return F.coalesce(F.array_join(F.transform(parts, visit), ""), F.lit(""))


def attachments(turn: Column, parts: Column) -> Column:
    """(turn, place, kind, ref, tokens) of the parts that aren't text, in order."""
    record = lambda p, i: F.struct(turn.alias("turn"), i.alias("place"), p.kind.alias("kind"), p.ref.alias("ref"), tokens_of(p).alias("tokens"), is_text(p).alias("is_text"))
    found = F.filter(F.transform(parts, record), lambda a: ~a.is_text)
    return F.transform(found, lambda a: F.struct(a.turn.alias("turn"), a.place.alias("place"), a.kind.alias("kind"), a.ref.alias("ref"), a.tokens.alias("tokens")))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def format_chats(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """id, formatted, segments (text, loss: in order, joined they are formatted), attachments and expanded_tokens of each conversation."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turns = messages.select(F.col(id_col).alias("id"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), F.col(parts_col).alias("parts"))
    groups = turns.groupBy("id", F.floor(F.col("turn") / GROUP).alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    whole = groups.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "turns"))).alias("groups"))
    none = F.array().cast("array<struct<turn:bigint,place:int,kind:string,ref:string,tokens:bigint>>")
    flat = lambda t: F.struct(t.role.alias("role"), flattened(t.parts).alias("content"), F.coalesce(attachments(t.turn, t.parts), none).alias("found"))
    whole = whole.select("id", F.transform(F.flatten(F.transform("groups", lambda p: p.turns)), flat).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    marked = lambda t: F.array(segment(F.concat(F.lit(ROLE), escaped(t.role), F.lit(CONTENT)), F.lit(False)), segment(t.content, t.role == loss_role), segment(F.lit(END), F.lit(False)))
    whole = whole.select("id", F.flatten(F.transform("turns", marked)).alias("segments"), F.flatten(F.transform("turns", lambda t: t.found)).alias("attachments"))
    return whole.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        "segments",
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x.tokens).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn, from a formatted conversation whose parts are texts."""
    pieces = F.split(formatted, "<\\|end\\|>")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    begin = len(ROLE) + 1
    role = lambda p: F.substring_index(p, CONTENT, 1)
    return F.transform(pieces, lambda p: F.struct(unescaped(F.substring(role(p), begin, 1 << 30)).alias("role"), unescaped(F.substring(p, F.length(role(p)) + F.lit(len(CONTENT) + 1), F.lit(1 << 30))).alias("text")))


def read_loss(segments: Column) -> Column:
    """All text under the loss, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescaped(s.text)), "")
