"""Chat templates: ordered turns of a conversation to one prompt, by four separator styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: name: (style, system, roles, first separator, second separator). Fixed values.
TEMPLATES = {
    "deepseek": ("DeepSeek", "", ("<|User|>", "<|Assistant|>"), "\n\n", "<｜end▁of▁sentence｜>"),
    "deepseekv2": ("DeepSeek", "", ("<｜User｜>", "<｜Assistant｜>"), "", "<｜end▁of▁sentence｜>"),
    "plain": ("PLAIN", "", ("", ""), "", ""),
    "alignment": ("ALIGNMENT", "", ("", ""), "", ""),
}


class Templates:
    """A registry of templates; a name is taken once unless it is to be replaced."""

    def __init__(self):
        self.known = dict(TEMPLATES)

    def register(self, name: str, style: str, system: str, roles: tuple[str, str], sep: str, sep2: str, override: bool = False) -> None:
        if name in self.known and not override:
            raise ValueError(f"{name} has been registered.")
        self.known[name] = (style, system, roles, sep, sep2)

    def get(self, name: str) -> tuple:
        return self.known[name]


def turns(conversations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, messages: (role, text) of each conversation in order."""
    rows = conversations.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "role", "text"))).alias("m"))
    return rows.select(*keys, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))


def render(messages: Column, template: tuple, system: Column | None = None) -> Column:
    """The prompt of messages (role, text); a null or empty text leaves the turn open."""
    style, default, _, sep, sep2 = template
    head = F.coalesce(system, F.lit("")) if system is not None else F.lit(default)
    ends = lambda k: F.when(k % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2))
    said = lambda m: T.strip(F.coalesce(m["text"], F.lit("")))

    def one(m: Column, k: Column) -> Column:
        if style == "DeepSeek":
            return F.when(said(m) != "", F.concat(m["role"], F.lit(": "), said(m), ends(k))).otherwise(F.concat(m["role"], F.lit(":")))
        if style == "DeepSeekV2":
            user = F.concat(F.lit("<｜sft▁begin｜>\n"), said(m), F.lit(sep))
            return F.when(said(m) == "", F.lit("")).when(m["role"] == "User", user).otherwise(F.concat(said(m), F.lit(sep2)))
        if style == "PLAIN":
            return F.when(said(m) != "", F.concat(said(m), ends(k))).otherwise(F.lit(""))
        if style == "ALIGNMENT":
            return F.when(said(m) == "", F.lit("")).when(k % 2 == 0, F.lit("<image>\n" + sep)).otherwise(F.concat(said(m), F.lit(sep2)))
        raise ValueError(f"Invalid style: {style}")

    lead = F.when(head != "", F.concat(head, F.lit(sep))).otherwise(F.lit("")) if style in ("DeepSeek", "DeepSeekV2") else F.lit("")
    return T.strip(F.concat(lead, F.array_join(F.transform(messages, one), "")))


def api_messages(messages: Column, system: Column, offset: int = 0) -> Column:
    """A system row and alternating user and assistant rows; an assistant without a text is left out."""
    own = F.slice(messages, offset + 1, F.greatest(F.lit(0), F.size(messages) - offset))
    named = F.transform(own, lambda m, k: F.struct(F.when(k % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), m["text"].alias("content")))
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), F.filter(named, lambda m: (m["role"] == "user") | m["content"].isNotNull()))


def chatbot_pairs(messages: Column, offset: int = 0) -> Column:
    """(user, assistant) of neighbouring turns; the last assistant may be open."""
    own = F.slice(messages, offset + 1, F.greatest(F.lit(0), F.size(messages) - offset))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(own) - 1)), lambda k: (k % 2 == 0) & (k < F.size(own)))
    return F.transform(places, lambda k: F.struct(F.get(own, k)["text"].alias("user"), F.get(own, k + 1)["text"].alias("assistant")))


def with_marks(ids: Column, begin: bool = True, end: bool = False) -> Column:
    """Token ids with the begin (0) and end (1) ids around them."""
    return F.concat(*([F.array(F.lit(0))] if begin else []), ids, *([F.array(F.lit(1))] if end else []))
