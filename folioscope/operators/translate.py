"""Translation: selection, batches, prompts, a pluggable client, repair of cut answers, and the join back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BATCH = 30
TRANSLATABLE = ("text", "title", "table")
#: Names of target languages. Fixed values.
LANGUAGES = {
    "zh-CN": "简体中文", "zh-TW": "繁體中文", "en": "English", "ja": "日本語", "ko": "한국어", "fr": "Français", "de": "Deutsch",
    "es": "Español", "pt": "Português", "ru": "Русский", "ar": "العربية", "th": "ไทย", "vi": "Tiếng Việt", "id": "Bahasa Indonesia",
}
#: The wording of requests, with the target, the source and the number of items to be filled in. Fixed values.
SYSTEM_TARGET = "You are a professional translator. Translate to {}. Source language: {}. "
SYSTEM_FORM = 'Output ONLY valid JSON: {"translations": [{"index": 0, "translated": "..."}]}. You MUST translate ALL '
SYSTEM_RULES = " items. Do not skip any. IMPORTANT: In the translated field, output ONLY the translated text. Do NOT include any labels, tags, prefixes like [title] or [text]."
ANSWER = "array<struct<index:int,translated:string>>"
#: One complete object of an answer. Fixed value.
COMPLETE = r'\{\s*"index"\s*:\s*(\d+)\s*,\s*"translated"\s*:\s*"((?:[^"\\]|\\.)*)"\s*\}'


def batches(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Translatable rows of items (type, text) with batch_no: runs of 30 of their keys in order."""
    own = items.where(F.col("type").isin(*TRANSLATABLE))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return own.withColumn("batch_no", F.floor(place / BATCH).cast("long"))


def label(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), code)


def prompts(batched: DataFrame, keys: list[str], source: str = "auto", target: str = "zh-CN") -> DataFrame:
    """keys, batch_no, system, user, items of each batch."""
    rows = batched.groupBy(*keys, "batch_no").agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("items"))
    n = F.size("items").cast("string")
    source_label = "auto-detect" if source == "auto" else LANGUAGES.get(source, source)
    system = F.concat(F.lit(SYSTEM_TARGET.format(LANGUAGES.get(target, target), source_label) + SYSTEM_FORM), n, F.lit(SYSTEM_RULES))
    user = F.concat(F.lit("Text blocks ("), n, F.lit(" items):\n"), F.array_join(F.transform("items", lambda i: F.concat(i["index"].cast("string"), F.lit(": "), i["text"])), "\n"))
    return rows.select(*keys, "batch_no", system.alias("system"), user.alias("user"), "items")


def ask(asked: DataFrame, keys: list[str], client) -> DataFrame:
    """Adds answer and error: client.complete(system, user) for each batch, one client for each worker."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema) + ", answer string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client() if isinstance(client, type) else client
        for frame in frames:
            answers, errors = [], []
            for system, user in zip(frame["system"], frame["user"], strict=True):
                try:
                    answers.append(own.complete(system, user))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a client is data
                    answers.append(None)
                    errors.append(f"Translation API failed: {e}")
            yield frame.assign(answer=answers, error=errors)

    return asked.mapInPandas(run, schema)


def parse_answer(answer: Column) -> Column:
    """(index, translated) of an answer: its JSON, or every complete object of JSON that was cut; null where nothing is left."""
    body = T.fenced(T.strip(answer))
    whole = F.from_json(body, f"translations {ANSWER}", {"mode": "PERMISSIVE"})["translations"]
    mended = repair(body)
    closed = body.rlike(r"(?s)\A\s*\{.*\}\s*\z") & whole.isNotNull()
    return F.when(closed, F.filter(whole, lambda t: t["index"].isNotNull() & t["translated"].isNotNull())).when(F.size(mended) > 0, mended)


def repair(text: Column) -> Column:
    """Only the complete objects of cut JSON."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(COMPLETE), F.lit(1)), F.regexp_extract_all(text, F.lit(COMPLETE), F.lit(2)))
    return F.transform(pairs, lambda p: F.struct(p["0"].cast("int").alias("index"), F.replace(F.replace(p["1"], F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")).alias("translated")))


def apply(items: DataFrame, translations: DataFrame, keys: list[str]) -> DataFrame:
    """items (index, text) with original and translated; what no translation has stays as it is."""
    named = translations.select(*keys, "index", T.clean_translation(F.col("translated")).alias("new"))
    return items.join(named, [*keys, "index"], "left").withColumn("original", F.col("text")).withColumn("translated", F.coalesce("new", "text")).drop("new")


def translate(detections: DataFrame, keys: list[str], client, source: str = "auto", target: str = "zh-CN") -> DataFrame:
    """keys, index, original, translated of the translatable rows of detections (keys, index, type, text)."""
    own = batches(detections, keys, "index")
    answered = ask(prompts(own, keys, source, target), keys, client)
    got = answered.select(*keys, F.explode(parse_answer(F.col("answer"))).alias("t")).select(*keys, "t.index", "t.translated").dropDuplicates([*keys, "index"])
    return apply(own, got, keys).select(*keys, "index", "original", "translated")


class EchoClient:
    """A deterministic client without a network: every item in upper case."""

    def complete(self, system: str, user: str) -> str:
        # An item goes on over lines up to the next one that begins with a number.
        items = [x.split(": ", 1) for x in re.split(r"\n(?=\d+: )", user.partition("\n")[2])]
        return json.dumps({"translations": [{"index": int(k), "translated": t.upper()} for k, t in items]}, ensure_ascii=False)
