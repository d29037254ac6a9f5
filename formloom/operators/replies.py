"""Replies of language models and their merging with earlier values; calls are left to an injected client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_empty, strip, to_number
from .catalog import EMPTY, JSON_FIELDS, NUMBERS

MAX_CHARS = 18_000  # of a text that are sent to a model


def json_object(reply: Column) -> Column:
    """The text from the first opening to the last closing brace of a reply, without a code fence."""
    text = strip(reply)
    bare = strip(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```\z", ""))
    bare = F.when(text.startswith("```"), bare).otherwise(text)
    inside = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(inside != "", inside).otherwise(bare)


def parse_reply(reply: Column, schema: str) -> Column:
    """Allowed keys of a reply as a struct; null fields where it has none, null where it is no JSON."""
    return F.from_json(json_object(reply), schema, {"mode": "PERMISSIVE"})


def merge_values(rows: DataFrame) -> DataFrame:
    """Adds ``value`` and ``outcome`` to long rows with ``model`` and ``prior`` texts.

    A model's value wins, and is cross-validated where the earlier one is the same but
    for case and outer space; an empty one gives way to the earlier value.
    """
    model, prior = F.col("model"), F.col("prior")
    same = F.lower(strip(model)) == F.lower(strip(prior))
    outcome = (
        F.when(is_empty(model) & is_empty(prior), "none").when(is_empty(model), "restored").when(is_empty(prior), "model")
        .when(same, "cross-validated").otherwise("override")
    )
    return rows.withColumns({"value": F.when(~is_empty(model), model).when(~is_empty(prior), prior), "outcome": outcome})


def ask(docs: DataFrame, client: Callable[[str], str], text_col: str = "text", out: str = "reply") -> DataFrame:
    """Adds a client's reply to the head of each text that fits a model's input."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: [client((t or "")[:MAX_CHARS]) for t in batch[text_col]]})

    return docs.mapInPandas(run, f"{fields}, `{out}` string")


#: Address of each provider that speaks the same protocol, and those that have no JSON mode.
BASE_URL = {
    "groq": "https://api.groq.com/openai/v1",
    "openrouter": "https://openrouter.ai/api/v1",
    "ollama": "http://localhost:11434/v1/",
    "gemini": "https://generativelanguage.googleapis.com/v1beta/openai/",
}
NO_JSON_MODE = ("ollama", "openrouter")
_KIND = {"invoice": "an invoice", "medical_discharge": "a hospital discharge summary", "nda": "a non-disclosure agreement", "lab_report": "a laboratory report", "business_doc": "a business report"}


def client_options(provider: str, base_url: str | None, api_key: str | None) -> dict[str, str | None]:
    """Address and key for a provider; a local one needs no key."""
    name = provider.strip().lower()
    return {"base_url": base_url or BASE_URL.get(name), "api_key": (api_key or "ollama") if name == "ollama" else api_key}


def prompt(document_type: str) -> str:
    """What a model is asked for a type: a JSON object with the fields of its empty record."""
    kind = document_type if document_type in EMPTY else "invoice"
    fields = ", ".join(f"{f} ({'list' if f in JSON_FIELDS else 'number' if f in NUMBERS else 'text'})" for f in EMPTY[kind])
    return f"The text is {_KIND[kind]}. Answer with one JSON object with just these keys, null where the text does not say: {fields}. Write dates as YYYY-MM-DD."


def request(text: str | None, document_type: str, model: str, provider: str = "openai") -> dict:
    """A chat request for a document: temperature 0, its first ``MAX_CHARS`` characters, JSON mode where the provider has it."""
    messages = [
        {"role": "system", "content": "You extract fields from documents and answer in JSON."},
        {"role": "user", "content": f"{prompt(document_type)}\n\nDocument text:\n{(text or '')[:MAX_CHARS]}"},
    ]
    out = {"model": model, "messages": messages, "temperature": 0}
    if provider.strip().lower() not in NO_JSON_MODE:
        out["response_format"] = {"type": "json_object"}
    return out


def ask_by_type(docs: DataFrame, client: Callable[[dict], str], model: str, provider: str = "openai", text_col: str = "text") -> DataFrame:
    """Adds ``reply`` and ``failure`` of a client to documents with a ``document_type``.

    The client takes a request and returns text; what it raises becomes the row's failure, so
    one document does not stop the others, and ``quality_scores.retry_after`` tells how long to wait.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def one(text, kind):
        try:
            reply = client(request(text, kind, model, provider))
            return (reply, None) if reply else (None, "The LLM returned an empty response.")
        except Exception as e:  # told apart by their text
            return None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(t, k) for t, k in zip(batch[text_col], batch["document_type"], strict=True)]
            yield batch.assign(reply=[x[0] for x in got], failure=[x[1] for x in got])

    return docs.mapInPandas(run, f"{fields}, reply string, failure string")


def reply_record(reply: Column, document_type: str) -> dict[str, Column]:
    """Columns of a type's empty record as a reply fills them: other keys are left out, money is a number, a list that is none is empty.

    Lists come as JSON texts of their items.
    """
    kind = document_type if document_type in EMPTY else "invoice"
    body = json_object(reply)
    out = {"document_type": F.lit(kind)}
    for f in EMPTY[kind]:
        value = F.get_json_object(body, f"$.{f}")
        if f in JSON_FIELDS:
            items = F.from_json(value, "array<string>", {"mode": "PERMISSIVE"})
            out[f] = F.coalesce(F.when(strip(value).startswith("["), items), F.array().cast("array<string>"))
        elif f in NUMBERS:
            out[f] = to_number(value)
        elif f == "currency":
            out[f] = F.coalesce(value, F.when(~F.coalesce(F.array_contains(F.json_object_keys(body), f), F.lit(False)), "USD"))
        else:
            out[f] = value
    return out


def merge_steps(fields: DataFrame, key: str) -> DataFrame:
    """(key, trace): the steps that tell of merged values (``merge_values``, with a ``field`` column), a document's fields at a time."""
    named = lambda outcome: F.array_sort(F.collect_list(F.when(F.col("outcome") == outcome, F.col("field"))))
    grouped = fields.groupBy(key).agg(*[named(o).alias(o) for o in ("cross-validated", "override", "restored")])
    told = lambda o, lead: F.when(F.size(o) > 0, F.concat(F.lit(lead), F.array_join(o, ", "), F.lit(".")))
    steps = F.array(
        told("cross-validated", "Cross-validated — multiple methods agree on: "),
        told("override", "LLM value differs from prior extraction (LLM used): "),
        told("restored", "Restored prior extraction values where LLM returned null: "),
    )
    return grouped.select(key, F.filter(steps, lambda x: x.isNotNull()).alias("trace"))
