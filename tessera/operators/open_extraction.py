"""Open extraction as a table function: a text gives entities, triples and what was wrong with a model's answers, as rows.

The contract has two steps: a model is asked for the names in a text, then, with those names, for triples. Its answers are
texts that should hold JSON; what they hold is checked here, and each thing that doesn't fit becomes a row of its own.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from tessera.operators.providers import with_retries

SCHEMA = "kind string, ord int, s string, r string, o string, reason string"
Row = tuple[str, int, str | None, str | None, str | None, str | None]


class OpenModel(Protocol):
    """Answers as JSON texts: {"named_entities": [...]}, then {"triples": [[s, r, o], ...]}."""

    def names(self, text: str) -> str: ...

    def triples(self, text: str, names: list[str]) -> str: ...


class Neighbours:
    """The model used where none is given: capitalised words, and in each sentence each of them with the next one."""

    def names(self, text: str) -> str:
        return json.dumps({"named_entities": re.findall("[A-Z][a-z]+", text)})

    def triples(self, text: str, names: list[str]) -> str:
        known, out = set(names), []
        for sentence in re.split("[.!?] ", text):
            found = [w for w in re.findall("[A-Z][a-z]+", sentence) if w in known]
            out += [[a, "stands before", b] for a, b in zip(found, found[1:], strict=False)] if len(found) != 1 else [found]
        return json.dumps({"triples": out})


def _listed(answer: str, key: str) -> tuple[list, str | None]:
    """The list under key of the JSON object in an answer, which may stand between other words; and what is wrong."""
    for text in (answer, answer[answer.find("{") : answer.rfind("}") + 1]):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        value = found.get(key) if isinstance(found, dict) else None
        return (value, None) if isinstance(value, list) else ([], f"no list of {key}")
    return [], "no JSON object"


def rows_of(text: str | None, model: OpenModel, tries: int = 3) -> Iterator[Row]:
    """Entities (in order, each once), triples (each once, by their first place) and errors of one text.

    A null or blank text gives nothing. Names that are no text or blank are dropped. A triple of other than three parts
    or with an empty part is an error, as is an answer without the JSON asked for or a model that fails every time.
    """
    if not (text or "").strip():
        return

    def asked(call, key: str) -> tuple[list, str | None]:
        try:
            return _listed(with_retries(call, tries)(text) or "", key)
        except Exception as failed:  # the model's own errors; the row says which
            return [], f"model failed: {type(failed).__name__}"

    found, wrong = asked(model.names, "named_entities")
    names = sorted({n.strip() for n in found if isinstance(n, str) and n.strip()})
    if wrong:
        yield "error", 0, None, None, None, wrong
    for k, name in enumerate(names):
        yield "entity", k, name, None, None, None
    found, wrong = asked(lambda t: model.triples(t, names), "triples")
    if wrong:
        yield "error", 1, None, None, None, wrong
    seen = set()
    for k, triple in enumerate(found):
        parts = tuple(str(p).strip() for p in triple) if isinstance(triple, list) else ()
        if len(parts) != 3:
            yield "error", k, json.dumps(triple), None, None, "not three parts"
        elif not all(parts):
            yield "error", k, json.dumps(triple), None, None, "empty part"
        elif parts not in seen:
            seen.add(parts)
            yield "triple", k, *parts, None


def register(spark: SparkSession, name: str = "open_extract", model: OpenModel | None = None) -> None:
    """Makes name(text) a table function of SQL: SELECT ... FROM docs, LATERAL name(docs.text); columns: see SCHEMA."""
    chosen = model or Neighbours()

    class OpenExtract:
        def eval(self, text: str) -> Iterator[Row]:
            yield from rows_of(text, chosen)

    spark.udtf.register(name, udtf(OpenExtract, returnType=SCHEMA, useArrow=True))


def extracted(docs: DataFrame, key: str, text: str = "text", model: OpenModel | None = None) -> DataFrame:
    """key and the table function's columns: the rows of all texts. Each text is one call, in the task that holds it."""
    spark, name = docs.sparkSession, f"open_extract_{uuid.uuid4().hex}"
    register(spark, name, model)
    docs.select(key, text).createOrReplaceTempView(f"{name}_docs")
    try:
        return spark.sql(f"SELECT d.`{key}`, t.* FROM {name}_docs d, LATERAL {name}(d.`{text}`) t")
    finally:
        spark.catalog.dropTempView(f"{name}_docs")
