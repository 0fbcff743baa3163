"""Language-model verification: which rows a model sees, its answers, a two-pass audit, and a knowledge corpus.

A model is any callable from prompt to a JSON text; ``make`` opens it once in each Python worker. Rows that
need no model never leave the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import values as V

#: A prompt to the text of an answer.
Model = Callable[[str], str]
ANSWER = "category string, confidence double, method string, matched array<string>, needs_review boolean"
AUDIT = "llm_category string, llm_confidence double, llm_reason string, llm_agrees boolean, llm_pass string"


def needs_model(method: Column, confidence: Column, category: Column) -> Column:
    """Uncertain results: by their method, a low confidence, or "others" without a high one. Empty texts never."""
    sure = F.coalesce(confidence.cast("double"), F.lit(0.0))
    doubt = method.isin(*V.GATED_METHODS) | (sure < V.GATE_LEAST) | ((category == "others") & (sure < V.GATE_OTHERS))
    return F.coalesce(method != "empty_activity", F.lit(True)) & F.coalesce(doubt, F.lit(False))


def cap_fragments(t: Column, fragment: Column) -> Column:
    """A taxonomy struct whose text is a fragment: if it is to be reviewed, its confidence is capped and a warning added."""
    hit = F.coalesce(fragment, F.lit(False)) & t["needs_review"]
    confidence = F.when(hit, F.least(t["confidence"], F.lit(V.FRAGMENT_CAP))).otherwise(t["confidence"])
    matched = F.when(hit, F.concat(t["matched"], F.array(F.lit(V.FRAGMENT_WARNING)))).otherwise(t["matched"])
    return F.struct(t["category"].alias("category"), confidence.alias("confidence"), t["method"].alias("method"), matched.alias("matched"), t["needs_review"].alias("needs_review"))


def _answer(raw: str) -> dict:
    """The outermost object of a reply, whatever stands around it."""
    return json.loads(raw[raw.index("{") : raw.rindex("}") + 1])


def verified(df: DataFrame, text: str, result: str, make: Callable[[], Model], prompt: Callable[[str, dict], str]) -> DataFrame:
    """``df`` with ``result`` (a struct of ANSWER) replaced by a model's answer where :func:`needs_model` holds.

    An answer outside the known categories changes nothing; an error is added to the matched keywords.
    """
    gate = needs_model(F.col(f"{result}.method"), F.col(f"{result}.confidence"), F.col(f"{result}.category"))

    def run(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        model = make()
        for texts, results in parts:
            out = []
            for x, r in zip(texts, results.to_dict("records"), strict=True):
                r["matched"] = list(r["matched"]) if r["matched"] is not None else []
                try:
                    a = _answer(model(prompt(x or "", r)))
                    confidence = float(a.get("confidence", 0.0))
                    if (category := str(a.get("category", "")).strip()) in V.CATEGORIES:
                        r = {"category": category, "confidence": round(confidence, 3), "method": "llm_verification", "matched": [f"llm_reason: {str(a.get('reason', '')).strip()}"], "needs_review": bool(a.get("needs_review", True)) or confidence < V.GATE_LEAST}
                except Exception as error:  # whatever a model does, the row keeps its result
                    r["matched"] = [*r["matched"], f"llm_error: {error}"]
                out.append(r)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    asked = df.filter(gate).withColumn(result, F.pandas_udf(run, ANSWER)(F.col(text), F.col(result)))
    return df.filter(~gate).unionByName(asked)


def two_pass(df: DataFrame, text: str, category: str, make: Callable[[], Model], blind: Callable[[str], str], reconcile: Callable[[str, str, float, str], str]) -> DataFrame:
    """``df`` with the columns of AUDIT: a model's own category, and a second answer only where it disagrees with ``category``.

    A row without a text is not shown to the model; a failure of the second pass leaves the first answer.
    """

    def one(model: Model, x: str, system: str) -> tuple:
        def ask(q: str) -> tuple[str, float, str]:
            a = _answer(model(q))
            found = str(a.get("llm_category", "")).strip()
            return found if found in V.CATEGORIES else "others", round(float(a.get("llm_confidence", 0.0)), 3), str(a.get("llm_reason", "")).strip()

        if not x.strip():
            return "others", 0.0, "empty activity", system == "others", "skipped"
        try:
            first, sure, why = ask(blind(x))
        except Exception as error:  # no answer: the row stays as it is
            return "error", 0.0, str(error), False, "error"
        if first == system:
            return first, sure, why, True, "blind"
        try:
            last, sure, why = ask(reconcile(x, first, sure, system))
            return last, sure, why, last == system, "reconciliation"
        except Exception as error:
            return first, sure, f"{why} [reconciliation failed: {error}]", False, "blind_fallback"

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make()
        for texts, systems in parts:
            yield pd.DataFrame([one(model, x or "", s or "") for x, s in zip(texts, systems, strict=True)], columns=[c.split()[0] for c in AUDIT.split(", ")])

    return df.withColumn("__a", F.pandas_udf(run, AUDIT)(F.col(text), F.col(category))).select("*", "__a.*").drop("__a")


def audited(spark, df: DataFrame, key: str, path: str, audit: Callable[[DataFrame], DataFrame], batches: int = 20) -> DataFrame:
    """Audit ``df`` batch by batch into a table at ``path``; a run that is started again skips what is in there."""
    from lodestar.sources.files import append_new

    for k in range(batches):
        append_new(spark, df.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k), path, key, audit)
    return spark.read.parquet(path)


def knowledge(rules: DataFrame, taxonomy: Sequence[tuple[str, str, Sequence[str], Sequence[str]]], examples: DataFrame) -> DataFrame:
    """(text, category, source), distinct and without NULL: manual rules, a taxonomy and validated examples.

    ``rules`` and ``examples`` have (text, category); ``taxonomy`` lists (sector, definition, rules, examples).
    """
    rows = [(t, s, kind) for s, definition, own, shown in taxonomy for kind, texts in (("taxonomy_definition", [definition]), ("taxonomy_rule", own), ("taxonomy_example", shown)) for t in texts]
    spark = rules.sparkSession
    parts = [rules.select("text", "category", F.lit("manual_business_rule").alias("source")), spark.createDataFrame(rows, "text string, category string, source string"), examples.select("text", "category", F.lit("validated_example").alias("source"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.na.drop(subset=["text", "category"]).dropDuplicates(["text", "category", "source"])
