"""Extraction that learns: known plans first, and one question to a model for each template that has none or whose plan fails."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequery.errors import ExtractionError
from pagequery.functions.coerce import COERCIONS
from pagequery.functions.loose import first_object
from pagequery.functions.pages import clean
from pagequery.operators.crawl import written
from pagequery.operators.text import choose_payload
from pagequery.plans.extract import heal_flags, induce_selectors, invalidate, matched, representatives, signature, templates, upsert_plans, with_plans, zip_error, zip_fields
from pagequery.plans.schema import schema_line

#: A model: from an instruction and a page's view to JSON text with a list ``items``. It must be picklable; it runs on the executors.
ModelClient = Callable[[str, str], str]
PLANS = "domain string, template string, plan map<string,array<string>>"
MAX_BODY = 100_000


def instruction(fields: dict[str, str], prompt: str = "", error: str | None = None) -> str:
    lines = [f'Answer with JSON: {{"items": [...]}}, each item with {schema_line(fields)}.', prompt, f"The last answer failed: {error}" if error else ""]
    return "\n".join(filter(None, lines))


def flat_item(item, prefix: str = "") -> dict:
    """An answer's item with the fields of its objects beside its own, their names joined by two underscores; anything but an object is empty."""
    out: dict = {}
    for k, v in item.items() if isinstance(item, dict) else ():
        out |= flat_item(v, f"{prefix}{k}__") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def learn_plan(html: str, view: str, fields: dict[str, str], client: ModelClient, required: Sequence[str] = (), prompt: str = "", attempts: int = 2) -> tuple[dict | None, str | None, int]:
    """Plan, error and number of questions for one page.

    Items that lack a required field are dropped; an answer without any other
    item, or with a field that no selector gives back, is asked again with what
    failed, up to ``attempts`` questions. A view that was cut need only give
    the first values.
    """
    error = "no question was asked"
    for asked in range(1, attempts + 1):
        try:
            found = (first_object(client(instruction(fields, prompt, error if asked > 1 else None), view)) or {}).get("items")
        except Exception as e:  # a model's failure is an answer to be asked again
            found, error = None, f"{type(e).__name__}: {e}"
        else:
            error = "no items" if not isinstance(found, list) else "no item is valid"
        told = [{f: str(i[f]).strip() for f in fields if i.get(f) is not None and str(i[f]).strip()} for i in map(flat_item, found or []) if i]
        told = [i for i in told if i and all(f in i for f in required)]
        if told:
            plan = induce_selectors(html, {f: wanted for f in fields if (wanted := [i[f] for i in told if f in i])}, cut=len(view) >= MAX_BODY)
            lost = sorted(f for f, selectors in plan.items() if not selectors)
            if not lost:
                return plan, None, asked
            error = f"no selector gives back: {', '.join(lost)}"
    return None, error, attempts


def extract_pages(
    pages: DataFrame, fields: dict[str, str], client: ModelClient, plans: DataFrame | None = None,
    required: Sequence[str] = (), prompt: str = "", attempts: int = 2, view: str = "auto",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of ``pages`` (url, html and others): rows, all plans, and what was asked.

    ``fields`` maps names to coercions. Pages with a known plan for their domain
    and template are read by it. Where there is none, or a page does not fit,
    the model is asked once per (domain, template) about the first such page by
    url, and its answer becomes a plan, which reads all those pages. Rows hold the
    pages' other columns, pos, the typed fields and ``_error``: a page that no
    plan fits has one row without values that says why.
    """
    unknown = sorted(set(fields.values()) - set(COERCIONS)) + sorted({"url", "html"} - set(pages.columns))
    if unknown or set(fields) & set(pages.columns):
        raise ValueError(f"fields do not fit the pages: {unknown or sorted(set(fields) & set(pages.columns))}")
    plans = pages.sparkSession.createDataFrame([], PLANS) if plans is None else plans.select("domain", "template", "plan")
    names, keep = list(fields), pages.columns

    def read(known: DataFrame) -> DataFrame:
        found = known.withColumn("found", matched(F.when(F.col("plan").isNotNull(), F.col("html")), F.coalesce("plan", F.create_map().cast("map<string,array<string>>"))))
        failed = F.col("plan").isNull() | zip_error(names, list(required)).isNotNull()
        rows = zip_fields(found.withColumn("html", F.when(failed, F.col("html"))), names, list(required))  # markup only of pages that are read again, so in one row of each
        return rows.withColumn("_error", F.when(F.col("plan").isNull(), F.coalesce("_why", F.lit("no plan"))).otherwise(F.col("_error")))

    keyed = with_plans(templates(pages, signature(fields)), plans).withColumn("_why", F.lit(None).cast("string"))
    first = written(read(keyed).drop("plan", "_why"))
    open_ = first.where("_error IS NOT NULL").select(*keep, "domain", "template")
    # pages pack well and take long to read, so that few of them shall meet in a task
    spread = max(1, min(open_.count(), 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [learn_plan(h, v, fields, client, required, prompt, attempts) for h, v in zip(part["html"], part["view"])]
            yield pd.DataFrame({"domain": part["domain"], "template": part["template"], "url": part["url"], "plan": [m[0] for m in made], "_why": [m[1] for m in made], "questions": [m[2] for m in made]})

    chosen = representatives(open_.where("html IS NOT NULL")).repartition(spread, "url").select("domain", "template", "url", "html", choose_payload(clean(F.col("html"), view == "slim_html", MAX_BODY), view, max_body=MAX_BODY).alias("view"))
    asked = written(chosen.mapInPandas(learn, PLANS + ", url string, _why string, questions int"))
    learned = asked.where("plan IS NOT NULL").select("domain", "template", "plan")
    second = read(open_.repartition(spread, "url").join(asked.select("domain", "template", "plan", "_why"), ["domain", "template"], "left"))
    typed = lambda rows: rows.select(*[c for c in keep if c != "html"], "pos", *[COERCIONS[k][1](F.col(n)).alias(n) if k != "string" else F.col(n) for n, k in fields.items()], "_error")
    return typed(first.where("_error IS NULL")).unionByName(typed(second)), upsert_plans(plans, learned), asked.withColumnRenamed("_why", "error")


def clean_pages(pages: DataFrame, strategy: str = "rules", client: ModelClient | None = None) -> DataFrame:
    """Adds ``cleaned`` (see ``pages.clean``) and ``cleaned_by``.

    ``rules`` is the engine's own cleaning, ``model`` asks the client for a
    heading and items, as JSON or else plain text with marks, ``auto`` asks if
    there is a client. A page for which the model fails or says nothing is
    cleaned by rules.
    """
    if strategy not in ("rules", "model", "auto") or (strategy == "model" and client is None):
        raise ValueError(f"unknown strategy, or no client for it: {strategy}")
    base = pages.withColumn("cleaned", clean(F.col("html")))
    if strategy == "rules" or client is None:
        return base.withColumn("cleaned_by", F.lit("rules"))
    told = 'Answer with JSON: {"heading": "...", "items": ["..."]}, the text of this page that a reader needs.'

    @F.pandas_udf("struct<heading:string,markdown:string,items:array<string>,flat_json:string>")
    def asked(html: pd.Series) -> pd.DataFrame:
        def one(h):
            try:
                answer = client(told, (h or "")[:MAX_BODY]).strip()
            except Exception:  # the rules stand in
                answer = ""
            found = first_object(answer) or {}
            heading, items = str(found.get("heading") or ""), [str(i) for i in found.get("items") or [] if str(i).strip()]
            if not items and answer and not found:
                lines = [x.strip() for x in answer.splitlines() if x.strip()]
                heading = next((x.lstrip("# ") for x in lines if x.startswith("#")), "")
                items = [x.lstrip("-* ") for x in lines if not x.startswith("#")]
            text = "\n\n".join([f"# {heading}"] * bool(heading) + [f"- {i}" for i in items])
            flat = json.dumps({"heading": heading, "items": items}, ensure_ascii=False)
            return (heading, text, items, flat) if items else (None, None, None, None)

        return pd.DataFrame([one(h) for h in html], columns=["heading", "markdown", "items", "flat_json"])

    both = base.withColumn("_m", asked("html")).withColumn("cleaned_by", F.when(F.col("_m.items").isNotNull(), "model").otherwise("rules"))
    picked = [F.coalesce(F.col(f"_m.{c}"), F.col(f"cleaned.{c}")).alias(c) for c in ("heading", "markdown", "items", "flat_json")]
    return both.withColumn("cleaned", F.struct(*picked, F.col("cleaned.html_excerpt").alias("html_excerpt"))).drop("_m")


def heal(
    pages: DataFrame, plans: DataFrame, fields: dict[str, str], client: ModelClient, required: Sequence[str] = (),
    threshold: float | None = None, check: Callable[[pd.DataFrame], bool] | None = None, attempts: int = 2, strict: bool = False, **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extraction that mends its plans: rows, plans, and the templates (domain, template) that still fail.

    After each reading the templates whose rows call for it (see
    ``heal_flags``) lose their plan and their pages are learned again, up to
    ``attempts`` readings in all. What fails to the end keeps no plan, and with
    ``strict`` raises.
    """
    for attempt in range(attempts):
        rows, plans, _ = extract_pages(pages, fields, client, plans, required=required, **options)
        keyed = templates(pages, signature(fields)).select("url", "domain", "template").distinct()
        placed = written(rows.join(keyed, "url", "left"))
        failing = written(heal_flags(placed.where("_error IS NULL"), ["domain", "template"], list(required), list(fields), threshold, keyed, check).where("heal").select("domain", "template"))
        if failing.isEmpty():
            break
        plans = written(invalidate(plans, failing))
    if strict and not failing.isEmpty():
        raise ExtractionError("templates fail after healing", templates=failing.count(), attempts=attempts)
    return rows, plans, failing


def plan_stats(plans: DataFrame) -> DataFrame:
    """Number of plans, of domains and of selectors."""
    size = F.aggregate(F.map_values("plan"), F.lit(0), lambda n, s: n + F.size(s))
    return plans.agg(F.count("*").alias("plans"), F.count_distinct("domain").alias("domains"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("selectors"))
