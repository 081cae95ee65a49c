"""Contracts of requests: every constraint that a request and its product set, with what the request says for it.

All of it is expressions over one row (clauses and evidence come from Arrow functions), so nothing is
shuffled; ``constraints`` explodes a contract into its numbered rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clauses, price, text
from . import options, requests

# Fixed values -------------------------------------------------------------------------------
VERSION, SEMANTICS_VERSION = "shopping-query-constraints-v1", "shopping-constraint-semantics-v2"
PRICES = ("budget_upper", "price_lower", "price_range")
GOLD_ROLES = ("gold_variant_reference", "gold_annotation_reference")
HARD_FORBID = r"绝对(?:不要|不能|不许)|坚决不要|严禁|禁止|不得|不可|不能有|必须(?:没有|不含|不带|不能)|一定(?:不要|不能|不需要)"
HARD_REQUIRE = r"必须|务必|一定(?:要|得|需)|非.{0,8}不可|只(?:要|能|可)|仅限"
SOFT_NEGATIVE = r"不要太|别太"
PLAIN_FORBID = r"不要(?!太)|(?<!特)别(?:要|让)(?!太)"
INDIFFERENT = r"无所谓|不要求|没要求|无要求|不限|不限制|不限定|任意|随意|随便|不挑|可有可无|都行|均可|没有需求|没需求|也可以|也行|都可以|没有.{0,8}也可以"
UNCLEAR = r"不需要|无需|不用"
TOOL_FREE = r"(?:不用|无需|不必).{0,6}工具.{0,12}(?:也能|就能|即可|可以|可)"
NO_DAMAGE = r"(?:无需|不用|不必|不得|不可).{0,8}(?:破坏|破线|剪线|改线)"
NOT_REQUIRED = r"不需要(?:有|带有|具备)|不用参与|不用减脂"
REJECTED = r"不用(?:花里胡哨|复杂|多余|额外)"
NEGATIVE = r"无|免|不|不可|未"
BOUNDS = r"不超过|不要超过|别超过|不能超过|不高于|至少|不低于|不少于|以内|以下|以上|之间|控制在"
HARD_BOUND = BOUNDS + r"|不得超过|不可超过"
SOFTENERS = r"最好|优先|尽量|希望|倾向|预期|预计|预估|大概|大约|约莫|约摸|差不多|大致"
SOFT_BOUND = rf"(?:{SOFTENERS}).{{0,16}}(?:{BOUNDS})|(?:{BOUNDS}).{{0,10}}(?:比较合适|最好|大概|大约|左右|上下)"
SOFT = (
    r"最好|优先|尽量|希望|偏好|倾向|比较喜欢|更喜欢|比较合适|越.{0,8}越好|可以的话|预期|预计|预估|左右|上下|大概|大约|约莫|约摸|差不多|大致|将近|接近|附近|不要太|别太"
    r"|约(?=[零一二两三四五六七八九十百千万\d])"
)
#: Words for whose sake a clause is kept though no constraint quotes it.
MARKED = (
    r"绝对|必须|务必|一定|不得|不可|不能|不要|不需要|无需|不用|无所谓|不要求|不限|不限制|可有可无|最好|优先|尽量|希望|偏好|倾向|预期|预计|预估|左右|上下|大概|大约|约莫|约摸"
    r"|差不多|大致|将近|接近|附近|不超过|不高于|至少|不低于|以内|以下|以上|之间|控制在|别太|别超过|别让|越.{0,8}越好|约(?=[零一二两三四五六七八九十百千万\d])"
)
# --------------------------------------------------------------------------------------------

def _no_texts() -> Column:
    return F.array().cast("array<struct<text:string,form:string>>")


def semantics(kind: Column, role: Column, expected: Column, required: Column, optional: Column, source: Column, said: Column, approximate: Column) -> Column:
    """SC22: struct (strength, polarity, reason, quote, quote_form, enforcement) of a constraint, by the first rule
    that holds of the clauses ``said`` that its evidence stands in.  ``expected``: a form; ``source``: the text and
    form of a price."""
    is_price = kind.isin(*PRICES)
    evidence = F.when(is_price & (F.coalesce(source["text"], F.lit("")) != ""), F.array(source)).otherwise(F.concat(required, optional))
    quoted = F.filter(said, lambda c: F.exists(evidence, lambda e: (e["form"] != "") & F.contains(c["form"], e["form"])))
    joined = lambda part, by: F.array_join(F.transform(quoted, lambda c: c[part]), by)

    def ruled(q: Column) -> Column:
        has = lambda words: q["quote_form"].rlike(words)
        soft = (F.size(q["clauses"]) > 0) & F.forall(q["clauses"], lambda c: c["form"].rlike(SOFT))
        clause, unclear = kind == "query_clause", has(UNCLEAR)
        rules = (
            (role.isin(*GOLD_ROLES), "ignore", "indifferent", "gold_only_reference"),
            (kind == "category", "hard", "require", "category_contract"),
            ((q["quote"] == "") & (role == "query_preference_reference"), "ignore", "indifferent", "ungrounded_reference"),
            (has(HARD_FORBID), "hard", "forbid", "explicit_hard_forbid_marker"),
            (has(HARD_REQUIRE), "hard", "require", "explicit_hard_require_marker"),
            (soft & has(SOFT_NEGATIVE), "soft", "prefer", "soft_negative_preference"),
            (has(SOFT_BOUND), "soft", "prefer", "soft_qualified_boundary"),
            (has(PLAIN_FORBID), "hard", "forbid", "explicit_forbid_marker"),
            (has(INDIFFERENT), "ignore", "indifferent", "explicit_indifference"),
            (unclear & clause & has(TOOL_FREE), "hard", "require", "tool_free_capability_requirement"),
            (unclear & clause & has(NO_DAMAGE), "hard", "forbid", "no_damage_installation_requirement"),
            (unclear & clause & has(NOT_REQUIRED), "ignore", "indifferent", "explicitly_not_required"),
            (unclear & clause & has(REJECTED), "hard", "forbid", "plain_negative_product_preference"),
            (unclear & ~clause & F.coalesce(expected, F.lit("")).rlike(NEGATIVE), "hard", "forbid", "negative_query_supported_by_target_evidence"),
            (unclear, "needs_review", "unknown", "ambiguous_negation"),
            (has(HARD_BOUND), "hard", "require", "explicit_hard_boundary"),
            (soft, "soft", "prefer", "explicit_soft_preference"),
            (is_price & F.coalesce(approximate, F.lit(False)), "soft", "prefer", "approximate_price"),
            (is_price, "hard", "require", "explicit_price_boundary"),
            ((F.size(optional) > 0) & (F.size(required) == 0), "soft", "prefer", "optional_query_language"),
            (clause, "needs_review", "unknown", "unclassified_semantic_clause"),
            (F.size(required) > 0, "hard", "require", "explicit_query_requirement"),
        )
        out = F
        for holds, *verdict in rules:
            out = out.when(holds, F.array(*map(F.lit, verdict)))
        verdict = out.otherwise(F.array(*map(F.lit, ("ignore", "indifferent", "no_public_query_grounding"))))
        return F.struct(verdict.alias("v"), q["quote"].alias("quote"), q["quote_form"].alias("quote_form"))

    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    state = let(F.struct(quoted.alias("clauses"), joined("text", "；").alias("quote"), joined("form", ";").alias("quote_form")), ruled)
    name = lambda s: F.when((kind == "query_clause") | s["v"][0].isin("ignore", "needs_review"), "audit_only").otherwise("scored")
    return let(
        state,
        lambda s: F.struct(s["v"][0].alias("strength"), s["v"][1].alias("polarity"), s["v"][2].alias("reason"), s["quote"].alias("quote"), s["quote_form"].alias("quote_form"), name(s).alias("enforcement")),
    )


def _held(function):
    """An Arrow function whose column is computed where it is named: Catalyst moves no call of it into a lambda,
    where none can run."""
    return F.pandas_udf(function.func, function.returnType).asNondeterministic()


def clean(values: Column) -> Column:
    """White space to single spaces, no empty values, each once."""
    spaced = F.transform(values, lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"[\s 　]+", " ")))
    return F.coalesce(F.array_distinct(F.filter(spaced, lambda v: v != "")), F.array().cast("array<string>"))


def category_leaf(path: Column) -> Column:
    """The last named part of a category, the whole if there is none."""
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "[›>/]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.coalesce(path, F.lit("")))


def _item(kind: str, value: Column, axis: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), (F.lit(None).cast("string") if axis is None else axis).alias("axis"))


def compile_contracts(df: DataFrame, aliases: dict[str, str] | None = None, brands: dict[str, str] | None = None) -> DataFrame:
    """SC23, SC24: ``df`` with ``contract`` (constraints in order, ids q0001, q0002, ...), and the features
    expected_brand, expected_model, expected_functions, optional_brand, optional_model, optional_functions,
    price_upper, request_sha256, contract_sha256.

    ``df`` has request, category, title, shop, description (texts), attributes, wanted (arrays of texts) and
    options (map of axis to array of value and price).  ``aliases``: form -> canonical form of values; ``brands``:
    the same of brands.  Nulls are empty; a request without text has its category and unsupported options only;
    repeated rows give equal contracts; other columns stay, but for those named like a result."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    normal = _held(text.normalize_text)
    given = [F.col(f"`{c}`") for c in ("request", "category", "title", "shop", "description", "attributes", "wanted", "options")]
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *given).withColumns({
        "__said": _held(clauses.segments)(empty("request")), "__form": normal(empty("request")), "__title": normal(empty("title")), "__shop": normal(empty("shop")),
        "__prices": _held(price.extract_prices)(empty("request")), "__functions": clean(F.col("attributes")),
        "__options": options.required_axes(clean(F.col("wanted")), F.coalesce(F.col("options"), F.create_map().cast("map<string,array<struct<value:string,price:double>>>"))),
    })
    d = d.withColumns({"__brands": requests.said_brands(F.col("__form"), F.col("__title"), F.col("__shop"), brands or {}), "__models": requests.said_models(empty("request"), F.col("title"), F.col("description"))})
    opts = F.transform(F.concat(F.filter("__options", lambda o: o["reason"].isNull()), F.filter("__options", lambda o: o["reason"].isNotNull())), lambda o: _item("option", o["value"], o["axis"]))
    listed = lambda kind, values: F.transform(F.col(values), lambda v: _item(kind, v))
    lists = [listed(k, c) for k, c in (("brand", "__brands"), ("model", "__models"), ("core_function", "__functions"))]
    d = d.withColumn("__items", F.concat(F.array(_item("category", category_leaf(F.col("category")))), *lists, opts))
    values = F.transform("__items", lambda i: i["value"])
    d = d.withColumns({"__found": _held(clauses.evidence(aliases))(empty("request"), values), "__forms": _held(clauses.evidence())(F.array_join(values, "\n"), values)})

    def with_evidence(i: Column, k: Column) -> Column:
        sides = clauses.partition(F.element_at("__found", k + 1), F.col("__said"))
        form = F.get(F.element_at("__forms", k + 1), F.lit(0))["form"]
        return F.struct(i["kind"].alias("kind"), i["value"].alias("value"), i["axis"].alias("axis"), form.alias("form"), sides["required"].alias("required"), sides["optional"].alias("optional"))

    d = d.withColumn("__items", F.transform("__items", with_evidence))
    d = d.withColumn("__price", price.constraint(F.col("__prices")))
    p = F.col("__price")
    kind = F.when(p["operator"].isin("lt", "lte"), "budget_upper").when(p["operator"].isin("gt", "gte"), "price_lower").otherwise("price_range")
    no_text = F.lit(None).cast("string")

    def row(kind: Column, role: Column, axis: Column, expected: Column, form: Column, source: Column, required: Column, optional: Column) -> Column:
        named = {"kind": kind, "role": role, "axis": axis, "expected": expected, "form": form, "source": source, "required": required, "optional": optional}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    of = lambda kinds, holds: F.filter("__items", lambda i: i["kind"].isin(*kinds) & holds(i))
    three = ("brand", "model", "core_function")
    source = lambda i, how: F.when(i["kind"] == "core_function", f"instruction.{how[1]}annotation").otherwise(F.concat(F.lit(f"query.{how[0]}_"), i["kind"]))
    has = lambda i, side: F.size(i[side]) > 0
    spoken = F.array(F.struct(F.coalesce(F.nullif(p["text"], F.lit("")), empty("request")).alias("text"), F.lower(F.regexp_replace(F.coalesce(p["text"], F.lit("")), r"\s+", "")).alias("form")))
    asked = F.when(p.isNotNull(), F.array(row(kind, F.lit("required_constraint"), no_text, F.to_json(p), no_text, F.when(kind == "budget_upper", "query.explicit_budget").otherwise("query.explicit_price"), spoken, _no_texts()))).otherwise(F.array())
    role = lambda i: F.when(has(i, "required"), "strict_query_variant").when(has(i, "optional"), "query_preference_reference").otherwise("gold_variant_reference")
    rows = F.concat(
        F.transform(of(("category",), lambda i: F.lit(True)), lambda i: row(i["kind"], F.lit("hard_gate"), no_text, empty("category"), i["form"], F.lit("task.category_contract"), i["required"], _no_texts())),
        asked,
        F.transform(of(three, lambda i: has(i, "required")), lambda i: row(i["kind"], F.lit("matching_dimension"), no_text, i["value"], i["form"], source(i, ("explicit", "")), i["required"], _no_texts())),
        F.transform(of(three, lambda i: ~has(i, "required") & has(i, "optional")), lambda i: row(i["kind"], F.lit("query_preference_reference"), no_text, i["value"], i["form"], source(i, ("optional", "optional_")), _no_texts(), i["optional"])),
        F.transform(of(("option",), lambda i: F.lit(True)), lambda i: row(i["kind"], role(i), i["axis"], i["value"], i["form"], F.lit("instruction.instruction_options"), i["required"], i["optional"])),
    )
    d = d.withColumn("__rows", rows)
    judged = lambda r: F.struct(r.alias("r"), semantics(r["kind"], r["role"], r["form"], r["required"], r["optional"], F.get(r["required"], F.lit(0)), F.col("__said"), p["approximate"]).alias("s"))
    d = d.withColumn("__judged", F.transform("__rows", judged))
    holding = lambda c: F.array_join(F.transform(F.filter("__said", lambda x: F.contains(x["form"], c["form"])), lambda x: x["form"]), ";")
    start = F.struct(F.transform("__judged", lambda j: j["s"]["quote_form"]).alias("quotes"), _no_texts().alias("kept"))
    # a marked clause is kept unless a quote before it, of a constraint or of a clause kept, holds it
    fresh = lambda a, c: c["form"].rlike(MARKED) & ~F.exists(a["quotes"], lambda q: F.contains(q, c["form"]))
    walked = F.aggregate("__said", start, lambda a, c: F.when(fresh(a, c), F.struct(F.concat(a["quotes"], F.array(holding(c))).alias("quotes"), F.concat(a["kept"], F.array(c)).alias("kept"))).otherwise(a))
    d = d.withColumn("__kept", walked["kept"])
    audit = lambda c: judged(row(F.lit("query_clause"), F.lit("query_semantic_audit"), no_text, c["text"], c["form"], F.lit("query.semantic_clause"), F.array(c), _no_texts()))
    texts = lambda side: F.transform(side, lambda e: e["text"])
    final = lambda j, k: F.struct(
        F.concat(F.lit("q"), F.lpad((k + 1).cast("string"), 4, "0")).alias("constraint_id"), j["r"]["kind"].alias("constraint_type"), j["r"]["role"].alias("role"), j["r"]["axis"].alias("axis"),
        j["r"]["expected"].alias("expected"), j["r"]["source"].alias("source"), texts(j["r"]["required"]).alias("query_evidence"), texts(j["r"]["optional"]).alias("optional_query_evidence"),
        j["s"]["strength"].alias("strength"), j["s"]["polarity"].alias("polarity"), j["s"]["enforcement"].alias("enforcement"), j["s"]["quote"].alias("query_quote"), j["s"]["reason"].alias("semantics_reason"),
    )
    d = d.withColumn("contract", F.transform(F.concat("__judged", F.transform("__kept", audit)), final))
    feature = lambda kind, side: F.transform(of((kind,), lambda i: has(i, "required") if side == "required" else ~has(i, "required") & has(i, "optional")), lambda i: i["value"])
    named = {f"{shown}_{n}": feature(k, side) for side, shown in (("required", "expected"), ("optional", "optional")) for n, k in (("brand", "brand"), ("model", "model"), ("functions", "core_function"))}
    upper = F.when(p["operator"].isin("lt", "lte"), p["value"]).when(p["operator"].isin("between", "approximately"), p["max"])
    d = d.withColumns(named | {"price_upper": upper, "request_sha256": F.sha2(empty("request"), 256)})
    d = d.withColumn("contract_sha256", contract_digest(F.col("contract"), F.col("request_sha256")))
    made = ["contract", *named, "price_upper", "request_sha256", "contract_sha256"]
    return d.select(*[F.col("__row")[c].alias(c) for c in df.columns if c not in made], *made)


def contract_digest(contract: Column, request_sha256: Column) -> Column:
    """Of the versions, the request's hash and the constraints, in order."""
    return F.sha2(F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit(SEMANTICS_VERSION).alias("semantics_version"), request_sha256.alias("instruction_sha256"), contract.alias("constraints"))), 256)


def recompiled(df: DataFrame, stored: str, aliases: dict[str, str] | None = None, brands: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``intact``: compiled anew, its contract has the hash in column ``stored``; a null has none."""
    held = df.withColumn("stored_contract_sha256", F.col(stored))
    return compile_contracts(held, aliases, brands).withColumn("intact", F.col("contract_sha256").eqNullSafe(F.col("stored_contract_sha256"))).drop("stored_contract_sha256")


def constraints(compiled: DataFrame, *keys: str) -> DataFrame:
    """One row a constraint of a compiled contract."""
    return compiled.select(*keys, F.explode("contract").alias("c")).select(*keys, "c.*")
