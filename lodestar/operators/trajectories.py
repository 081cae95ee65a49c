"""Trajectories of an agent: gates, cleaned training rows, the event stream and its metrics.

A trajectory is one row; its steps, messages and calls are arrays of structs (a run ends after a few
dozen steps, so an array is small).  Functions take columns; a field that a record lacks is null.

``steps``: tool_name, env_action, call_id, call_name, arguments, observation, state, error, done, over,
purchase, raw_tokens, visible_tokens, truncated, footer, latency.  ``blocked``: step_index, call_id,
call_name, arguments, reason.  ``messages``: role, content, call_ids, call_id, guard.
``reward``: reward_version, reward_type, reward_valid, purchase_success, termination_reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rows import let

#: Versions, endings and errors that the gates know.
REWARD, GOLD = "shopsimulator-reward-v4", "gold_purchase"
INFRASTRUCTURE = ("ContextBudgetError", "RemoteDisconnected", "ShopHttpError", "TimeoutError", "URLError")
STATUSES = ("pass", "fail", "unverifiable")
CLOSING = "购买已完成。"
PAGES = ("view_attributes", "view_description", "view_features", "view_reviews")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(_true(bad), F.lit(code)) for bad, code in pairs]))


def spaced(c: Column) -> Column:
    """Case folded, white space runs as one space."""
    return F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))


def canonical_json(c: Column) -> Column:
    """An object's JSON with sorted keys: variants keep their keys in order."""
    return F.to_json(F.try_parse_json(c))


# --- tool calls --------------------------------------------------------------------------------


def call_payload(name: Column, arguments: Column, has_call: Column | None = None) -> Column:
    """JSN2: struct (name, parameters, error): bad calls keep a reason and an empty object."""
    raw = F.when(arguments == "", "{}").otherwise(arguments)

    def read(r: Column) -> Column:
        value = r["value"]
        error = F.when(~(F.lit(True) if has_call is None else _true(has_call)), "tool_call_not_object").when(r["raw"].isNull(), "tool_call_arguments_not_object_or_json")
        error = error.when(value.isNull(), "tool_call_arguments_invalid_json").when(~F.schema_of_variant(value).startswith("OBJECT"), "tool_call_arguments_not_object")
        return let(error, lambda e: F.struct(F.trim(F.coalesce(name, F.lit(""))).alias("name"), F.when(e.isNull(), F.to_json(value)).otherwise("{}").alias("parameters"), e.alias("error")))

    return let(F.struct(raw.alias("raw"), F.try_parse_json(raw).alias("value")), read)


def step_signature(step: Column) -> Column:
    """The environment action, or the tool with its arguments in canonical form (bad JSON: none)."""
    value = F.try_parse_json(F.coalesce(F.nullif(step["arguments"], F.lit("")), F.lit("{}")))
    shown = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_json(value)).otherwise("{}")
    return F.when(F.trim(F.coalesce(step["env_action"], F.lit(""))) != "", spaced(step["env_action"])).otherwise(F.concat_ws("\0", F.coalesce(step["tool_name"], F.lit("")), shown))


def attempt_signature(event: Column) -> Column:
    """X2 as metrics count it: like :func:`step_signature`, without the argument ``note``."""
    given = F.map_filter(F.from_json(F.coalesce(event["parameters"], F.lit("{}")), "map<string,string>"), lambda k, v: k != "note")
    plain = F.to_json(F.array_sort(F.map_entries(given)))
    tool = F.concat_ws("\0", F.lower(F.coalesce(event["tool_name"], F.lit(""))), plain)
    return F.when(F.trim(F.coalesce(event["env_action"], F.lit(""))) != "", F.concat(F.lit("env:"), spaced(event["env_action"]))).otherwise(tool)


def assistant_text(messages: Column, call_id: Column) -> Column:
    """JN16: what the assistant said with a call; the last message that holds the id counts."""
    said = F.filter(messages, lambda m: (m["role"] == "assistant") & _true(F.array_contains(m["call_ids"], call_id)))
    return let(said, lambda s: F.coalesce(F.get(s, F.size(s) - 1)["content"], F.lit("")))


def previous_observation(messages: Column, call_id: Column) -> Column:
    """WN15: the last tool message before the first assistant message with the call, guard messages skipped."""
    placed = F.transform(messages, lambda m, i: F.struct(i.alias("i"), m.alias("m")))
    at = F.get(F.filter(placed, lambda p: (p["m"]["role"] == "assistant") & _true(F.array_contains(p["m"]["call_ids"], call_id))), F.lit(0))["i"]
    seen = F.filter(placed, lambda p: (p["i"] < at) & ~_true(p["m"]["guard"]) & (p["m"]["role"] == "tool"))
    return F.coalesce(F.get(seen, F.size(seen) - 1)["m"]["content"], F.lit(""))


# --- what a page shows -------------------------------------------------------------------------

#: Product ids, buttons that only navigate, tools and the click each stands for.
PRODUCT = r"[0-9]{8,12}"


def product_ids(observation: Column) -> Column:
    """JSN5: ids of the products a page lists, in order, each once: in rows ``n|id|`` and between ``[SEP]``."""
    listed = F.regexp_extract_all(observation, F.lit(f"(?m)^[0-9]+\\|({PRODUCT})\\|"), F.lit(1))
    parts = F.filter(F.transform(F.split(observation, r"\s*\[SEP\]\s*"), lambda p: F.trim(p)), lambda p: F.regexp_like(p, F.lit(f"^{PRODUCT}$")))
    return F.array_distinct(F.concat(listed, parts))


def buttons(observation: Column) -> Column:
    """JSN5: the buttons of a page's footer; none if it is no JSON list."""
    found = F.nullif(F.regexp_extract(observation, r"可点击的按钮:\s*(\[[^\n]*\])", 1), F.lit(""))
    return F.coalesce(F.filter(F.from_json(found, "array<string>"), lambda b: b.isNotNull()), F.array().cast("array<string>"))


def selected_options(observation: Column) -> Column:
    """JSN5: ids of the options selected on a page."""
    found = F.nullif(F.regexp_extract(observation, r"(?m)^selected_options:\s*(\{.*\})\s*$", 1), F.lit(""))
    ids = F.transform(F.map_values(F.from_json(found, "map<string,struct<option_id:string>>")), lambda r: F.lower(F.trim(r["option_id"])))
    return F.coalesce(F.filter(F.array_distinct(ids), lambda i: i.isNotNull() & (i != "")), F.array().cast("array<string>"))


# --- gates -------------------------------------------------------------------------------------


def _buys(steps: Column) -> Column:
    return F.filter(steps, lambda s: _true((s["tool_name"] == "buy_now") | (s["env_action"] == "click[Buy Now]")))


def result_gate(error: Column, done: Column, over: Column, steps: Column, reward: Column) -> Column:
    """FLT4: reasons against a trajectory's result: a complete, valid gold purchase is wanted."""
    other = lambda c, v: ~_true(c == v)
    return _codes(
        (_given(error), "has_error"), (~_true(done) | ~_true(over), "environment_not_done"), (F.size(_buys(steps)) == 0, "missing_buy"),
        (other(reward["reward_version"], REWARD), "reward_v4_required"), (other(reward["reward_type"], GOLD), "reward_v4_not_gold_purchase"), (~_true(reward["reward_valid"]), "reward_v4_invalid"),
    )


def consistency_warnings(status: Column, done: Column, release_error: Column, reward: Column) -> Column:
    """FLT7: mismatches that do not reject."""
    return _codes(
        (~_true(status == "done"), "status_not_done"), (~_true(done), "trajectory_not_done"), (~_true(reward["purchase_success"]), "purchase_not_successful"),
        (~_true(reward["termination_reason"] == GOLD), "termination_not_gold_purchase"), (_given(release_error), "release_error"),
    )


def _neighbours(steps: Column) -> Column:
    """(left, right) of every two steps in a row."""
    n = F.size(steps)
    return F.when(n > 1, F.arrays_zip(F.slice(steps, F.lit(1), F.greatest(n - 1, F.lit(1))).alias("l"), F.slice(steps, F.lit(2), F.greatest(n - 1, F.lit(1))).alias("r"))).otherwise(
        F.arrays_zip(F.slice(steps, F.lit(1), F.lit(0)).alias("l"), F.slice(steps, F.lit(1), F.lit(0)).alias("r"))
    )


def _again(p: Column) -> Column:
    return step_signature(p["l"]) == step_signature(p["r"])


def removable_calls(steps: Column) -> Column:
    """WN2: ids of calls that repeat the step before without changing the state."""
    idle = lambda s: ~_true(s["done"]) & ~_given(s["error"]) & ~_true(s["over"]) & ~_true(s["purchase"])
    same = F.filter(_neighbours(steps), lambda p: _again(p) & idle(p["l"]) & idle(p["r"]) & _true(canonical_json(p["l"]["state"]) == canonical_json(p["r"]["state"])))
    return F.array_distinct(F.filter(F.transform(same, lambda p: p["r"]["call_id"]), lambda c: _given(c)))


def has_path(steps: Column) -> Column:
    """WN5: a search, later an opened product, later a purchase."""
    at = F.transform(steps, lambda s, i: F.struct(s["tool_name"].alias("t"), i.alias("i")))
    of = lambda t: F.transform(F.filter(at, lambda x: x["t"] == t), lambda x: x["i"])
    return _true(F.exists(of("open_product"), lambda o: (o > F.array_min(of("search_products"))) & (o < F.array_max(of("buy_now")))))


#: The click that a tool without a choice of its own stands for, and the argument of the others.
CLICKS = {"buy_now": "Buy Now", "back_to_search": "Back to Search", "next_page": "Next >", "prev_page": "< Prev"}
ARGUMENT = {"search_products": "query", "open_product": "asin", "select_option": "value", "finish_without_purchase": "reason", "think": "note"}
NAVIGATION = ("back to search", "next >", "< prev", "description", "features", "reviews", "attributes", "buy now")


def action_of(name: Column, arguments: Column) -> Column:
    """The environment action of a call, null for an unknown tool or without its argument."""
    arg = lambda k: F.get_json_object(arguments, f"$.{k}")
    out = F.when(name == "search_products", F.concat(F.lit("search["), arg("query"), F.lit("]"))).when(name == "finish_without_purchase", F.concat(F.lit("finish["), arg("reason"), F.lit("]")))
    for tool, key in (("open_product", "asin"), ("select_option", "value")):
        out = out.when(name == tool, F.concat(F.lit("click["), arg(key), F.lit("]")))
    for tool, click in CLICKS.items():
        out = out.when(name == tool, F.lit(f"click[{click}]"))
    return out


def action_reject(name: Column, arguments: Column, observation: Column) -> Column:
    """FLT9: the first reason against an action, null if it may run: its arguments fit its tool, and its
    target can be seen on the last page."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    allowed = F.lit(None).cast("string")
    for tool, key in ARGUMENT.items():
        allowed = F.when(name == tool, F.lit(key)).otherwise(allowed)
    known = allowed.isNotNull() | name.isin(*CLICKS)
    extra = F.array_sort(F.filter(keys, lambda k: ~_true(k == allowed)))
    given = F.coalesce(F.array_contains(keys, allowed), F.lit(True))
    shown = F.when(F.size(keys) > 0, F.to_json(value))
    text = F.get(F.map_values(F.from_json(arguments, "map<string,string>")), F.lit(0))
    quoted = F.regexp_like(shown, F.lit('^\\{"[^"]+":"'))
    target = F.lower(F.substring(action_of(name, arguments), 7, 1 << 20))
    target = F.left(target, F.length(target) - 1)
    here = F.coalesce(observation, F.lit(""))
    return (
        F.when(~_true(known), "unknown_tool")
        .when(~_true(F.schema_of_variant(value).startswith("OBJECT")), "schema_arguments_not_object")
        .when(F.size(extra) > 0, F.concat(F.lit("schema_extra_arguments:"), F.array_join(extra, ",")))
        .when(~given, F.concat(F.lit("schema_missing_arguments:"), allowed))
        .when((F.size(keys) > 0) & ~_true(quoted), F.concat(F.lit("schema_wrong_type:"), allowed, F.lit(":string")))
        .when((F.size(keys) > 0) & (F.trim(text) == ""), F.concat(F.lit("schema_empty_string:"), allowed))
        .when(name == "think", F.lit(None))
        .when(name == "finish_without_purchase", F.when(text != "no_suitable_product", "invalid_finish_reason"))
        .when(name == "search_products", F.when(F.contains(here, F.lit("搜索功能是否可用: False")), "search_not_available_on_current_page"))
        .when(here == "", "missing_previous_observation")
        .when(name == "open_product", F.when(~F.array_contains(product_ids(here), text), "click_not_in_previous_observation"))
        .when((name == "select_option") & target.isin(*NAVIGATION), "select_option_is_navigation_button")
        .when((name == "select_option") & ~F.regexp_like(target, F.lit("^opt_[0-9a-f]{16}$")), "select_option_requires_stable_id")
        .when(~F.exists(buttons(here), lambda b: F.lower(b) == target), "click_not_in_previous_observation")
    )


def step_reject(messages: Column, step: Column) -> Column:
    """FLT8: the first reason against an executed step, null if it is sound."""
    raw = F.coalesce(F.nullif(step["arguments"], F.lit("")), F.lit("{}"))
    value = F.try_parse_json(raw)
    wanted = action_of(step["call_name"], raw)
    return (
        F.when(~_given(step["call_name"]), "missing_tool_name")
        .when(value.isNull(), "invalid_arguments_json")
        .when(~F.schema_of_variant(value).startswith("OBJECT"), "arguments_not_object")
        .when(~_true(step["call_name"] == step["tool_name"]), "tool_name_mismatch")
        .when(wanted.isNull(), "unknown_or_invalid_tool")
        .when(~_true(wanted == step["env_action"]), "env_action_mismatch")
        .otherwise(action_reject(step["call_name"], raw, previous_observation(messages, step["call_id"])))
    )


def process_gate(steps: Column, messages: Column, truncations: Column) -> Column:
    """FLT5: structural reasons against a trajectory; blocked calls and idle repeats are no reason, as they
    can be taken out."""
    many = F.exists(messages, lambda m: (m["role"] == "assistant") & (F.size(m["call_ids"]) > 1))
    loose = F.filter(_neighbours(steps), lambda p: _again(p) & ~_true(F.array_contains(removable_calls(steps), p["r"]["call_id"])))
    invalid = (truncations > 0) | _true(many) | F.exists(steps, lambda s: step_reject(messages, s).isNotNull())
    broken = F.exists(steps, lambda s: _given(s["error"]))
    return _codes((invalid, "process_invalid_action"), (broken, "process_step_error"), (~has_path(steps), "process_missing_search_open_buy_path"), (F.size(loose) > 0, "process_consecutive_duplicate_action"))


def acceptance(result: Column, process: Column) -> Column:
    """FLT6: struct (accepted, reasons): the process is looked at only where the result is sound."""
    reasons = F.when(F.size(result) > 0, result).otherwise(process)
    return F.struct((F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))


# --- training rows -----------------------------------------------------------------------------


def terminal_call(done: Column, over: Column, steps: Column) -> Column:
    """WN14: the id of the last purchase of a trajectory that ended."""
    buys = _buys(steps)
    return F.when(_true(done) & _true(over), F.get(buys, F.size(buys) - 1)["call_id"])


def training_messages(messages: Column, blocked: Column, closing: Column) -> Column:
    """FLT14, FLT15: messages of guards and of blocked calls go, each message keeps the columns that a
    training row may have, and the last purchase's return says no more than that it is done."""
    gone = lambda m: _true(m["guard"]) | ((m["role"] == "tool") & _true(F.array_contains(blocked, m["call_id"]))) | ((m["role"] == "assistant") & _true(F.arrays_overlap(m["call_ids"], blocked)))
    shown = lambda m: F.when((m["role"] == "tool") & _true(m["call_id"] == closing), F.lit(CLOSING)).otherwise(m["content"])
    return F.transform(F.filter(messages, lambda m: ~_true(gone(m))), lambda m: F.struct(m["role"].alias("role"), shown(m).alias("content"), m["call_ids"].alias("call_ids"), m["call_id"].alias("call_id")))


def training_row(df: DataFrame) -> DataFrame:
    """PL3: (trajectory_id, task_id, messages) of trajectories with the columns named above."""
    ids = F.filter(F.transform(F.coalesce("blocked", F.array()), lambda b: b["call_id"]), lambda c: c.isNotNull())
    blocked = F.array_distinct(F.concat(ids, removable_calls(F.col("steps"))))
    return df.select("trajectory_id", "task_id", training_messages(F.col("messages"), blocked, terminal_call(F.col("done"), F.col("over"), F.col("steps"))).alias("messages"))


def collect(df: DataFrame, held_out: DataFrame, order: str) -> DataFrame:
    """PL1, PL2: every trajectory with ``accepted`` and ``reject_reasons``: both gates, then tasks held out,
    then all but the first accepted trajectory of a task, by ``order``.  Needs ``reasons`` (array)."""
    held = held_out.select("task_id").distinct().withColumn("held", F.lit(True))
    rows = df.join(held, "task_id", "left")
    sound = (F.size("reasons") == 0) & F.col("held").isNull()
    place = F.row_number().over(W.partitionBy("task_id", sound).orderBy(order))
    why = F.when(F.size("reasons") > 0, F.col("reasons")).when(F.col("held"), F.array(F.lit("held_out_task"))).when(place > 1, F.array(F.lit("duplicate_task"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("reject_reasons", why).withColumn("accepted", F.size("reject_reasons") == 0).drop("held")


# --- the event stream and metrics ----------------------------------------------------------------


def events(steps: Column, blocked: Column, messages: Column) -> Column:
    """WN8: one array of events: blocked calls before the step of their index, those with a bad index last;
    numbered.  Fields: event_id, event_type, tool_name, parameters, parse_error, env_action, text, call_id,
    reason, observation, and of steps: error, raw_tokens, visible_tokens, truncated, footer, latency."""
    none = lambda kind: F.lit(None).cast(kind)

    def of_step(s: Column, i: Column, call: Column, messages: Column) -> Column:
        name = F.coalesce(F.nullif(F.trim(s["tool_name"]), F.lit("")), call["name"])
        return F.struct(
            i.alias("at"), F.lit(1).alias("kind"), i.alias("no"), F.lit("tool_step").alias("event_type"), name.alias("tool_name"), call["parameters"].alias("parameters"), call["error"].alias("parse_error"), s["env_action"].alias("env_action"),
            assistant_text(messages, s["call_id"]).alias("text"), s["call_id"].alias("call_id"), none("string").alias("reason"), F.coalesce(s["observation"], F.lit("")).alias("observation"), s["error"].alias("error"),
            s["raw_tokens"].alias("raw_tokens"), s["visible_tokens"].alias("visible_tokens"), s["truncated"].alias("truncated"), s["footer"].alias("footer"), s["latency"].alias("latency"),
        )

    def of_block(b: Column, i: Column, call: Column, messages: Column, n: Column) -> Column:
        at = F.when((b["step_index"] >= 0) & (b["step_index"] <= n), b["step_index"]).otherwise(n + 1)
        return F.struct(
            at.alias("at"), F.lit(0).alias("kind"), i.alias("no"), F.lit("guard_rejection").alias("event_type"), call["name"].alias("tool_name"), call["parameters"].alias("parameters"), call["error"].alias("parse_error"), none("string").alias("env_action"),
            assistant_text(messages, b["call_id"]).alias("text"), b["call_id"].alias("call_id"), F.coalesce(F.nullif(b["reason"], F.lit("")), F.lit("unknown")).alias("reason"), F.lit("").alias("observation"), none("string").alias("error"),
            none("long").alias("raw_tokens"), none("long").alias("visible_tokens"), none("boolean").alias("truncated"), none("boolean").alias("footer"), none("double").alias("latency"),
        )

    called = lambda x, make: let(call_payload(x["call_name"], x["arguments"], x["call_id"].isNotNull()), make)

    def whole(g: Column) -> Column:
        ran = F.transform(g["steps"], lambda s, i: called(s, lambda c: of_step(s, i, c, g["messages"])))
        stopped = F.transform(g["blocked"], lambda b, i: called(b, lambda c: of_block(b, i, c, g["messages"], F.size(g["steps"]))))
        return F.transform(F.sort_array(F.concat(ran, stopped)), lambda e, i: e.withField("event_id", F.concat(F.lit("e"), F.lpad((i + 1).cast("string"), 4, "0"))))

    return let(F.struct(steps.alias("steps"), blocked.alias("blocked"), messages.alias("messages")), whole)


def repeats(signatures: Column) -> Column:
    """AG7 over an array: struct (again, consecutive)."""

    def counted(all_: Column) -> Column:
        next_ = F.filter(F.transform(all_, lambda s, i: (i > 0) & (F.get(all_, i - 1) == s)), _true)
        return F.struct((F.size(all_) - F.size(F.array_distinct(all_))).alias("again"), F.size(next_).alias("consecutive"))

    return let(signatures, counted)


def strict_success(status: Column, done: Column, terminal_done: Column, over: Column, reward: Column) -> Column:
    """Nine equalities, of which none may be null."""
    checks = [reward["reward_version"] == REWARD, status == "done", done, terminal_done, over, reward["reward_type"] == GOLD, reward["reward_valid"], reward["purchase_success"], reward["termination_reason"] == GOLD]
    out = F.lit(True)
    for c in checks:
        out = out & _true(c)
    return out


def metrics(stream: Column) -> Column:
    """AG6: counts of an event stream."""
    ran = lambda g: F.filter(g, lambda e: e["event_type"] == "tool_step")
    guards = lambda g: F.filter(g, lambda e: e["event_type"] == "guard_rejection")
    tool = lambda rows, *t: F.filter(rows, lambda e: e["tool_name"].isin(*t))
    kinds = lambda g: F.struct(g.alias("all"), ran(g).alias("ran"), guards(g).alias("guards"))

    def parted(g: Column) -> Column:
        shown = F.filter(g["ran"], lambda e: e["raw_tokens"].isNotNull())
        return F.struct(g.alias("g"), tool(g["ran"], "search_products").alias("searched"), tool(g["ran"], "open_product").alias("opened"), shown.alias("shown"))

    def found(p: Column) -> Column:
        attempts = repeats(F.transform(p["g"]["all"], attempt_signature))
        searches = repeats(F.transform(p["searched"], lambda e: spaced(F.coalesce(F.get_json_object(e["parameters"], "$.query"), F.lit("")))))
        total = lambda f: F.aggregate(p["shown"], F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e[f], F.lit(0).cast("long")))
        return F.struct(p.alias("p"), attempts.alias("attempts"), searches.alias("searches"), total("raw_tokens").alias("raw"), total("visible_tokens").alias("visible"))

    return let(let(let(let(stream, kinds), parted), found), _counts)


def _counts(x: Column) -> Column:
    shown, searched, opens, attempts, searches = x["p"]["shown"], x["p"]["searched"], x["p"]["opened"], x["attempts"], x["searches"]
    stream, ran, guards = (x["p"]["g"][n] for n in ("all", "ran", "guards"))
    tool = lambda *t: F.filter(ran, lambda e: e["tool_name"].isin(*t))
    pages = F.array_distinct(F.transform(searched, lambda e: e["observation"]))  # a page that came twice is read once
    seen = F.array_distinct(F.flatten(F.transform(pages, lambda o: F.regexp_extract_all(o, F.lit(f"(?<![0-9])({PRODUCT})(?![0-9])"), F.lit(1)))))
    opened = F.array_distinct(F.array_compact(F.transform(opens, lambda e: F.get_json_object(e["parameters"], "$.asin"))))
    count = lambda rows, test: F.size(F.filter(rows, lambda e: _true(test(e))))
    return F.struct(
        F.size(ran).alias("executed"), F.size(stream).alias("attempts"), F.size(searched).alias("searches"), F.size(opens).alias("opened"), F.size(tool(*PAGES)).alias("pages"), F.size(tool("select_option")).alias("selects"),
        F.size(tool("buy_now")).alias("buys"), F.size(seen).alias("visible_candidates"), F.size(opened).alias("opened_candidates"), searches["again"].alias("repeated_searches"), searches["consecutive"].alias("consecutive_searches"),
        attempts["again"].alias("repeated_actions"), attempts["consecutive"].alias("consecutive_actions"), F.size(guards).alias("guards"), count(stream, lambda e: e["parse_error"].isNotNull()).alias("malformed"),
        count(guards, lambda e: e["reason"].startswith("schema_")).alias("schema_rejections"), count(ran, lambda e: _given(e["error"])).alias("step_errors"), F.size(shown).alias("projections"), count(shown, lambda e: e["truncated"]).alias("truncated"),
        x["raw"].alias("raw_tokens"), x["visible"].alias("visible_tokens"), F.when(x["raw"] > 0, x["visible"] / x["raw"]).alias("compression"),
        count(shown, lambda e: ~_true(e["footer"])).alias("footer_failures"), F.aggregate(ran, F.lit(0.0), lambda a, e: a + F.when(e["latency"] >= 0, e["latency"]).otherwise(0.0)).alias("tool_seconds"),
    )


def call_totals(calls: Column) -> Column:
    """AG8: tokens and seconds of model calls (prompt_tokens, input_tokens, completion_tokens, output_tokens,
    total_tokens, cached, cached_tokens, latency); what no call tells stays null."""
    good = lambda x: F.when((x >= 0) & (x < float("inf")), x)
    prompt = lambda c: F.coalesce(good(c["prompt_tokens"]), good(c["input_tokens"]))
    done = lambda c: F.coalesce(good(c["completion_tokens"]), good(c["output_tokens"]))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("double"))
    whole = lambda c: F.coalesce(good(c["total_tokens"]), F.when(prompt(c).isNotNull() | done(c).isNotNull(), zero(prompt(c)) + zero(done(c))))

    def total(of) -> Column:
        known = F.array_compact(F.transform(calls, lambda c: of(c).cast("double")))
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x))

    n = F.coalesce(F.size(calls), F.lit(0))
    seconds = F.when(n > 0, F.coalesce(total(lambda c: good(c["latency"])), F.lit(0.0)))
    return F.struct(n.alias("calls"), total(prompt).alias("prompt"), total(done).alias("completion"), total(whole).alias("total"), total(lambda c: F.coalesce(good(c["cached"]), good(c["cached_tokens"]))).alias("cached"), seconds.alias("seconds"))


def constraint_check(version: Column, contract: Column, results: Column, declared_total: Column, declared: Column) -> Column:
    """AG9: struct (total, counts by status, issues): the statuses counted again and held against the declared
    summary (``declared``: map status -> count)."""
    rows = F.coalesce(results, F.array().cast("array<string>"))
    count = lambda s: F.size(F.filter(rows, lambda r: r == s))
    counts = F.create_map(*[x for s in STATUSES for x in (F.lit(s), count(s))])
    odd = F.filter(F.transform(rows, lambda r, i: F.when(~_true(r.isin(*STATUSES)), F.concat(F.lit("constraint_result_"), i.cast("string"), F.lit("_invalid_status")))), lambda x: x.isNotNull())
    differ = (declared_total != F.size(rows)) | F.exists(F.array(*[F.coalesce(declared[s], F.lit(-1)) != count(s) for s in STATUSES]), lambda x: x)
    new = _true(version == REWARD)
    first = _codes((new & ~_true(contract == "shopping-query-constraints-v1"), "missing_or_unexpected_query_constraint_version"))
    last = F.array_compact(F.array(F.when(declared.isNotNull() & _true(differ), "constraint_summary_mismatch").when(declared.isNull() & new, "missing_constraint_summary")))
    return F.struct(F.size(rows).alias("total"), counts.alias("counts"), F.concat(first, odd, last).alias("issues"))


def infrastructure_failure(flag: Column, trajectory_error: Column, release_error: Column) -> Column:
    """The run failed for a reason that is not the agent's (errors by type)."""
    return _true(flag) | _given(release_error) | _true(trajectory_error.isin(*INFRASTRUCTURE))


def query_text(instruction: Column, messages: Column) -> Column:
    """The first instruction, else the first user message without its prefix."""
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    plain = F.regexp_replace(F.trim(F.coalesce(first, F.lit(""))), "(?i)^\\s*Instruction:\\s*", "")
    return F.coalesce(F.nullif(F.trim(instruction), F.lit("")), plain)


def terminal_view(done: Column, over: Column, reward: Column, final: Column, detail_reason: Column, reason: Column) -> Column:
    """X11, PL5: the ending with defaults for what is missing."""
    why = F.coalesce(F.nullif(detail_reason, F.lit("")), F.nullif(reason, F.lit("")), F.lit(""))
    return F.struct(_true(done).alias("done"), _true(over).alias("over"), F.coalesce(reward, final, F.lit(0.0)).alias("reward"), why.alias("termination_reason"))
