"""Option axes of products: selections, required values, and the price they resolve to.

``options`` is map(axis, array of (value, price, ...)), ``selected`` map(axis, value).  Verdicts are
``pass``, ``fail`` and ``unverifiable``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rows import let

#: Names that stand for one axis.
AXES = {
    "color": ("颜色", "颜色分类"), "size": ("尺码", "鞋码"), "dimensions": ("尺寸", "大小"), "net_content": ("净含量", "总净含量"), "flavor": ("口味", "食品口味"),
    "specification": ("规格", "规格描述", "规格类型"), "bundle": ("套餐", "套餐类型", "组合套餐"), "capacity": ("容量", "规格容量"),
}
#: Other writings of a unit in an option.
UNIT_NAMES = {"平方米": ("平方米", "平米", "㎡")}
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))


def option_form(c: Column) -> Column:
    """STR2 within expressions: full-width characters as ASCII, lower case, a slash as a bar, no white space."""
    return F.regexp_replace(F.replace(F.lower(F.translate(c, _WIDE, _PLAIN)), F.lit("/"), F.lit("|")), "[\\s 　]+", "")


def axis_form(c: Column) -> Column:
    """STR3: the canonical name of an axis."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable((a, k) for k, v in AXES.items() for a in v)])
    return let(option_form(c), lambda form: F.coalesce(F.try_element_at(names, form), form))


def _price(c: Column) -> Column:
    return F.when((c >= 0) & (c < float("inf")), c)


def axes(options: Column) -> Column:
    """SC6: struct of ``axes`` (array of axis, source, values: form, value, price; the last of equal
    forms) and ``collisions`` (axes that more than one name stands for, left out of ``axes``)."""

    def values(vs: Column) -> Column:
        shown = F.filter(F.transform(vs, lambda v: F.struct(option_form(v["value"]).alias("form"), v["value"].alias("value"), _price(v["price"]).alias("price"))), lambda v: v["form"] != "")
        return let(shown, lambda r: F.filter(r, lambda v, i: ~F.exists(F.slice(r, i + 2, F.size(r)), lambda w: w["form"] == v["form"])))

    def index(every: Column) -> Column:
        twice = F.array_distinct(F.filter(F.transform(every, lambda a: a["axis"]), lambda n: F.size(F.filter(every, lambda b: b["axis"] == n)) > 1))
        return let(twice, lambda t: F.struct(F.filter(every, lambda a: ~F.array_contains(t, a["axis"])).alias("axes"), t.alias("collisions")))

    every = F.transform(F.coalesce(F.map_entries(options), F.array()), lambda e: F.struct(axis_form(e["key"]).alias("axis"), e["key"].alias("source"), values(e["value"]).alias("values")))
    return let(every, index)


def chosen(selected: Column) -> Column:
    """(axis, form, value) of a selection."""
    return F.transform(F.map_entries(selected), lambda e: F.struct(axis_form(e["key"]).alias("axis"), option_form(e["value"]).alias("form"), e["value"].alias("value")))


def ambiguous(picked: Column) -> Column:
    """Two names of a selection stand for one axis, or there is no selection at all."""
    return picked.isNull() | (F.size(F.array_distinct(F.transform(picked, lambda p: p["axis"]))) < F.size(picked))


def _form_of(picked: Column, axis: Column) -> Column:
    return F.get(F.filter(picked, lambda p: p["axis"] == axis), F.lit(0))["form"]


def _entry(axis: Column, form: Column) -> Column:
    return F.get(F.filter(axis["values"], lambda v: v["form"] == form), F.lit(0))


def _state(options: Column, selected: Column) -> Column:
    """(axes, collisions, picked, void: the selection is ambiguous or an axis has two names), to be computed once a row."""
    both = F.struct(axes(options).alias("index"), chosen(selected).alias("picked"))
    return let(both, lambda b: F.struct(b["index"]["axes"].alias("axes"), b["index"]["collisions"].alias("collisions"), b["picked"].alias("picked"), (ambiguous(b["picked"]) | (F.size(b["index"]["collisions"]) > 0)).alias("void")))


def _pairs(picked: Column) -> Column:
    return F.array_sort(F.transform(picked, lambda p: F.struct(p["axis"].alias("axis"), p["form"].alias("form"))))


def resolve_price(options: Column, selected: Column, combinations: Column, base: Column) -> Column:
    """SC10: struct (status, price, method).  A listed combination; else the one axis whose values differ
    in price, which must be selected; else a price that all values share; else, without axes, the one base
    price."""

    def found(price: Column | None, method: str) -> Column:
        return F.struct(F.lit("unverifiable" if price is None else "pass").alias("status"), (F.lit(None).cast("double") if price is None else price).alias("price"), F.lit(method).alias("method"))

    def prices(s: Column) -> Column:
        known = F.transform(s["axes"], lambda a: F.struct(a.alias("axis"), F.array_distinct(F.filter(F.transform(a["values"], lambda v: v["price"]), lambda p: p.isNotNull())).alias("prices")))
        combo = let(_pairs(s["picked"]), lambda own: _price(F.get(F.filter(combinations, lambda c: _pairs(chosen(c["options"])) == own), F.lit(0))["price"]))
        bases = F.array_distinct(F.filter(base, lambda p: _price(p).isNotNull()))
        return F.struct(s.alias("s"), known.alias("known"), combo.alias("combo"), bases.alias("bases"))

    def spread(k: Column) -> Column:
        priced = F.filter(k["known"], lambda x: F.size(x["prices"]) > 1)
        return F.struct(k.alias("k"), priced.alias("priced"), F.array_distinct(F.flatten(F.transform(k["known"], lambda x: x["prices"]))).alias("every"))

    def at(r: Column) -> Column:
        axis = F.get(r["priced"], F.lit(0))["axis"]
        return let(_form_of(r["k"]["s"]["picked"], axis["axis"]), lambda form: F.struct(r.alias("r"), form.alias("form"), _entry(axis, form)["price"].alias("price")))

    def ladder(x: Column) -> Column:
        r, k, s = x["r"], x["r"]["k"], x["r"]["k"]["s"]
        return (
            F.when(s["void"], found(None, "invalid_option_axes"))
            .when(k["combo"].isNotNull(), found(k["combo"], "full_variant_combination"))
            .when(F.size(r["priced"]) > 1, found(None, "multiple_effective_price_axes"))
            .when((F.size(r["priced"]) == 1) & x["form"].isNull(), found(None, "effective_price_axis_unselected"))
            .when((F.size(r["priced"]) == 1) & x["price"].isNull(), found(None, "selected_variant_price_missing"))
            .when(F.size(r["priced"]) == 1, found(x["price"], "unique_effective_price_axis"))
            .when(F.size(r["every"]) == 1, found(F.get(r["every"], F.lit(0)), "constant_option_price"))
            .when((F.size(s["axes"]) == 0) & (F.size(k["bases"]) == 1), found(F.get(k["bases"], F.lit(0)), "single_base_price"))
            .otherwise(found(None, "price_not_deterministic"))
        )

    return let(let(let(let(_state(options, selected), prices), spread), at), ladder)


def _verdict(s: Column, e: Column) -> Column:
    """The verdict of one required entry on a state."""
    axis = F.get(F.filter(s["axes"], lambda a: a["axis"] == e["key"]), F.lit(0))
    seen = F.struct(axis.alias("axis"), option_form(e["value"]).alias("want"), _form_of(s["picked"], e["key"]).alias("have"))

    def judged(x: Column) -> Column:
        lone = x["have"].isNull() & (F.size(x["axis"]["values"]) == 1)
        met = lone | F.coalesce(x["have"] == x["want"], F.lit(False))
        return F.when(x["axis"].isNull(), "unverifiable").when(_entry(x["axis"], x["want"]).isNull(), "fail").when(met, "pass").otherwise("fail")

    return let(seen, judged)


def required_verdict(options: Column, required: Column, selected: Column) -> Column:
    """SC7: every required axis (canonical name -> value) has the value selected; a lone value counts as
    selected.  A missing axis cannot be verified, which outweighs a wrong value."""

    def whole(s: Column) -> Column:
        each = F.transform(F.map_entries(required), lambda e: _verdict(s, e))
        return let(each, lambda r: F.when(required.isNull() | s["void"] | F.array_contains(r, "unverifiable"), "unverifiable").when(F.array_contains(r, "fail"), "fail").otherwise("pass"))

    return let(_state(options, selected), whole)


def candidate_options(options: Column, required: Column, fill: bool = True) -> Column:
    """SC8, and with ``fill`` SC9: struct (status, reason, selected: map of source axis -> value).  Required
    values first; every other axis then takes its value of least price (unpriced last), then least form."""
    least = lambda a: F.array_min(F.transform(a["values"], lambda v: F.struct(v["price"].isNull().alias("u"), v["price"].alias("p"), v["form"].alias("f"), v["value"].alias("v"))))["v"]
    pairs = lambda named: F.transform(named, lambda n: F.struct(n["source"].alias("key"), n["value"].alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")

    def out(status: str, reason: str | None, pairs: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), F.map_from_entries(pairs).alias("selected"))

    def steps(index: Column) -> Column:
        each = F.transform(F.map_entries(required), lambda e: F.struct(e["key"].alias("axis"), F.get(F.filter(index["axes"], lambda a: a["axis"] == e["key"]), F.lit(0)).alias("at"), option_form(e["value"]).alias("form")))
        return F.struct(index.alias("index"), each.alias("steps"))

    def named(x: Column) -> Column:
        each = F.transform(x["steps"], lambda s: F.struct(s["at"]["source"].alias("source"), _entry(s["at"], s["form"])["value"].alias("value"), s["at"].isNull().alias("no_axis")))
        open_ = F.filter(x["index"]["axes"], lambda a: ~F.exists(x["steps"], lambda s: s["axis"] == a["axis"]))
        return let(each, lambda n: F.struct(x["index"]["collisions"].alias("collisions"), n.alias("named"), F.get(F.filter(n, lambda v: v["value"].isNull()), F.lit(0)).alias("bad"), open_.alias("open")))

    def rows(x: Column) -> Column:
        bad = x["bad"]
        rows = (
            F.when(required.isNull(), out("unverifiable", "missing_contract", none))
            .when(F.size(x["collisions"]) > 0, out("unverifiable", "candidate_axis_collision", none))
            .when(bad.isNotNull() & bad["no_axis"], out("unverifiable", "candidate_axis_missing", none))
            .when(bad.isNotNull(), out("fail", "candidate_required_value_missing", none))
        )
        taken = pairs(x["named"])
        if fill:
            rows = rows.when(F.exists(x["open"], lambda a: F.size(a["values"]) == 0), out("unverifiable", "candidate_axis_has_no_values", taken))
            taken = F.concat(taken, F.transform(x["open"], lambda a: F.struct(a["source"].alias("key"), least(a).alias("value"))))
        return rows.otherwise(out("pass", None, taken))

    return let(let(let(axes(options), steps), named), rows)


def required_axes(values: Column, options: Column) -> Column:
    """SC25: for each required value struct (value, axis, reason): the one axis that lists it, else why
    none is (not found, ambiguous, or a canonical axis that an earlier value took)."""
    shown = F.transform(F.map_entries(options), lambda e: F.struct(axis_form(e["key"]).alias("axis"), F.transform(e["value"], lambda x: option_form(x["value"])).alias("forms")))
    listed = lambda v, every: let(option_form(v), lambda form: F.filter(every, lambda e: F.exists(e["forms"], lambda x: x == form)))
    named = lambda every: F.transform(values, lambda v: F.struct(v.alias("value"), F.transform(listed(v, every), lambda e: e["axis"]).alias("names")))
    lone = lambda f: F.size(f["names"]) == 1

    def row(found: Column, f: Column, i: Column) -> Column:
        axis = F.get(f["names"], F.lit(0))
        again = F.exists(F.slice(found, F.lit(1), i), lambda g: lone(g) & (F.get(g["names"], F.lit(0)) == axis))
        why = F.when(F.size(f["names"]) == 0, "axis_not_found").when(~lone(f), "axis_ambiguous").when(again, "canonical_axis_collision")
        return F.struct(f["value"].alias("value"), F.when(why.isNull(), axis).alias("axis"), why.alias("reason"))

    return let(let(shown, named), lambda found: F.transform(found, lambda f, i: row(found, f, i)))


def unit_count(selected: Column, unit: Column) -> Column:
    """NUM13: how many units the selected options say: ``50包`` before ``×50``; null if neither does."""
    text = F.array_join(F.filter(F.map_values(selected), lambda v: F.coalesce(v, F.lit("")) != ""), " ")
    names = F.lit(None).cast("string")
    for name, others in UNIT_NAMES.items():
        names = F.when(F.trim(unit) == name, "|".join(others)).otherwise(names)
    names = F.coalesce(names, F.concat(F.lit("\\Q"), F.trim(unit), F.lit("\\E")))
    # built from a column, so the pattern is applied with an expression of its own a row
    direct = F.regexp_extract_all(text, F.concat(F.lit("(?U)(?<!\\d)(\\d{1,5})\\s*(?:"), names, F.lit(")(?!\\w)")), F.lit(1))
    times = F.regexp_extract_all(text, F.lit("(?:\\*|x|X|×)\\s*([0-9]{1,5})(?![0-9])"), F.lit(1))
    first, last = F.get(direct, F.lit(0)).cast("int"), F.get(times, F.size(times) - 1).cast("int")
    return F.when((F.trim(unit) != "") & (first > 0), first).when(last > 0, last)


def price_for_basis(resolution: Column, unit: Column, selected: Column) -> Column:
    """NUM14: a resolved price per unit, where the constraint is per unit (``unit`` not null) and the
    selection says how many there are; else as it is."""
    n = unit_count(selected, unit)
    per = F.struct(resolution["status"].alias("status"), (resolution["price"] / n).alias("price"), F.lit("selected_variant_unit_price_v1").alias("method"))
    return F.when(unit.isNotNull() & (resolution["status"] == "pass") & n.isNotNull() & resolution["price"].isNotNull(), per).otherwise(resolution)


def option_constraint(axis: Column, expected: Column, options: Column, selected: Column) -> Column:
    """A constraint with an axis is a required option; without one, any selected value will do."""
    any_value = F.when(F.exists(F.map_values(selected), lambda v: option_form(v) == option_form(expected)), "pass").otherwise("fail")
    return F.when(axis.isNull(), any_value).otherwise(required_verdict(options, F.create_map(F.coalesce(axis, F.lit("")), expected), selected))


def fraction(results: Column) -> Column:
    """SC13: struct (active, score, coverage, required, passed, verifiable) over an array of verdicts."""
    n = F.size(results)
    ok, seen = F.size(F.filter(results, lambda r: r == "pass")), F.size(F.filter(results, lambda r: r != "unverifiable"))
    share = lambda k: F.when(n > 0, k / n).otherwise(0.0)
    return F.struct((n > 0).alias("active"), share(ok).alias("score"), share(seen).alias("coverage"), n.alias("required"), ok.alias("passed"), seen.alias("verifiable"))


def option_dimension(options: Column, required: Column, unresolved: Column, strict: Column, selected: Column) -> Column:
    """SC14: :func:`fraction` over the strict axes and the strict values without an axis, and whether all
    required options, and all strict ones, are satisfied.  ``strict`` is null without a contract (all count),
    else an array of (axis, value) of which the axis may be null."""
    forms = F.transform(F.map_values(selected), option_form)

    def verdicts(s: Column) -> Column:
        every = F.transform(F.map_entries(required), lambda e: F.struct(e["key"].alias("axis"), F.when(s["state"]["void"], "unverifiable").otherwise(_verdict(s["state"], e)).alias("verdict")))
        loose = F.transform(unresolved, option_form)
        loose = F.filter(loose, lambda v: strict.isNull() | F.exists(strict, lambda x: x["axis"].isNull() & (option_form(x["value"]) == v)))
        return F.struct(every.alias("every"), F.transform(loose, lambda v: F.when(F.exists(s["forms"], lambda x: x == v), "pass").otherwise("fail")).alias("loose"))

    def whole(x: Column) -> Column:
        passed = lambda r: F.forall(r, lambda v: v == "pass")
        of = lambda es: F.transform(es, lambda e: e["verdict"])
        used = F.filter(x["every"], lambda e: strict.isNull() | F.exists(strict, lambda s: s["axis"] == e["axis"]))
        return let(F.concat(of(used), x["loose"]), lambda results: F.struct(fraction(results).alias("dimension"), passed(of(x["every"])).alias("exact"), passed(results).alias("strict_exact")))

    return let(let(F.struct(_state(options, selected).alias("state"), forms.alias("forms")), verdicts), whole)


def selections(options: Column, most: int = 256) -> Column:
    """FLT13: all combinations of one value an axis, null if there are more than ``most`` (the guard of
    the operator, not a cut: callers treat null as not verifiable)."""
    entries = F.map_entries(options)
    n = F.aggregate(entries, F.lit(1).cast("long"), lambda a, e: F.least(a * F.size(e["value"]), F.lit(most + 1).cast("long")))
    start = F.array(F.array().cast("array<struct<key:string,value:string>>"))
    grown = F.aggregate(entries, start, lambda acc, e: F.flatten(F.transform(acc, lambda row: F.transform(e["value"], lambda v: F.concat(row, F.array(F.struct(e["key"].alias("key"), v["value"].alias("value"))))))))
    return F.when(n <= most, F.transform(grown, lambda row: F.map_from_entries(row)))
