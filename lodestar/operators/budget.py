"""Pages cut to a budget: the longest cut that fits, searched inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a cut page and the heads of its lines.
MARKER = "[TRUNCATED_BY_SHOPPING_PROJECTOR]"
PROJECTION = "[SHOPPING_OBSERVATION_PROJECTION]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def longest_fit(high: Column, fits: Callable[[Column], Column]) -> Column:
    """The last of 0 to ``high`` that a binary search finds to fit, -1 if none does: as many steps as ``high`` has binary
    digits, as a fold in the expression, so rows need no UDF.  If fitting is monotone it is the greatest."""
    digits = F.length(F.bin(high.cast("long") + 1))
    start = F.struct(F.lit(0).cast("long").alias("low"), high.cast("long").alias("high"), F.lit(-1).cast("long").alias("best"))

    def step(state: Column, _: Column) -> Column:
        low, top = state["low"], state["high"]
        found = lambda m: F.struct((m + 1).alias("low"), top.alias("high"), m.alias("best"))
        missed = lambda m: F.struct(low.alias("low"), (m - 1).alias("high"), state["best"].alias("best"))
        return F.when(low > top, state).otherwise(let(F.floor((low + top) / 2).cast("long"), lambda m: F.when(fits(m), found(m)).otherwise(missed(m))))

    return F.aggregate(F.sequence(F.lit(1), digits), start, step, lambda s: s["best"])


def cut_middle(title: Column, limit: Column) -> Column:
    """``title`` in ``limit`` characters: two thirds of its head and the rest of its tail about an ellipsis."""
    n, more = F.char_length(title), limit - 1
    head = F.greatest(F.lit(1), F.floor(more * 2 / 3).cast("int"))
    tail = F.greatest(F.lit(1), (more - head).cast("int"))
    long_ = F.concat(F.substring(title, F.lit(1), head), F.lit("…"), F.substring(title, (n - tail + 1).cast("int"), tail))
    return F.when(limit <= 0, "").when(n <= limit, title).when(limit == 1, "…").when(limit == 2, F.concat(F.substring(title, 1, 1), F.lit("…"))).otherwise(long_)


def search_page(products: Column, query: Column, page: Column, footer: Column, limit: Column) -> Column:
    """A page of results with titles of at most ``limit`` characters: products are structs (id, price, title), ``footer`` an array of lines."""
    lines = F.transform(products, lambda p, i: F.concat(F.lpad((i + 1).cast("string"), 2, "0"), F.lit("|"), p["id"], F.lit("|"), p["price"], F.lit("|"), cut_middle(p["title"], limit)))
    cut = F.exists(products, lambda p: F.char_length(p["title"]) > limit)
    n = F.size(products).cast("string")
    head = F.array(F.lit(PROJECTION), F.lit("page_type: search_results"), F.concat(F.lit("query: "), F.when(F.trim(query) == "", None).otherwise(F.trim(query))), F.concat(F.lit("page: "), page), F.concat(F.lit("products_shown: "), n, F.lit("/"), n))
    head = F.transform(head, lambda line: F.coalesce(line, F.lit("query: (not recorded)")))
    mark = F.when(cut, F.array(F.lit(f"{MARKER} product_titles_compacted=true"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, lines, mark, footer), "\n")


def fit_search_page(products: Column, query: Column, page: Column, footer: Column, budget: int, count: Callable[[Column], Column]) -> Column:
    """JSN4: struct (limit, text) of the page with the longest titles that ``count`` finds within ``budget``; every product stays.
    Both are null if even empty titles do not fit, or the page has no products; null titles and prices are empty."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = F.transform(products, lambda p: F.struct(empty(p["id"]).alias("id"), empty(p["price"]).alias("price"), empty(p["title"]).alias("title")))
    query, page, footer = F.coalesce(query, F.lit("")), F.coalesce(page, F.lit("Page unknown")), F.coalesce(footer, F.array().cast("array<string>"))
    longest = F.coalesce(F.array_max(F.transform(rows, lambda p: F.char_length(p["title"]))), F.lit(0))
    best = F.when(F.size(rows) > 0, longest_fit(longest, lambda m: count(search_page(rows, query, page, footer, m)) <= budget))
    return let(best, lambda m: F.when(m >= 0, F.struct(m.alias("limit"), search_page(rows, query, page, footer, m).alias("text"))))


def fit_body(body: Column, footer: Column, budget: int, count: Callable[[Column], Column]) -> Column:
    """JSN4: a page of text with its footer whole: four fifths of the cut from the head of the body and one from its tail, the longest
    that fits; the text as it is if it fits, null if the footer alone does not.  White space at the cut goes; a null body is empty."""
    body, end = F.coalesce(body, F.lit("")), F.array_join(F.coalesce(footer, F.array().cast("array<string>")), "\n")
    whole, least = F.concat(body, F.lit("\n"), end), F.concat(F.lit(MARKER + "\n"), end)

    def cut(m: Column) -> Column:
        tail = F.floor(m / 5).cast("int")
        head = F.regexp_replace(F.substring(body, F.lit(1), (m - tail).cast("int")), r"\s+$", "")
        last = F.regexp_replace(F.substring(body, (F.char_length(body) - tail + 1).cast("int"), tail), r"^\s+", "")
        return F.when(tail > 0, F.concat(head, F.lit(f"\n{MARKER}\n"), last, F.lit("\n"), end)).otherwise(least)

    best = longest_fit(F.char_length(body), lambda m: count(cut(m)) <= budget)
    return F.when(count(whole) <= budget, whole).when(count(least) <= budget, let(best, lambda m: F.when(m >= 0, cut(m)).otherwise(least)))
