"""Pages cut to a budget equal a plain binary search."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import budget

FOOTER = ["", "state", "buttons"]


def cut_title(t, n):
    if n <= 0 or len(t) <= n or n <= 2:
        return "" if n <= 0 else t if len(t) <= n else "…" if n == 1 else t[0] + "…"
    head = max(1, (n - 1) * 2 // 3)
    return t[:head] + "…" + t[-max(1, n - 1 - head) :]


def search(high, fits):
    low, best = 0, -1
    while low <= high:
        m = (low + high) // 2
        if fits(m):
            best, low = m, m + 1
        else:
            high = m - 1
    return best


def results(products, query, n):
    lines = [budget.PROJECTION, "page_type: search_results", f"query: {query.strip() or '(not recorded)'}", "page: Page 2", f"products_shown: {len(products)}/{len(products)}"]
    lines += [f"{i:02d}|{a}|{p}|{cut_title(t, n)}" for i, (a, p, t) in enumerate(products, 1)]
    if any(len(t) > n for *_, t in products):
        lines.append(f"{budget.MARKER} product_titles_compacted=true")
    return "\n".join([*lines, *FOOTER])


@pytest.mark.parametrize("limit", [120, 260, 300, 420, 2000])
def test_results(spark, limit):
    pages = [(1, [("100", "5", "a long title of a thing" * 3), ("200", "7", "茶杯" * 40), ("300", "9", "")], "tea "), (2, [("1", "2", "é")], ""), (3, [("1", "2", "xyz")] * 12, "q"), (4, [], "q")]
    df = spark.createDataFrame(pages, "k int, p array<struct<id:string,price:string,title:string>>, q string")
    fit = budget.fit_search_page(F.col("p"), F.col("q"), F.lit("Page 2"), F.array(*[F.lit(x) for x in FOOTER]), limit, F.octet_length)
    got = {r.k: r.f for r in df.select("k", fit.alias("f")).collect()}
    for k, products, query in pages:
        best = search(max((len(t) for *_, t in products), default=0), lambda m: len(results(products, query, m).encode()) <= limit) if products else -1
        assert (None if best < 0 else (best, results(products, query, best))) == (None if got[k] is None else tuple(got[k])), k


def test_missing_values(spark):
    df = spark.createDataFrame([(None, None), ([(None, None, None)], None)], "p array<struct<id:string,price:string,title:string>>, t string")
    fit = budget.fit_search_page(F.col("p"), F.lit(None).cast("string"), F.lit("Page 2"), F.lit(None).cast("array<string>"), 500, F.octet_length)
    body = budget.fit_body(F.col("t"), F.lit(None).cast("array<string>"), 50, F.octet_length)
    first, second = df.select(fit.alias("f"), body.alias("b")).collect()
    assert first.f is None and second.f.limit == 0 and "query: (not recorded)" in second.f.text and first.b == "\n"


def test_bodies(spark):
    end = "\n".join(FOOTER)
    texts = ["", "short", "word " * 400, "日本語 " * 200, "x" * 5000, "a \n\n b " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")

    def cut(t, m):
        tail = m // 5
        if not tail:
            return f"{budget.MARKER}\n{end}"
        return f"{t[: m - tail].rstrip()}\n{budget.MARKER}\n{t[-tail:].lstrip()}\n{end}"

    for limit in (20, 60, 200, 1000):
        got = dict(map(tuple, df.select("k", budget.fit_body(F.col("t"), F.array(*[F.lit(x) for x in FOOTER]), limit, F.octet_length)).collect()))
        for k, t in enumerate(texts):
            size = lambda s: len(s.encode())
            whole, least = f"{t}\n{end}", cut(t, 0)
            best = search(len(t), lambda m: size(cut(t, m)) <= limit)
            want = whole if size(whole) <= limit else None if size(least) > limit else cut(t, best) if best >= 0 else least
            assert got[k] == want, (limit, k)
